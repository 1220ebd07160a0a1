"""From PDF files to catalog records: only contents that the catalog lacks are parsed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import classify, entities, forensics, structure
from foliant.functions.dates import extract_dates
from foliant.functions.text import corrupt, display_name, low_entropy, strip, word_count
from foliant.operators.catalog import moved
from foliant.sources import pdf
from foliant.sources.readers import content_hash, file_id

#: A page with fewer characters is read from its picture, where a reader of pictures is at hand.
LEAST_CHARS = 50
#: Marks an encrypted payload.
SEALED = "FOLIANT1"


def needs_ocr(text: Column, always: bool = False) -> Column:
    """Too little text, damaged text or text without variety; null counts as none."""
    t = F.coalesce(text, F.lit(""))
    return F.lit(True) if always else (F.length(strip(t)) < LEAST_CHARS) | corrupt(t) | low_entropy(t)


def sealed(payload: Column, key: Column | None) -> Column:
    """AES-GCM under a 16, 24 or 32 byte key, with a mark; as it is without a key."""
    return payload if key is None else F.concat(F.lit(SEALED).cast("binary"), F.aes_encrypt(payload, key))


def opened(payload: Column, key: Column | None) -> Column:
    """The payload of sealed; one without the mark as it is; a wrong key gives null."""
    marked = F.substring(payload, 1, len(SEALED)) == F.lit(SEALED).cast("binary")
    return payload if key is None else F.when(marked, F.try_aes_decrypt(F.substring(payload, len(SEALED) + 1, 1 << 30), key)).otherwise(payload)


def new_files(files: DataFrame, known: DataFrame) -> DataFrame:
    """files (path, content) whose content no record of known (content_hash) has; of equal contents the first path.

    Hashes and paths are compared first, the contents join last: no content goes through the grouping."""
    hashed = files.select("path", content_hash(F.col("content")).alias("content_hash"))
    wanted = hashed.groupBy("content_hash").agg(F.min("path").alias("path")).join(known.select("content_hash"), "content_hash", "left_anti")
    return files.join(wanted, "path", "left_semi")


def planned(files: DataFrame, meta: DataFrame) -> DataFrame:
    """path, content_hash, status of files (path, content) against the catalog: what an ingest would do, without doing it.

    known: a record has the path and the content; moved: one has the content at another path that is no longer there, only its
    path changes; duplicate: the content is known at a path that is there, or a lesser path brings it; changed: a record has
    the path with other content; new: none of these. A run that was broken off goes on with what isn't known yet."""
    hashed = files.select("path", content_hash(F.col("content")).alias("content_hash"))
    old = meta.select(F.col("original_path").alias("path"), F.col("content_hash").alias("_old"))
    here = hashed.select(F.col("path").alias("_at")).distinct()
    kept = old.join(here, old.path == here._at, "left").groupBy(F.col("_old").alias("content_hash")).agg(F.max(F.col("_at").isNotNull()).alias("_there"))
    first = hashed.groupBy("content_hash").agg(F.min("path").alias("_first"))
    joined = hashed.join(old, "path", "left").join(kept, "content_hash", "left").join(first, "content_hash")
    status = (
        F.when(F.col("_old") == F.col("content_hash"), "known")
        .when(F.coalesce("_there", F.lit(False)) | (F.col("path") != F.col("_first")), "duplicate")
        .when(F.col("_there").isNotNull(), "moved")
        .when(F.col("_old").isNotNull(), "changed")
        .otherwise("new")
    )
    return joined.select("path", "content_hash", status.alias("status"))


def relocated(meta: DataFrame, plan: DataFrame) -> DataFrame:
    """meta with the new path and name of records whose content has moved (see planned); everything else of a record stays."""
    return moved(meta, plan.where("status = 'moved'").select("content_hash", F.col("path").alias("new_path"), display_name(F.col("path")).alias("new_name")))


def failures(scanned: DataFrame) -> DataFrame:
    """path, status, error of the files that couldn't be read, and failed pages of those that could: an ingest goes on without them."""
    lost = F.transform(F.filter("pages", lambda p: p["failed"]), lambda p: p["n"])
    return scanned.select("path", "status", "error", lost.alias("failed_pages")).where((F.col("status") != "ok") | (F.size("failed_pages") > 0))


def records(scanned: DataFrame) -> DataFrame:
    """A record for each file that could be read: identity, text, language, type, entities, anomalies, zones, kind."""
    info = lambda k: F.coalesce(F.col("info")[k], F.lit(""))
    base = scanned.where("status = 'ok'").select(
        file_id(F.col("path")).alias("id"),
        F.col("path").alias("original_path"),
        display_name(F.regexp_replace("path", "!", "/")).alias("name"),
        "num_pages", "file_size", "pages", "layers", "fields", "attachments", "xmp", "version", "n_objects",
        pdf.full_text(F.col("pages")).alias("text"),
        *[info(k).alias(k.lower()) for k in ("Title", "Author", "Creator", "Producer", "CreationDate", "ModDate")],
    )
    dated = forensics.anomalies(F.col("creationdate"), F.col("moddate"), F.col("creator"), F.col("producer"), F.col("author"))
    fonts = F.transform(F.flatten(F.transform(F.slice("pages", 1, 10), lambda p: p["fonts"])), lambda f: f["name"])
    filed = forensics.scan_anomalies(F.col("creationdate"), F.col("producer"), F.col("xmp"), F.col("version"), fonts, F.col("n_objects"), F.col("file_size"))
    per_page = lambda f: F.when(F.col("num_pages") > 0, F.aggregate("pages", F.lit(0.0), lambda a, p: a + f(p)) / F.col("num_pages")).otherwise(F.lit(0.0))
    pictures = per_page(lambda p: F.size(p["images"]))
    # a scan's one picture covers its page; places of pictures aren't read
    averages = {"chars": per_page(lambda p: F.coalesce(F.length(p["text"]), F.lit(0))), "pictures": pictures, "drawn": per_page(lambda p: F.size(p["drawings"]))}
    kind = structure.document_kind(F.col("chars"), F.col("pictures"), F.col("drawn"), F.least("pictures", F.lit(1.0)), F.col("producer"), F.col("creationdate"), F.size("fields") > 0)
    zones = structure.redactions(F.col("pages"), F.col("layers"))
    found = base.withColumns(averages | {"label": classify.document_type(F.col("text")), "dated": dated, "filed": filed})
    found = found.withColumns({"anomalies": F.concat("dated", "filed"), "kind": kind})
    return found.select(
        "id", "original_path", "name", "num_pages", "file_size", "text", "title", "author", "fields", "attachments",
        word_count(F.col("text")).alias("word_count"),
        classify.language(F.col("text")).alias("language"),
        F.col("label.label").alias("doc_type"),
        F.col("label.confidence").alias("classification_confidence"),
        entities.tags(F.col("label.label"), F.col("text")).alias("tags"),
        entities.confidentiality(F.col("text")).alias("confidentiality"),
        entities.parties(F.col("text")).alias("parties"),
        entities.money(F.col("text")).alias("monetary_values"),
        extract_dates(F.col("text")).alias("identified_dates"),
        "anomalies",
        forensics.risk_score(F.col("anomalies")).alias("risk_score"),
        zones["zones"].alias("redacted_zones"),
        zones["suspicious"].alias("redaction_suspicious"),
        F.col("kind.kind").alias("kind"),
        structure.advice(F.col("kind.kind"), F.size("attachments") > 0).alias("advice"),
        F.transform(F.filter("pages", lambda p: needs_ocr(p["text"])), lambda p: p["n"]).alias("pages_for_ocr"),
    )


def ingest(files: DataFrame, known: DataFrame) -> DataFrame:
    """records of the new_files of (path, content), with their content_hash; an attached PDF has its own path and its file's hash."""
    fresh = new_files(files, known)
    hashes = fresh.select(F.col("path").alias("_file"), content_hash(F.col("content")).alias("content_hash"))
    made = records(pdf.read_pdf(fresh)).withColumn("_file", F.regexp_extract("original_path", r"(?is)^(.*?\.pdf|[^!]*)(!|$)", 1))
    return made.join(hashes, "_file", "left").drop("_file")
