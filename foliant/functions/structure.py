"""Expressions over what a PDF scan finds on pages: blackened zones, hidden text and layers, the kind of document, advice for its ingest."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as black and as a zone, white, the flag of invisible text; limits and producers of the kinds.
BLACK, LEAST_AREA = 0.05, 500
WHITE, INVISIBLE = 0xFFFFFF, 0x40
DIGITAL_CHARS, SCAN_COVER, OLD_DATE = 200, 0.6, r":19[0-5]\d"
OLD_PRODUCERS = ["abbyy", "archivematica", "flexicapture", "kofax", "internet archive", "google books"]
NO_ZONES = "sem redacções detectadas"


def near_black(fill: Column) -> Column:
    """One channel, or the first three, within BLACK of black; false for null and other shapes."""
    return F.coalesce(F.when(F.size(fill) == 1, F.get(fill, 0) <= BLACK).when(F.size(fill) >= 3, F.forall(F.slice(fill, 1, 3), lambda v: v <= BLACK)), F.lit(False))


def black_zones(drawings: Column) -> Column:
    area = lambda r: F.abs((F.get(r, 2) - F.get(r, 0)) * (F.get(r, 3) - F.get(r, 1)))
    return F.size(F.filter(drawings, lambda d: near_black(d["fill"]) & F.coalesce(area(d["rect"]) >= LEAST_AREA, F.lit(False))))


def invisible_chars(spans: Column) -> Column:
    """Characters of white text and of black text that isn't drawn."""
    hidden = F.filter(spans, lambda s: (s["color"] == WHITE) | ((s["color"] == 0) & (s["flags"].bitwiseAND(INVISIBLE) != 0)))
    return F.aggregate(hidden, F.lit(0), lambda a, s: a + F.coalesce(F.length(s["text"]), F.lit(0)))


def redact_marks(annotations: Column) -> Column:
    return F.size(F.filter(annotations, lambda a: a["kind"] == "Redact"))


def hidden_layers(layers: Column) -> Column:
    return F.array_distinct(F.transform(F.filter(layers, lambda v: ~v["on"] & (v["name"] != "")), lambda v: v["name"]))


def redactions(pages: Column, layers: Column) -> dict[str, Column]:
    """zones, suspicious (hidden text or marks), summary of a document's pages (drawings, spans, annotations)."""
    total = lambda f: F.aggregate(pages, F.lit(0), lambda a, p: a + f(p))
    black, chars, marks = total(lambda p: black_zones(p["drawings"])), total(lambda p: invisible_chars(p["spans"])), total(lambda p: redact_marks(p["annotations"]))
    on = F.size(F.filter(pages, lambda p: black_zones(p["drawings"]) > 0))
    hidden = hidden_layers(layers)
    word = lambda n, one, many: F.concat(n.cast("string"), F.when(n == 1, F.lit(one)).otherwise(F.lit(many)))
    names = F.array_join(F.transform(F.slice(hidden, 1, 3), lambda n: F.concat(F.lit('"'), n, F.lit('"'))), ", ")
    parts = [
        F.when(black > 0, F.concat(word(black, " zona negra", " zonas negras"), F.lit(" em "), word(on, " página", " páginas"))),
        F.when(chars > 0, F.lit("texto invisível detectado")),
        F.when(marks > 0, word(marks, " anotação /Redact", " anotações /Redact")),
        F.when(F.size(hidden) > 0, F.concat(F.lit("camada(s) OCG oculta(s): "), names, F.when(F.size(hidden) > 3, F.concat(F.lit(" (+"), (F.size(hidden) - 3).cast("string"), F.lit(" mais)"))).otherwise(F.lit("")))),
    ]
    zones = black + chars + marks + F.size(hidden)
    return {"zones": zones, "suspicious": (chars > 0) | (marks > 0), "summary": F.when(zones == 0, F.lit(NO_ZONES)).otherwise(F.concat_ws("; ", *parts))}


def document_kind(chars: Column, images: Column, drawings: Column, cover: Column, producer: Column, created: Column, forms: Column) -> Column:
    """(kind, confidence) from averages per page, the share of a page that images cover, the producer and the PDF date."""
    made = F.lit(False)
    for p in OLD_PRODUCERS:
        made = made | F.coalesce(F.lower(producer).contains(p), F.lit(False))
    historical = (made | F.coalesce(created.rlike(OLD_DATE), F.lit(False))) & (cover > 0.4)
    kind = lambda k, c: F.struct(F.lit(k).alias("kind"), F.lit(c).alias("confidence"))
    scan = (chars < 10) & (images > 0) & (cover > SCAN_COVER)
    rules = [
        (forms, kind("form", 0.9)),
        ((drawings > 20) & (chars > 50), kind("table_heavy", 0.7)),
        (historical & (chars < DIGITAL_CHARS), kind("historical_manuscript", 0.65)),
        (historical, kind("historical_print", 0.7)),
        (scan & (drawings > 5), kind("scanned_noisy", 0.7)),
        (scan, kind("scanned_clean", 0.8)),
        ((chars >= DIGITAL_CHARS) & (cover < 0.3), kind("born_digital", 0.9)),
        ((chars >= 50) & (cover >= 0.4), kind("hybrid_ocr", 0.75)),
        ((chars < 10) & (images > 0), kind("image_only", 0.6)),
        (chars > 0, kind("mixed", 0.5)),
    ]
    return F.coalesce(*[F.when(when, then) for when, then in rules], kind("unknown", 0.3))


def advice(kind: Column, attachments: Column) -> Column:
    """needs_ocr, ocr_mode and flags for the ingest of a document of that kind."""
    scanned, aged, shut = kind.isin("scanned_clean", "scanned_noisy", "image_only"), kind.isin("historical_print", "historical_manuscript"), kind.isin("password_protected", "corrupted")
    return F.struct(
        (scanned | aged).alias("needs_ocr"),
        F.when(scanned, F.lit("standard")).when(aged, F.lit("historical")).otherwise(F.lit("none")).alias("ocr_mode"),
        (kind == "form").alias("extract_forms"),
        (kind == "table_heavy").alias("extract_tables"),
        F.coalesce(attachments, F.lit(False)).alias("extract_attachments"),
        (kind == "historical_manuscript").alias("use_htr"),
        (kind == "password_protected").alias("warn_password"),
        (shut & (kind == "corrupted")).alias("warn_corrupted"),
    )
