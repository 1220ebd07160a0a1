"""Catalog look-ups, filters and mutations: each takes and returns whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import blank_to_null, strip
from foliant.schemas import DEFAULTS


def effective_type() -> Column:
    return F.coalesce(blank_to_null(F.col("doc_type")), F.lit(DEFAULTS["doc_type"]))


def filtered(meta: DataFrame, doc_type: str | None = None, language: str | None = None, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """All given conditions; type and language in any case, dates by the first ten characters."""
    day = F.substring(F.coalesce("indexed_at", F.lit("")), 1, 10)
    tests = [(doc_type, lambda: F.lower(effective_type()) == doc_type.lower()), (language, lambda: F.lower(F.coalesce("language", F.lit(""))) == language.lower()), (date_from, lambda: day >= date_from), (date_to, lambda: day <= date_to)]
    for given, test in tests:
        if given:
            meta = meta.where(test())
    return meta


def find(meta: DataFrame, needle: str) -> DataFrame:
    """The record of that id, else the first whose name holds the text in any case."""
    exact = F.col("id") == needle
    return meta.where(exact | F.contains(F.lower("name"), F.lit(needle.lower()))).orderBy(F.when(exact, 0).otherwise(1), "ingest_seq").limit(1)


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """new replaces old by id and keeps the first indexed_at and place."""
    both = old.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)), allowMissingColumns=True)
    by_id = Window.partitionBy("id")
    kept = both.withColumn("_last", F.max("_v").over(by_id)).withColumn("_first", F.min_by("indexed_at", "_v").over(by_id))
    return kept.where("_v = _last").withColumn("indexed_at", F.coalesce("_first", "indexed_at")).drop("_v", "_last", "_first")


def with_subject(meta: DataFrame, subjects: DataFrame) -> DataFrame:
    """meta with metadata.subject replaced for the ids of subjects (id, subject), one each; other fields of metadata stay."""
    new = subjects.select("id", F.struct(F.col("subject")).alias("_new")).dropDuplicates(["id"])
    joined = meta.join(new, "id", "left")
    changed = F.when(F.col("_new").isNotNull(), F.col("metadata").withField("subject", F.col("_new.subject"))).otherwise(F.col("metadata"))
    return joined.withColumn("metadata", changed).select(*meta.columns)


def removed(table: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return table.join(ids.select(F.col("id").alias(key)), key, "left_anti")


def clean_tags(tags: Column) -> Column:
    """Trimmed, without blanks; null when none is left."""
    t = F.filter(F.transform(tags, strip), lambda x: x != "")
    return F.when(F.size(t) > 0, t)


def moved(meta: DataFrame, found: DataFrame) -> DataFrame:
    """Records whose content was found (content_hash, new_path, new_name) elsewhere get the new path and name."""
    one = found.groupBy("content_hash").agg(F.min_by(F.struct("new_path", "new_name"), "new_path").alias("to"))
    joined = meta.join(one, "content_hash", "left")
    changed = F.col("to").isNotNull() & (F.col("to.new_path") != F.col("original_path"))
    return joined.withColumn("name", F.when(changed, F.col("to.new_name")).otherwise(F.col("name"))).withColumn("original_path", F.when(changed, F.col("to.new_path")).otherwise(F.col("original_path"))).drop("to")


def migrated(meta: DataFrame) -> DataFrame:
    """Records of any earlier layout with what they lack."""
    for name, value in DEFAULTS.items():
        meta = meta.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in meta.columns else F.lit(value))
    return meta


def last_rows(log: DataFrame, seq: str, n: int) -> DataFrame:
    """Retention: the newest n rows."""
    return log.orderBy(F.desc(seq)).limit(n)


def newest_per_key(log: DataFrame, key: str, seq: str, most: int) -> DataFrame:
    """The last row of each key, and of these the newest so many."""
    last = log.groupBy(key).agg(F.max_by(F.struct(*[c for c in log.columns if c != key]), seq).alias("r")).select(key, "r.*")
    return last.orderBy(F.desc(seq)).limit(most)


def readable(ids: DataFrame, grants: DataFrame, user: str | None, default_allow: bool) -> DataFrame:
    """ids that a user may read: a denial beats "*", which beats the list; without a record the default decides."""
    mine = grants.where(F.col("user") == user).select(F.col("allowed"), F.col("deny")).limit(1)
    joined = ids.join(F.broadcast(mine), how="left", on=F.lit(True))  # one record at most
    can = F.when(F.col("allowed").isNull() & F.col("deny").isNull(), F.lit(default_allow)).when(F.array_contains(F.coalesce("deny", F.array().cast("array<string>")), F.col("id")), F.lit(False)).when(F.array_contains("allowed", "*"), F.lit(True)).otherwise(F.coalesce(F.array_contains("allowed", F.col("id")), F.lit(False)))
    return joined.where(can).select(*ids.columns)


def integrity(meta: DataFrame, texts: DataFrame, sources: DataFrame) -> DataFrame:
    """id, status: missing_text, missing_source, changed or ok, from (id, has_text) and (id, current_hash)."""
    j = meta.select("id", "content_hash").join(texts, "id", "left").join(sources, "id", "left")
    status = F.when(F.col("has_text").isNull(), "missing_text").when(F.col("current_hash").isNull(), "missing_source").when(F.col("current_hash") != F.col("content_hash"), "changed").otherwise("ok")
    return j.select("id", status.alias("status"))
