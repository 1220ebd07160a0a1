"""From documents to packed training sequences, each stage over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import mixing, neardup, packing, pii, quality
from foliant.llm.common import scratch_path, table

#: Stages that train, sketch or tokenise can't be put in SQL; tests compare them with brute force.
ORACLE_SQL = None


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on labels, predicts as 1; a null text is scored as an empty one."""
    net = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.keep(docs, net)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest doc_id, and of its rows one. Rows without doc_id stay."""
    keep = neardup.near_duplicates(docs).where("kept and doc_id is not null").select("doc_id").distinct()
    named = docs.join(keep, docs["doc_id"].cast("long") == keep["doc_id"], "left_semi").dropDuplicates(["doc_id"])
    return named.unionByName(docs.where(docs["doc_id"].isNull()))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by the name of its kind; n_chars follows the text; a null text stays null."""
    return pii.redacted_documents(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their weights: a row for each copy taken, in the order of the mix; texts without words aren't taken."""
    mixed = mixing.mixed_documents(docs)
    return mixed.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else mixed


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, packed in the order of the mix."""
    return packing.pack(docs)


STAGES = [("quality", drop_low_quality), ("near_duplicates", drop_near_duplicates), ("pii", redact), ("mix", mix), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
