"""One query for each corpus operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import linededup, mixing, neardup, ogg, packing, pii, quality, shards, tokenfile, topk
from foliant.llm.common import table
from foliant.llm.sql import ORACLES


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op2_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards.kd_shards(table(spark, sf_dir, "documents"), 24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents")).drop("redacted")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.read_files(tokenfile.write_files(table(spark, sf_dir, "documents")))


def op6_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.describe(ogg.store(table(spark, sf_dir, "documents")))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.array_join(F.transform("copies", lambda c: c["shard"].cast("string")), ",").alias("shards"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.drop_repeats(table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("removed", lambda s: F.concat_ws(":", s["start"].cast("string"), s["stop"].cast("string"))), ",")
    return found.select("doc_id", "n_units", "n_removed", spans.alias("removed"), "kept_text")


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), topk.integers(F.col("embedding")).alias("v"))
    return topk.top_k(vectors, vectors.where("id % 50 = 0"), 5)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_quality, op2_shards, op3_near_duplicates, op4_pii, op5_token_files, op6_ogg, op7_mixing, op8_line_dedup, op9_top_k, op10_packing)
    return {f.__name__: f for f in ops} | {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
