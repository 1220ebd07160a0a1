"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, with DataFrame operations only.

Each source's documents are dealt by hash into about as many blocks as the square root of its words, at any size. Its target in words becomes whole passes
over all of its blocks and a run of blocks in permuted order, the last of them in part. These block quotas are split
among the output shards by a tree: at each node the left half gets as many blocks as its shards' share, drawn without
replacement from what the node holds of all sources. Only quotas, one number a source, pass the driver."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import compact, partitions_for, stored

WEIGHTS = (1, 2, 3)
MOST_REPEATS = 3
SHARDS, SEED = 16, 20
#: Words that a partition of the written mix holds, about.
PART_WORDS = 1 << 20


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def key() -> Column:
    """A row's place in the permuted order: by its doc_id and text."""
    return F.xxhash64(F.lit(SEED), "doc_id", "text")


def source_targets(sizes: DataFrame) -> DataFrame:
    """number, source, source_size, target from (source, source_size): the share by weight, at most MOST_REPEATS times the size, excess reshared.

    With the sources in the order of cap over weight, those before the first whose share of what is left stays within its
    cap are at their caps. One row a source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("number") % len(WEIGHTS) + 1).cast("int"))
    s = sizes.withColumn("number", F.row_number().over(order) - 1).withColumn("weight", weight).withColumn("cap", F.lit(MOST_REPEATS) * F.col("source_size"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "number")
    s = s.withColumn("rank", F.row_number().over(by_cap)).withColumn("used", F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("cap"))
    s = s.withColumn("open", F.sum("weight").over(by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    s = s.withColumn("share", (F.sum("source_size").over(Window.partitionBy()) - F.col("used")) / F.col("open"))
    share = F.min(F.when(F.col("share") * F.col("weight") <= F.col("cap"), F.struct("rank", "share"))).over(Window.partitionBy())["share"]
    return s.withColumn("level", share).select("number", "source", "source_size", F.least(F.col("level") * F.col("weight"), F.col("cap").cast("double")).alias("target"))


def split_quotas(quotas: list[int], shards: int, seed: int = SEED) -> list[list[int]]:
    """Blocks of each source for each shard; rows add up to the quotas."""
    rng = np.random.Generator(np.random.PCG64(seed))
    out = np.zeros((len(quotas), shards), dtype=np.int64)

    def split(held: np.ndarray, lo: int, hi: int) -> None:
        if hi - lo == 1:
            out[:, lo] = held
            return
        mid = (lo + hi) // 2
        left = rng.multivariate_hypergeometric(held, int(held.sum()) * (mid - lo) // (hi - lo), method="marginals")
        split(left, lo, mid)
        split(held - left, mid, hi)

    if quotas:
        split(np.array(quotas, dtype=np.int64), 0, shards)
    return out.tolist()


def mix(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, key, size, source_size, target, taken, copies (array of shard, words) for each row of docs (doc_id, source, text).

    The words taken of a source are its target, rounded. A null source is a source of its own, the last; a null text has no
    words and is never taken; a tie of keys (rows equal in doc_id and text) doesn't change what is taken of them together.
    The order within a shard is the one of xxhash64(shard, key)."""
    spark = docs.sparkSession
    table, _ = stored(compact(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "source", words(F.col("text")).alias("size"), key().alias("key")), "mix-metadata")
    targets, _ = stored(source_targets(table.groupBy("source").agg(F.sum("size").alias("source_size"))), "mix-targets", 1)
    quota = F.floor(F.col("target") + 0.5).cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(quota / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rated = targets.select("*", F.greatest(F.ceil(F.sqrt("source_size")), F.lit(1)).alias("slots"), whole.alias("passes"), (quota - whole * F.col("source_size")).alias("rest"))
    placed = table.join(rated, table.source.eqNullSafe(rated.source)).drop(rated.source)
    placed = placed.withColumn("block", F.pmod(F.xxhash64(F.lit(SEED + 1), "key"), F.col("slots")))
    blocks = placed.groupBy("number", "block").agg(F.sum("size").alias("weight"), F.first("rest").alias("rest"), F.first("passes").alias("passes"))
    permuted = Window.partitionBy("number").orderBy(F.xxhash64(F.lit(SEED + 2), "number", "block"), "block")
    run = permuted.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = blocks.select("number", "block", "weight", "rest", "passes", (F.row_number().over(permuted) - 1).alias("turn"), (F.sum("weight").over(run) - F.col("weight")).alias("before"))
    blocks = blocks.withColumn("drawn", F.greatest(F.lit(0), F.least("weight", F.col("rest") - F.col("before"))))
    blocks, _ = stored(blocks.select("number", "block", "turn", "weight", "drawn", "passes"), "mix-blocks", partitions_for(docs))
    quotas = blocks.groupBy("number").agg(F.count("*").alias("all"), F.count_if(F.col("drawn") > 0).alias("some"), F.first("passes").alias("passes")).orderBy("number").collect()  # a row a source
    dealt = split_quotas([r["all"] * r["passes"] + r["some"] for r in quotas], shards)
    listed = json.dumps([{"number": r["number"], "all": r["all"], "upto": np.cumsum(d).tolist()} for r, d in zip(quotas, dealt)])
    bounds = spark.range(1).select(F.inline(F.from_json(F.lit(listed), "array<struct<number:int,all:long,upto:array<long>>>")))
    part = placed.select("doc_id", "key", "size", "source_size", "target", "number", "block").join(blocks, ["number", "block"]).join(bounds, "number")
    cut = part.where("drawn > 0 and drawn < weight")  # one block a source
    order = Window.partitionBy("number").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = cut.withColumn("extra", F.greatest(F.lit(0), F.least("size", F.col("drawn") - (F.sum("size").over(order) - F.col("size")))))
    rest = part.where("not (drawn > 0 and drawn < weight)").withColumn("extra", F.when(F.col("drawn") > 0, F.col("size")).otherwise(F.lit(0)).cast("long"))
    shard_of = lambda i: F.size(F.filter("upto", lambda c: c <= i))
    passes = F.expr("if(passes > 0 and size > 0, sequence(0L, passes - 1), array())")
    full = F.transform(passes, lambda e: F.struct(shard_of(e * F.col("all") + F.col("turn")).alias("shard"), F.col("size").alias("words")))
    last = F.array(F.struct(shard_of(F.col("passes") * F.col("all") + F.col("turn")).alias("shard"), F.col("extra").alias("words")))
    both = cut.unionByName(rest)
    return both.select("doc_id", "key", "size", "source_size", "target", (F.col("passes") * F.col("size") + F.col("extra")).alias("taken"), F.when(F.col("extra") > 0, F.concat(full, last)).otherwise(full).alias("copies"))


def mixed_documents(docs: DataFrame, shards: int = SHARDS, shard_column: str | None = None) -> DataFrame:
    """The rows of the mix: docs with all its columns, a row for each copy, by shard and in its permuted order.

    Partitions hold a range of one or more shards' order each. Of a document taken in part the text is its first words,
    single spaces between them. Rows equal in doc_id and text are taken alike, each of them. Null and wordless texts aren't
    taken; an empty table gives an empty one. Columns of docs may have any names; the shard's number is added under
    shard_column, if one is given."""
    plan = mix(docs, shards).where("taken > 0").select(F.col("doc_id").alias("plan_id"), F.col("key").alias("plan_key"), "size", "taken", "copies").dropDuplicates(["plan_id", "plan_key"])
    plan, _ = stored(plan, "mix-plan", partitions_for(docs))
    parts = max(1, -(-(plan.agg(F.sum("taken")).first()[0] or 0) // (shards * PART_WORDS)))
    column = lambda c: docs[f"`{c}`"]
    rows = docs.select(F.struct(*[column(c) for c in docs.columns]).alias("row"), docs["doc_id"].cast("long").alias("id"), docs["text"].alias("words"), key().alias("key"))
    rows = rows.join(plan, rows.id.eqNullSafe(plan.plan_id) & (rows.key == plan.plan_key)).select("row", "words", "key", "size", F.explode("copies").alias("copy"))
    cut = F.concat_ws(" ", F.slice(F.regexp_extract_all("words", F.lit(r"([^\x20\x09-\x0D]+)"), 1), 1, F.greatest(F.col("copy.words"), F.lit(1)).cast("int")))
    text = F.when(F.col("copy.words") < F.col("size"), cut).otherwise(F.col("words"))
    place = F.xxhash64("copy.shard", "key")
    rows = rows.select("row", text.alias("text"), F.col("copy.shard").alias("shard"), place.alias("place"), F.floor((place / 2.0**64 + 0.5) * parts).alias("part"))
    rows = rows.repartition("shard", "part").sortWithinPartitions("shard", "place")
    out = [F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns]
    return rows.select(*out, *([F.col("shard").alias(shard_column)] if shard_column else []))
