"""K-d tree sharding by bytes, with DataFrame operations only."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.llm.common import compact, discard, stored

#: Steps into which a dimension's range in a node, and the tie order within a step, are cut when a median is sought.
STEPS = 1 << 16
#: Hash of source, hash of lang, logarithm of size, doc_id.
DIMENSIONS = 4


def metadata(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, uid, tie and dims of docs (doc_id, text, lang, source)."""
    raw = F.col("text").cast("binary")
    unit = lambda c: F.shiftrightunsigned(F.xxhash64(c), 33) / float(1 << 31)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "source", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"), F.coalesce(F.crc32(raw), F.lit(0)).cast("long").alias("text_crc32"))
    docs = docs.withColumn("uid", F.monotonically_increasing_id())
    dims = F.array(unit("source"), unit("lang"), F.log2("size") / 64, F.coalesce(F.col("doc_id").cast("double"), F.lit(0.0)))
    return docs.select("doc_id", "size", "text_crc32", "uid", F.shiftrightunsigned(F.xxhash64("uid"), 48).cast("int").alias("tie"), dims.alias("dims"))


def _nodes(spark: SparkSession, nodes: list[dict]) -> DataFrame:
    """A row for each node that is split: at most as many as there are shards."""
    kind = "array<struct<first:int,shards:int,dim:int,low:double,high:double,goal:double,step:int,tie_step:int>>"
    return F.broadcast(spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(nodes)), kind))))


def _stepped(table: DataFrame, nodes: list[dict], how: str = "inner") -> DataFrame:
    """table with its node's row and the step of each row along the node's dimension."""
    value = F.element_at("dims", F.col("dim") + 1)
    step = F.when(F.col("high") > F.col("low"), F.least(F.floor((value - F.col("low")) / (F.col("high") - F.col("low")) * STEPS), F.lit(STEPS - 1)).cast("int")).otherwise(F.lit(0))
    return table.join(_nodes(table.sparkSession, nodes), F.col("node") == F.col("first"), how).withColumn("at", step)


def _crossing(hist: DataFrame, nodes: list[dict]) -> dict[int, tuple[int, float, float]]:
    """For each node the bucket in which its cumulative weight passes the goal: (bucket, weight before, weight in it)."""
    w = Window.partitionBy("node").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = hist.withColumn("run", F.sum("weight").over(w)).join(_nodes(hist.sparkSession, nodes).select("first", "goal"), F.col("node") == F.col("first"))
    first = run.where(F.col("run") > F.col("goal")).groupBy("node").agg(F.min(F.struct("bucket", "run", "weight")).alias("x"))
    return {r.node: (r.x.bucket, float(r.x.run - r.x.weight), float(r.x.weight)) for r in first.collect()}  # a row a node


def kd_tree(table: DataFrame, shards: int) -> DataFrame:
    """table with node: its shard. Nodes are split in the proportion of their shards at weighted medians of their widest dimension, level by level.

    A level reads the table three times, writes it once with its new nodes, so that plans don't grow with the tree, and brings
    a row a node to the driver; histograms have STEPS rows a node at most."""
    spark = table.sparkSession
    low, high = table.agg(F.min(F.col("dims")[3]), F.max(F.col("dims")[3])).first()
    span = [1.0, 1.0, 1.0, (high - low) if low is not None and high > low else 1.0]  # doc_id's range is a share of the table's
    table, columns, path = table.withColumn("node", F.lit(0)), table.columns, None
    level = {0: shards} if shards > 1 else {}
    while level:
        edges = [f(F.col("dims")[d]).alias(f"{name}{d}") for d in range(DIMENSIONS) for name, f in (("low", F.min), ("high", F.max))]
        nodes = []
        for r in table.groupBy("node").agg(F.sum("size").alias("weight"), *edges).collect():  # a row a node
            if n := level.get(r.node):
                dim = max(range(DIMENSIONS), key=lambda d: ((r[f"high{d}"] - r[f"low{d}"]) / span[d], -d))
                nodes.append({"first": r.node, "shards": n, "dim": dim, "low": r[f"low{dim}"], "high": r[f"high{dim}"], "goal": r.weight * (n // 2) / n})
        if not nodes:  # an empty table
            break
        steps = _stepped(table, nodes).groupBy("node", F.col("at").alias("bucket")).agg(F.sum("size").alias("weight"))
        found = _crossing(steps, nodes)
        for x in nodes:
            x["step"], before, _ = found[x["first"]]
            x["goal"] -= before  # what the step itself must bring
        inside = _stepped(table, nodes).where("at = step").groupBy("node", F.col("tie").alias("bucket")).agg(F.sum("size").alias("weight"))
        ties, level = _crossing(inside, nodes), {}
        for x in nodes:
            tie, before, weight = ties[x["first"]]
            x["tie_step"] = tie if x["goal"] - before < weight / 2 else tie + 1
            half = x["shards"] // 2
            level |= {m: k for m, k in ((x["first"], half), (x["first"] + half, x["shards"] - half)) if k > 1}
        right = F.col("first").isNotNull() & ((F.col("at") > F.col("step")) | ((F.col("at") == F.col("step")) & (F.col("tie") >= F.col("tie_step"))))
        split = _stepped(table, nodes, "left").select(*columns, F.when(right, F.col("node") + F.floor(F.col("shards") / 2).cast("int")).otherwise(F.col("node")).alias("node"))
        (table, at), old = stored(split, "shard-level"), path
        path = at
        discard(spark, *([old] if old else []))
    return table


def kd_shards(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for each row of docs (doc_id, text, lang, source): shards of near equal bytes.

    Any column may be null; an empty or null text weighs 8 bytes; equal rows are told apart by their place in the scan, so
    a source, language or text that holds most of the table is cut like any other range. slot counts from 0 in each shard:
    by partition of the scan, then by place. Other columns are ignored."""
    table, _ = stored(metadata(compact(docs)), "shard-metadata")
    placed = kd_tree(table, shards).select("doc_id", "size", "text_crc32", "uid", F.shiftright("uid", 33).alias("part"), F.col("node").alias("shard"))
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("shard", "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("shard", "part").orderBy("uid")) - 1
    return placed.withColumn("within", within).join(before, ["shard", "part"]).select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("within")).cast("long").alias("slot"))
