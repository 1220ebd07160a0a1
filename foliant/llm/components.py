"""Connected components by alternating large-star and small-star steps over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import discard, stored


#: Nodes with more than this share of all edges are joined by broadcast: fewer than twice as many nodes.
HOT = 1000


def _star(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """edges (u, v), u > v. Links each node's greater (large) or smaller neighbours to the least of its neighbourhood.

    A node that holds a large share of the total edges gets its least by broadcast, and its edges are dealt by their other
    end, so that no task gets all of them."""
    near = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    most = total // HOT
    hot = F.broadcast(least.where(F.col("n") > most).select("u", F.col("m").alias("hot")))
    rare = least.where(F.col("n") <= most).select(F.col("u").alias("node"), F.col("m").alias("rare"))
    marked = near.join(hot, "u", "left").withColumn("key", F.when(F.col("hot").isNull(), F.col("u")).otherwise(F.xxhash64("v")))
    linked = marked.join(rare, (F.col("key") == F.col("node")) & F.col("hot").isNull(), "left").select("u", "v", F.coalesce("hot", "rare").alias("m"))
    if large:
        return linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    return linked.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, parts: int | None = None) -> tuple[DataFrame, str]:
    """(node, component): the least node reachable, for every node of an edge (u, v); self-loops and directions don't matter.

    Every round is written to the shared folder, in at most parts files; rounds grow with the logarithm of the longest path."""
    spark = edges.sparkSession
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e, path = stored(e, "edges", parts)
    state = lambda: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    mark = state()
    while True:
        nxt, to = stored(_star(_star(e, True, mark[0]), False, mark[0]), "edges", parts)
        discard(spark, path)
        e, path = nxt, to
        before, mark = mark, state()
        if mark == before:
            break
    out = e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    return out, path
