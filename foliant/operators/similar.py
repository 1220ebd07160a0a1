"""Vector search, duplicate pairs and groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.vectors import dot, unit
from foliant.storage import discard, stored


def normalized(vectors: DataFrame) -> DataFrame:
    """id, u: unit vectors, made once so that a pair costs one dot product."""
    return vectors.select("id", unit(F.col("embedding")).alias("u"))


def nearest(vectors: DataFrame, query: list[float], k: int = 10) -> DataFrame:
    """id, score (6 places), rank of the k nearest by cosine: a top-k of each task, then of these."""
    q = unit(F.array(*[F.lit(float(x)) for x in query]))
    scored = normalized(vectors).select("id", F.bround(dot(F.col("u"), q), 6).alias("score"))
    top = scored.orderBy(F.desc("score"), "id").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))  # k rows


def similar_pairs(vectors: DataFrame, threshold: float, block: int = 512) -> DataFrame:
    """a < b, similarity (4 places) of all pairs with a cosine of at least threshold, exactly.

    Vectors are dealt into blocks; pairs of blocks, as many as blocks squared over two, meet by an equi-join on their
    numbers, and a pair of blocks is one matrix product. Only pairs over the threshold leave it."""
    import numpy as np
    import pandas as pd

    n = max(1, -(-vectors.count() // block))
    dealt = normalized(vectors).withColumn("home", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    packs = dealt.groupBy("home").agg(F.collect_list(F.struct("id", "u")).alias("held"))
    right = packs.select(F.col("home").alias("to"), F.col("held").alias("other"))
    pairs = packs.select("home", "held", F.explode(F.sequence(F.lit(0), F.col("home"))).alias("to")).join(right, "to")

    def score(batches):
        for pdf in batches:
            for home, to, a, b in zip(pdf["home"], pdf["to"], pdf["held"], pdf["other"]):
                ia, ib = np.array([x["id"] for x in a]), np.array([x["id"] for x in b])
                s = np.array([x["u"] for x in a]) @ np.array([x["u"] for x in b]).T
                i, j = np.nonzero(s >= threshold - 1e-12)
                keep = ia[i] < ib[j] if home == to else ia[i] != ib[j]
                i, j = i[keep], j[keep]
                yield pd.DataFrame({"a": np.minimum(ia[i], ib[j]), "b": np.maximum(ia[i], ib[j]), "similarity": np.round(s[i, j], 4)})

    kind = dict(vectors.dtypes)["id"]
    return pairs.select("home", "to", "held", "other").mapInPandas(score, f"a {kind}, b {kind}, similarity double")


def components(pairs: DataFrame) -> DataFrame:
    """node, component (least node) by minimum labels and pointer jumping, until nothing changes.

    Each round is written to the shared folder, which cuts its lineage; the one before is deleted."""
    spark = pairs.sparkSession
    edges, _ = stored(pairs.select(F.col("a").alias("x"), F.col("b").alias("y")).union(pairs.select("b", "a")), "edges")
    labels, path = stored(edges.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.first("x")).alias("component")), "labels")
    while True:
        near = edges.join(labels, edges.y == labels.node).groupBy("x").agg(F.min("component").alias("low"))
        step = labels.join(near, labels.node == near.x).select("node", F.col("component").alias("before"), F.least("component", "low").alias("component"))
        jump = step.select(F.col("node").alias("component"), F.col("component").alias("further"))
        following, to = stored(step.join(jump, "component", "left").select("node", "before", F.coalesce("further", "component").alias("component")), "labels")
        changed = following.where("component <> before").limit(1).count()
        discard(spark, path)
        labels, path = following.select("node", "component"), to
        if not changed:
            return labels


def listed_groups(meta: DataFrame) -> DataFrame:
    """content_hash, name, nth: the members of exact_groups in the order of ingest."""
    groups = exact_groups(meta).join(meta.select("id", "name"), "id")
    return groups.select("content_hash", "name", F.row_number().over(Window.partitionBy("content_hash").orderBy("ingest_seq")).alias("nth"))


def exact_groups(meta: DataFrame) -> DataFrame:
    """content_hash, n, ingest_seq, id: a row for each record whose hash several records share; no row holds a whole group."""
    usable = meta.where(F.coalesce("content_hash", F.lit("")) != "")
    shared = usable.groupBy("content_hash").agg(F.count("*").alias("n")).where("n >= 2")
    return usable.join(shared, "content_hash").select("content_hash", "n", "ingest_seq", "id")
