"""Semantic search: vectors of documents and pages, best page of each document, incremental embedding with a caller's embedder."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.vectors import dot, unit
from foliant.operators.catalog import filtered

#: Characters of a text that an embedder gets; the models take no more.
MOST_CHARS = 8000


def embedded(text: Column, embed: Callable[[list[str]], np.ndarray]) -> Column:
    """array<float> of each text by embed(texts) -> (n, width), a batch at a time; null for a blank text."""

    @F.arrow_udf("array<float>")
    def vectors(texts: pa.Array) -> pa.Array:
        given = [t if t and t.strip() else None for t in texts.to_pylist()]
        full = [t for t in given if t is not None]
        made = iter(np.asarray(embed(full), dtype=np.float32).tolist() if full else [])
        return pa.array([None if t is None else next(made) for t in given], pa.list_(pa.float32()))

    return vectors(F.substring(text, 1, MOST_CHARS))


def hashed_words(width: int = 64) -> Callable[[list[str]], np.ndarray]:
    """An embedder without a model: signed hashes of words, for tests and where no model is at hand."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), width), dtype=np.float32)
        for row, t in zip(out, texts):
            for w in t.lower().split():
                h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "little")
                row[h % width] += 1 if h >> 63 else -1
        return out

    return embed


def packed(vector: Column) -> Column:
    """Little-endian 32-bit floats in a row."""

    @F.arrow_udf("binary")
    def pack(column: pa.Array) -> pa.Array:
        return pa.array([None if not x.is_valid else np.array(x.as_py(), dtype="<f4").tobytes() for x in column], pa.binary())

    return pack(vector)


def unpacked(blob: Column) -> Column:
    """The floats of packed; null where the length is no multiple of four."""

    @F.arrow_udf("array<float>")
    def unpack(column: pa.Array) -> pa.Array:
        return pa.array([None if b is None or len(b) % 4 else np.frombuffer(b, dtype="<f4").tolist() for b in column.to_pylist()], pa.list_(pa.float32()))

    return unpack(blob)


def chunks_of(vectors: DataFrame, model: str) -> DataFrame:
    """file_id, page, embedding of one model; empty and broken vectors are skipped."""
    whole = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", lambda x: x.isNull())
    return vectors.where((F.col("model") == model) & whole).select("file_id", "page", "embedding")


def lacking(texts: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """texts (file_id, ...) of documents without a vector of the model: what an incremental run has to embed."""
    return texts.join(vectors.where(F.col("model") == model).select("file_id").distinct(), "file_id", "left_anti")


def upserted(old: DataFrame, new: DataFrame, key: list[str] | None = None) -> DataFrame:
    """old with the vectors of new by (file_id, model), or another key."""
    key = key or ["file_id", "model"]
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def _scored(vectors: DataFrame, query: list[float]) -> DataFrame:
    q = unit(F.array(*[F.lit(float(x)) for x in query]))
    same = vectors.where(F.size("embedding") == len(query))
    return same.withColumn("score", dot(unit(F.col("embedding")), q)).drop("embedding")


def search_pages(chunks: DataFrame, meta: DataFrame, query: list[float], k: int = 10, doc_type: str | None = None) -> DataFrame:
    """file_id, name, page, score (6 places), rank: each document's best page (the first of equal ones), then the k best documents of the catalog."""
    allowed = (meta.where(F.col("doc_type") == doc_type) if doc_type else meta).select(F.col("id").alias("file_id"), "name")
    best = _scored(chunks, query).groupBy("file_id").agg(F.max(F.struct("score", (-F.col("page")).alias("_page"))).alias("b"))
    top = best.join(allowed, "file_id").select("file_id", "name", (-F.col("b._page")).cast("int").alias("page"), F.bround("b.score", 6).alias("score")).orderBy(F.desc("score"), "file_id").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "file_id")))  # k rows


def search_documents(vectors: DataFrame, meta: DataFrame, query: list[float], k: int = 10, **filters: str | None) -> DataFrame:
    """file_id, name, score, rank of the k best of the filtered catalog by whole-document vectors (filters: see catalog.filtered)."""
    allowed = filtered(meta, **filters).select(F.col("id").alias("file_id"), "name")
    top = _scored(vectors, query).join(allowed, "file_id").select("file_id", "name", F.bround("score", 6).alias("score")).orderBy(F.desc("score"), F.desc("file_id")).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), F.desc("file_id"))))  # k rows


def find(chunks: DataFrame, vectors: DataFrame, meta: DataFrame, query: list[float], k: int = 10) -> DataFrame:
    """search_pages, or where no page has a vector, search_documents with page null."""
    if chunks.limit(1).count():
        return search_pages(chunks, meta, query, k)
    return search_documents(vectors, meta, query, k).select("file_id", "name", F.lit(None).cast("int").alias("page"), "score", "rank")
