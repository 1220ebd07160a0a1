"""Exact top-k by inner product, block at a time: blocks of vectors in bound order, until no bound can reach the kth score.

Bounds come first and alone: the maxima and minima of each block, a hundredth of its size, tell each query's best blocks. Their
scores give each query a kth score to start from, and only blocks whose bound reaches it are sent to the query at all."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import discard, lean, ship, stored

#: Vectors in a block, blocks that one task scores against one chunk of queries, and queries in such a chunk.
BLOCK, RANGE, CHUNK = 256, 16, 1024
#: Blocks whose bounds one task looks at, and blocks that a query is scored against for its first kth score.
SHELF, SEED = 1024, 2
K = 5

BLOCKS = "part int, n int, width int, ids binary, forward binary, maxima binary, minima binary"


def integers(embedding: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component x, as double; null if the vector is null or a component is null, NaN or infinite."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(embedding.isNotNull() & ~bad, F.transform(embedding, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def _matrix(vectors: list, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), dtype=np.int64)
    for row, v in zip(out, vectors):
        row[: len(v)] = v
    return out


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, v), ordered by id, to BLOCKS: the forward index of a document range with the maximum and minimum of each term."""
    from pyspark import TaskContext

    part, n, ids, vectors = TaskContext.get().partitionId(), 0, [], []

    def row() -> pa.RecordBatch:
        width = max(map(len, vectors))
        m = _matrix(vectors, width)
        cols = [[part], [n], [width], [np.array(ids, dtype=np.int64).tobytes()], [m.tobytes()], [m.max(0).tobytes()], [m.min(0).tobytes()]]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int32()] * 3 + [pa.binary()] * 4)], names="part n width ids forward maxima minima".split())

    for batch in batches:
        for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids.append(i)
            vectors.append(v)
            if len(ids) == BLOCK:
                yield row()
                n, ids, vectors = n + 1, [], []
    if ids:
        yield row()


class Ranking:
    """Best k candidates of each query: score descending, then id."""

    def __init__(self, queries: np.ndarray, k: int, least: np.ndarray | None = None):
        """least: scores that k candidates of each query reach, so that lower ones don't matter."""
        self.k, self.least = k, np.full(len(queries), -np.inf) if least is None else least.copy()
        self.query, self.id, self.score = (np.zeros(0, dtype=np.int64) for _ in range(3))

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        q, i, s = np.concatenate([self.query, query]), np.concatenate([self.id, ids]), np.concatenate([self.score, score])
        order = np.lexsort((i, -s, q))
        q, i, s = q[order], i[order], s[order]
        nth = np.arange(len(q)) - np.searchsorted(q, q)
        keep = nth < self.k
        self.query, self.id, self.score = q[keep], i[keep], s[keep]
        full = nth == self.k - 1
        self.least[q[full]] = np.maximum(self.least[q[full]], s[full])


def _exact(m: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """m in floating point, where all products with queries are whole numbers that it can hold; else as it is."""
    most = float(np.abs(m).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(1, queries.shape[1])
    return m.astype(np.float64) if most < 2.0**53 else m


def _dot(a: np.ndarray, m: np.ndarray) -> np.ndarray:
    return a.astype(m.dtype) @ m.T


def bounds_of(queries: np.ndarray, maxima: np.ndarray, minima: np.ndarray) -> np.ndarray:
    """The most that a vector of each block can score with each query: by sign, the term's maximum or minimum. Infinite where numbers are too large to be exact."""
    hi, lo = _exact(maxima, queries), _exact(minima, queries)
    if hi.dtype != np.float64 or lo.dtype != np.float64:
        return np.full((len(queries), len(maxima)), np.inf)
    return _dot(np.maximum(queries, 0), hi) + _dot(np.minimum(queries, 0), lo)


def search(queries: np.ndarray, own: np.ndarray, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], k: int, least: np.ndarray | None = None) -> tuple[Ranking, int]:
    """Blocks (ids, forward, maxima, minima) for queries with the ids own, which don't find themselves; and how often a query met a block."""
    best, met = Ranking(queries, k, least), 0
    bounds = bounds_of(queries, np.stack([p[2] for p in parts]), np.stack([p[3] for p in parts]))
    forward = [_exact(p[1], queries) for p in parts]
    order = np.argsort(-bounds, axis=1, kind="stable")
    alive = np.arange(len(queries))
    for turn in range(len(parts)):
        # a block whose bound equals the kth score may hold a smaller id
        alive = alive[bounds[alive, order[alive, turn]] >= best.least[alive]]
        if not len(alive):
            break
        met += len(alive)
        turned = order[alive, turn]
        for b in np.unique(turned).tolist():
            rows = alive[turned == b]
            score = _dot(queries[rows], forward[b])
            r, c = np.nonzero((score >= best.least[rows][:, None]) & (parts[b][0][None, :] != own[rows][:, None]))
            best.add(rows[r], parts[b][0][c], score[r, c].astype(np.int64))
    return best, met


def _grid(x: dict, column: str, rows: int, width: int) -> np.ndarray:
    """A matrix of a block's row, filled with 0 to width."""
    out = np.zeros((rows, width), dtype=np.int64)
    if x["width"]:
        out[:, : x["width"]] = np.frombuffer(x[column], dtype=np.int64).reshape(rows, -1)
    return out


def _asked(blocks_: list[dict], width: int) -> tuple[np.ndarray, np.ndarray]:
    """ids and vectors of a chunk of queries."""
    own = [np.frombuffer(x["ids"], dtype=np.int64) for x in blocks_]
    return np.concatenate(own), np.concatenate([_grid(x, "forward", len(i), width) for x, i in zip(blocks_, own)])


def _held(blocks_: list[dict], width: int) -> list[tuple]:
    ids = [np.frombuffer(x["ids"], dtype=np.int64) for x in blocks_]
    return [(i, _grid(x, "forward", len(i), width), _grid(x, "maxima", 1, width)[0], _grid(x, "minima", 1, width)[0]) for x, i in zip(blocks_, ids)]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of vectors (id, v array<long>) for each of queries (id, v), never itself.

    Rows without id or vector take no part; a row repeated as it is counts once; shorter vectors count as filled with 0.
    If a query id has several vectors, the least is the query. An empty table of either gives none. Vectors and queries are
    each cut into blocks by id. Three meetings of blocks follow: bounds with each chunk of queries, each query with its
    SEED best blocks, and each chunk with the ranges of blocks that some query of it can still use; of the last, k rows a
    query remain."""
    spark = vectors.sparkSession
    ship(spark)
    usable = lambda df: df.where("id is not null and v is not null").distinct()
    ordered = lambda df: df.repartitionByRange("id").sortWithinPartitions("id", "v").mapInArrow(blocks, BLOCKS)
    index, index_at = stored(ordered(usable(vectors)), "vector-blocks")
    asked, asked_at = stored(ordered(usable(queries).groupBy("id").agg(F.min("v").alias("v"))), "query-blocks")
    width = max(index.agg(F.max("width")).first()[0] or 1, asked.agg(F.max("width")).first()[0] or 1)
    size = asked.agg(F.max("part"), F.max("n")).first()
    most = (size[1] or 0) // (CHUNK // BLOCK) + 1  # chunks of a part at most
    chunk = (F.col("part") * most + F.floor(F.col("n") / (CHUNK // BLOCK))).cast("long")
    chunks, chunks_at = stored(asked.withColumn("chunk", chunk).groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("n", "width", "ids", "forward"))).alias("asked")), "query-chunks")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(((size[0] or 0) + 1) * most - 1).cast("long"))).alias("chunk")  # blocks of a stated query set against all blocks
    shelves = index.groupBy("part", F.floor(F.col("n") / SHELF).alias("shelf")).agg(F.array_sort(F.collect_list(F.struct("n", "width", "maxima", "minima"))).alias("bounds"))
    shelves, shelves_at = stored(shelves, "bounds")
    meeting = lambda known: shelves.select("part", "bounds", every).join(known, "chunk")

    def limits(row: dict, ask: np.ndarray) -> np.ndarray:
        grids = [np.concatenate([_grid(x, c, 1, width) for x in row["bounds"]]) for c in ("maxima", "minima")]
        return bounds_of(ask, *grids)

    def best_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                bound = limits(row, _asked(row["asked"], width)[1])
                n = np.array([x["n"] for x in row["bounds"]])
                top = np.argsort(-bound, axis=1, kind="stable")[:, :SEED]
                q = np.repeat(np.arange(len(bound)), top.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), row["chunk"]), pa.int64()), pa.array(q, pa.int32()), pa.array(np.full(len(q), row["part"]), pa.int32()), pa.array(n[top.ravel()], pa.int32()), pa.array(bound[q, top.ravel()], pa.float64())], names=["chunk", "row", "part", "n", "bound"])

    first = meeting(chunks).mapInArrow(best_blocks, "chunk long, row int, part int, n int, bound double")
    nth = F.row_number().over(Window.partitionBy("chunk", "row").orderBy(F.desc("bound"), "part", "n"))
    chosen = first.withColumn("nth", nth).where(F.col("nth") <= SEED).groupBy("part", "n", "chunk").agg(F.collect_list("row").alias("rows"))  # CHUNK rows at most
    seeds = index.select("part", "n", F.struct("width", "ids", "forward", "maxima", "minima").alias("block")).join(chosen, ["part", "n"]).join(chunks, "chunk")

    def seed_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                own, ask = _asked(row["asked"], width)
                rows = np.array(row["rows"])
                found, _ = search(ask[rows], own[rows], _held([row["block"]], width), k)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found.query), row["chunk"]), pa.int64()), pa.array(rows[found.query], pa.int32()), pa.array(found.score, pa.int64())], names=["chunk", "row", "score"])

    scored = seeds.select("chunk", "rows", "block", "asked").mapInArrow(seed_scores, "chunk long, row int, score long")
    kth = scored.withColumn("nth", F.row_number().over(Window.partitionBy("chunk", "row").orderBy(F.desc("score")))).where(F.col("nth") == k)
    least, least_at = stored(kth.groupBy("chunk").agg(F.collect_list(F.struct("row", "score")).alias("least")), "least")  # CHUNK rows at most
    known = chunks.join(least, "chunk", "left")

    def floor(row: dict, n: int) -> np.ndarray:
        out = np.full(n, -np.inf)
        for x in row["least"] or []:
            out[x["row"]] = x["score"] if abs(x["score"]) < 1 << 53 else np.nextafter(float(x["score"]), -np.inf)
        return out

    def open_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                ask = _asked(row["asked"], width)[1]
                use = (limits(row, ask) >= floor(row, len(ask))[:, None]).any(axis=0)
                ranges = np.unique(np.array([x["n"] // RANGE for x in row["bounds"]])[use])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ranges), row["chunk"]), pa.int64()), pa.array(np.full(len(ranges), row["part"]), pa.int32()), pa.array(ranges, pa.int64())], names=["chunk", "part", "range"])

    wanted = meeting(known).mapInArrow(open_ranges, "chunk long, part int, range long")
    ranges = index.groupBy("part", F.floor(F.col("n") / RANGE).alias("range")).agg(F.array_sort(F.collect_list(F.struct("n", "width", "ids", "forward", "maxima", "minima"))).alias("held"))
    pairs = wanted.join(ranges, ["part", "range"]).join(known, "chunk").select("held", "asked", "least")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                own, ask = _asked(row["asked"], width)
                found, _ = search(ask, own, _held(row["held"], width), k, floor(row, len(ask)))
                yield pa.RecordBatch.from_arrays([pa.array(own[found.query], pa.int64()), pa.array(found.id, pa.int64()), pa.array(found.score, pa.int64())], names=["query_id", "vec_id", "score"])

    found, _ = stored(pairs.mapInArrow(score, "query_id long, vec_id long, score long"), "candidates")
    discard(spark, index_at, asked_at, chunks_at, shelves_at, least_at)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
