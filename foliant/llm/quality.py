"""Quality classifier: a byte-level convolutional network in numpy.

Filters of WIDTH bytes run over the whole document; their responses are max-pooled over overlapping chunks (CHUNK bytes,
every CHUNK / 2), the pools of all chunks are combined by mean, maximum and minimum, and a small dense network turns them
into one probability. A filter's response is a sum of learned tables, one for each pair of neighbouring bytes under it, so
a document is scored by table look-ups."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import compact, discard, lean, offsets_of, ship, sliced, stored, utf8

WIDTH, FILTERS, EMBED, HIDDEN = 4, 16, 8, 16
HOP = 128
CHUNK = 2 * HOP
#: The fit's bounds: labelled rows at most, by a hash of doc_id, and bytes of their whole texts together.
FIT_ROWS, FIT_BYTES, EPOCHS, STEP_DOCS = 1500, 64 << 20, 14, 50
#: Bytes that are convolved together.
SLICE = 1 << 16
THRESHOLD = 0.3


def blocks_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes in a row, each text filled with 0 to whole hops with at least WIDTH - 1 of them, and the first hop of each text."""
    hops = [max(1, -(-(len(t) + WIDTH - 1) // HOP)) for t in texts]
    data = b"".join(t + bytes(n * HOP - len(t)) for t, n in zip(texts, hops))
    return np.frombuffer(data, dtype=np.uint8), offsets_of(hops)


def tails(first: np.ndarray) -> np.ndarray:
    """Places in blocks_of's bytes whose filters would reach into the next text: the last WIDTH - 1 of each text, all of them filling."""
    return (first[1:, None] * HOP - np.arange(WIDTH - 1, 0, -1)).ravel()


def pooled(hop_max: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maxima over chunks of two hops, and the first chunk of each text; a text of one hop is one chunk."""
    n = np.diff(first)
    chunks = np.maximum(n - 1, 1)
    at = offsets_of(chunks)
    left = np.arange(at[-1]) + np.repeat(first[:-1] - at[:-1], chunks)
    right = np.minimum(left + 1, np.repeat(first[1:] - 1, chunks))
    return np.maximum(hop_max[left], hop_max[right]), at


def combined(chunk: np.ndarray, at: np.ndarray) -> np.ndarray:
    n = np.diff(at)[:, None]
    mean = np.add.reduceat(chunk, at[:-1], axis=0) / n
    return np.concatenate([mean, np.maximum.reduceat(chunk, at[:-1], axis=0), np.minimum.reduceat(chunk, at[:-1], axis=0)], axis=1)


class ByteNet:
    """Weights: embedding (256, EMBED), filters (WIDTH, EMBED, FILTERS) and bias, dense layers (3 * FILTERS, HIDDEN), (HIDDEN,)."""

    def __init__(self, seed: int = 1):
        r = np.random.Generator(np.random.PCG64(seed))
        f = lambda *s, scale: (r.standard_normal(s) * scale).astype(np.float32)
        self.w = {"e": f(256, EMBED, scale=0.5), "c": f(WIDTH, EMBED, FILTERS, scale=0.4), "b": np.zeros(FILTERS, np.float32), "d": f(3 * FILTERS, HIDDEN, scale=0.2), "db": np.zeros(HIDDEN, np.float32), "o": f(HIDDEN, scale=0.3), "ob": np.zeros(1, np.float32)}
        self.prior: float | None = None

    def tables(self) -> list[np.ndarray]:
        single = np.einsum("ve,kef->kvf", self.w["e"], self.w["c"]).astype(np.float32)
        single[0] += self.w["b"]
        return [(single[k][:, None, :] + single[k + 1][None, :, :]).reshape(65536, FILTERS) for k in range(0, WIDTH, 2)]

    def _head(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.tanh(x @ self.w["d"] + self.w["db"])
        return h, 1 / (1 + np.exp(-np.clip(h @ self.w["o"] + self.w["ob"][0], -30, 30)))

    def hop_maxima(self, data: np.ndarray, first: np.ndarray, tables: list[np.ndarray], places: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Each filter's greatest response in each hop, and its place there if asked for; a slice of the bytes at a time."""
        out = np.empty((len(data) // HOP, FILTERS), dtype=np.float32)
        best = np.empty((len(data) // HOP, FILTERS), dtype=np.uint8)
        wide, tail = np.concatenate([data, np.zeros(WIDTH, np.uint8)]), tails(first)
        for lo in range(0, len(data), SLICE):
            n = min(SLICE, len(data) - lo)
            x = wide[lo : lo + n + WIDTH].astype(np.uint16)
            pair = (x[:-1] << np.uint16(8)) | x[1:]
            total = tables[0][pair[:n]]
            for k in range(1, len(tables)):
                total += tables[k][pair[2 * k : 2 * k + n]]
            a, b = np.searchsorted(tail, [lo, lo + n])
            total[tail[a:b] - lo] = -np.inf
            hops = total.reshape(-1, HOP, FILTERS)
            rows = slice(lo // HOP, (lo + n) // HOP)
            if places:
                best[rows] = hops.argmax(axis=1)
            out[rows] = hops.max(axis=1)
        return out, best

    def score(self, texts: list[bytes], tables: list[np.ndarray] | None = None) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(texts), self.prior)
        data, first = blocks_of(texts)
        return np.round(self._head(combined(*pooled(np.maximum(self.hop_maxima(data, first, tables or self.tables())[0], 0), first)))[1].astype(np.float64), 6)

    def fit(self, texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 2) -> None:
        """Adam on log loss, classes weighted half by their inverse share. One class or no rows: the share of label 1 (0.5 without rows) for every text."""
        if len(set(labels.tolist())) < 2:
            self.prior = float(labels.mean()) if len(labels) else 0.5
            return
        rng = np.random.Generator(np.random.PCG64(seed))
        weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean())) ** 0.5
        m, v, step = ({k: np.zeros_like(x) for k, x in self.w.items()} for _ in range(2)), None, 0
        m, v = m
        for epoch in range(epochs):
            order = rng.permutation(len(texts))
            for at in range(0, len(order), STEP_DOCS):
                rows = order[at : at + STEP_DOCS]
                grads = self._gradients([texts[i] for i in rows], labels[rows], weight[rows])
                step += 1
                rate = 0.01 * (1 - epoch / epochs) + 0.0005
                for k, g in grads.items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.w[k] = self.w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-7)

    def _gradients(self, texts: list[bytes], y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        data, first = blocks_of(texts)
        wide = np.concatenate([data, np.zeros(WIDTH, np.uint8)])
        hop_max, best = self.hop_maxima(data, first, self.tables(), places=True)
        active = np.maximum(hop_max, 0)
        chunk, at = pooled(active, first)
        feats = combined(chunk, at)
        h, p = self._head(feats)
        out = ((p - y) * weight / len(y)).astype(np.float32)
        g = {"o": h.T @ out, "ob": np.array([out.sum()], np.float32)}
        dh = out[:, None] * self.w["o"][None, :] * (1 - h * h)
        g["d"], g["db"] = feats.T @ dh, dh.sum(0)
        df = dh @ self.w["d"].T
        n = np.diff(at)
        doc = np.repeat(np.arange(len(n)), n)
        dchunk = df[doc, :FILTERS] / n[doc, None]
        for part, ufunc in ((1, np.maximum), (2, np.minimum)):
            hit = chunk == ufunc.reduceat(chunk, at[:-1], axis=0)[doc]
            share = np.add.reduceat(hit.astype(np.float32), at[:-1], axis=0)[doc]
            dchunk += hit * df[doc, part * FILTERS : (part + 1) * FILTERS] / share
        left = np.arange(at[-1]) + np.repeat(first[:-1] - at[:-1], n)
        right = np.minimum(left + 1, np.repeat(first[1:] - 1, n))
        dhop = np.zeros_like(active)
        use_left = active[left] >= active[right]
        np.add.at(dhop, left, dchunk * use_left)
        np.add.at(dhop, right, dchunk * ~use_left)
        dhop *= hop_max > 0
        hop, filt = np.nonzero(dhop)
        value = dhop[hop, filt]
        place = hop * HOP + best[hop, filt]
        g["b"] = np.bincount(filt, value, FILTERS).astype(np.float32)
        g["c"], g["e"] = np.zeros_like(self.w["c"]), np.zeros_like(self.w["e"])
        for k in range(WIDTH):
            byte = wide[place + k]
            table = np.bincount(byte.astype(np.int64) * FILTERS + filt, value, 256 * FILTERS).reshape(256, FILTERS).astype(np.float32)
            g["c"][k] = self.w["e"].T @ table
            g["e"] += table @ self.w["c"][k].T
        return g


def fold(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, max_bytes: int = FIT_BYTES) -> ByteNet:
    """A network fitted to the whole texts of at most rows labelled documents, none of the held-out fold.

    Rows are taken in the order of a hash of doc_id until their texts would be more than max_bytes together. A doc_id with
    several labels or texts counts by the least; labels without doc_id or quality, and those of no document, don't count; a null text
    is empty. Without labels every text scores 0.5, with labels of one class their value."""
    known = labels.where("doc_id is not null and quality is not null").where(fold() != 0).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).collect()
    quality = {r.doc_id: int(r.quality) for r in some}
    labelled, path = stored(docs.where(F.col("doc_id").isin(list(quality))).groupBy("doc_id").agg(F.min("text").alias("text")), "labelled")
    order, total, chosen = {r.doc_id: i for i, r in enumerate(some)}, 0, []
    for r in sorted(labelled.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).collect(), key=lambda r: (order[r.doc_id], r.size)):
        total += r.size
        if total <= max_bytes:
            chosen.append(r.doc_id)
    found = labelled.where(F.col("doc_id").isin(chosen)).collect()
    discard(docs.sparkSession, path)
    found.sort(key=lambda r: (r.doc_id, r.text or ""))
    net = ByteNet()
    # about as many steps for a few rows as for all
    epochs = min(4 * EPOCHS, EPOCHS * FIT_ROWS // max(1, len(found)))
    net.fit([(r.text or "").encode() for r in found], np.array([quality[r.doc_id] for r in found], dtype=np.int64), epochs)
    return net


def scores(net: ByteNet, column: pa.Array, tables: list[np.ndarray]) -> np.ndarray:
    """The score of each text of a column, about a megabyte of them at a time; a null text counts as empty."""
    return np.concatenate([np.zeros(0), *(net.score(texts, tables) for _, texts in sliced(utf8(column)))])


def score(docs: DataFrame, net: ByteNet) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs (doc_id, text): the whole text; a null text counts as empty.

    Equal texts have equal scores, whatever stands next to them. A row without doc_id isn't held out; repeated rows are
    scored each, an empty table gives an empty one, other columns are ignored."""
    ship(docs.sparkSession)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        tables = net.tables()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(net, batch.column(1), tables), pa.float64())], names=["doc_id", "score"])

    found = compact(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(scored, "doc_id long, score double")
    return found.select("doc_id", (F.coalesce(fold(), F.lit(1)) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep(docs: DataFrame, net: ByteNet) -> DataFrame:
    """The rows of docs, with all their columns whatever their names, whose text the network predicts as 1.

    As in score: a null text counts as empty, repeated rows are judged each and alike, an empty table stays empty."""
    ship(docs.sparkSession)

    @F.arrow_udf("double")
    def probability(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        lean()
        tables = net.tables()
        for some in texts:
            yield pa.array(scores(net, some, tables), pa.float64())

    return compact(docs).where(probability(F.coalesce("text", F.lit(""))) >= THRESHOLD)
