"""Deduplication of repeated passages by hashing lines and the sentences within them, over a whole corpus.

A passage that many documents share seldom fills whole lines: it stands between other sentences. So a line is cut further
after its sentences; a repeated line is a run of repeated sentences. Units are normalised to their words and grouped by
digest over all documents; of equal units the first stays, and a later run of repeated units goes where it is long enough."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import compact, discard, lean, offsets_of, partitions_for, ship, sliced, stored, utf8
from foliant.llm.shingles import FOLD, mix, power_tables, word_hashes

#: Words that a run of repeated units needs: a passage of over 50 words may lose its first and last sentence to its neighbours.
RUN_WORDS = 30
#: A piece of a line of fewer words adds nothing to its run: "the!!" repeats by chance. A whole line counts however short.
PIECE_WORDS = 4
#: The byte before the blank after which a unit ends; None: any. A line ends after each newline, a sentence also after a blank
#: that follows one of .!?, a paragraph after two newlines in a row.
UNITS = {"sentence": b".!?", "line": b"", "paragraph": b"\n"}
#: Digests of one value among this share of all are joined by broadcast: at most so many values.
HOT = 2000

_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def cut(texts: list[bytes], unit: str = "sentence") -> dict[str, np.ndarray]:
    """The units with words of all texts: text's number, start and stop (bytes in the text), words, digest, and whether a unit is whole lines.

    A digest is of the words in lower case (A-Z), 64 bits wide."""
    at = offsets_of([len(t) + 1 for t in texts])
    data = b" ".join(texts)
    raw = np.frombuffer(data, dtype=np.uint8)
    before = np.concatenate([np.zeros(1, np.uint8), raw[:-1]]) if len(raw) else raw
    if unit == "paragraph":
        ends = np.flatnonzero((raw == 10) & (before == 10)) + 1
    else:
        ends = np.flatnonzero((raw == 10) | (_BLANK[raw] & np.isin(before, list(UNITS[unit])))) + 1
    last = at[1:] - 1
    ends = np.union1d(ends, last[last > at[:-1]])
    doc = np.searchsorted(at, ends, side="left") - 1
    inside = ends <= last[doc]  # not the blank between two texts
    ends, doc = ends[inside], doc[inside]
    starts = np.maximum(at[doc], np.concatenate([[0], ends[:-1]])) if len(ends) else ends
    place, word = word_hashes(data.translate(FOLD))
    owner = np.searchsorted(ends, place, side="right")
    n = np.bincount(owner, minlength=len(ends))
    full = np.flatnonzero(n)
    first = offsets_of(n)
    up, down = power_tables(len(word))
    total = np.zeros(len(word) + 1, dtype=np.uint64)
    np.cumsum(word * up, out=total[1:])
    digest = mix((total[first[full + 1]] - total[first[full]]) * down[first[full]] + n[full].astype(np.uint64))
    starts, ends, doc = starts[full], ends[full], doc[full]
    opens = (starts == at[doc]) | (raw[starts - 1] == 10)
    closes = (ends == last[doc]) | (raw[ends - 1] == 10)
    return {"doc": doc, "start": starts - at[doc], "stop": ends - at[doc], "words": n[full], "digest": digest.view(np.int64), "whole": opens & closes}


def _again_inside(doc: np.ndarray, digest: np.ndarray) -> np.ndarray:
    """Whether an earlier unit of the same text has the digest."""
    order = np.lexsort((np.arange(len(doc)), digest, doc))
    d, h = doc[order], digest[order]
    out = np.zeros(len(doc), dtype=bool)
    out[order[1:]] = (d[1:] == d[:-1]) & (h[1:] == h[:-1])
    return out


def _runs(units: dict[str, np.ndarray], again: np.ndarray, run_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of repeated units of enough words: text's number, start, stop and number of units."""
    i = np.flatnonzero(again)
    if not len(i):
        return i, i, i, i
    begins = np.flatnonzero(np.concatenate([[True], (np.diff(i) > 1) | (np.diff(units["doc"][i]) != 0)]))
    ends = np.concatenate([begins[1:], [len(i)]]) - 1
    counted = np.where((units["words"] >= PIECE_WORDS) | units["whole"], units["words"], 0)
    long = np.add.reduceat(counted[i], begins) >= run_words
    a, b = i[begins[long]], i[ends[long]]
    return units["doc"][a], units["start"][a], units["stop"][b], b - a + 1


def _document(doc_id: Column) -> Column:
    """Rows without doc_id are one document, the last."""
    return F.coalesce(doc_id.cast("long"), F.lit((1 << 63) - 1))


def digests(docs: DataFrame, unit: str) -> DataFrame:
    """doc, digest: each digest of a document once; docs (doc, text)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            for lo, texts in sliced(utf8(batch.column(1))):
                units = cut(texts, unit)
                fresh = ~_again_inside(units["doc"], units["digest"])
                owner = batch.column(0).take(pa.array(units["doc"][fresh] + lo))
                yield pa.RecordBatch.from_arrays([owner, pa.array(units["digest"][fresh])], names=["doc", "digest"])

    return docs.mapInArrow(rows, "doc long, digest long")


def repeated(table: DataFrame, parts: int) -> DataFrame:
    """doc, digests: of each document those that an earlier one has; table (doc, digest), each pair once for each row of docs.

    A digest that holds a large share of all rows is joined by broadcast, so no task gets all of it."""
    most = table.count() // HOT
    often = table.groupBy("digest").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.count("*").alias("n")).where("first <> last")
    often, path = stored(often, "repeats", parts)
    hot = F.broadcast(often.where(F.col("n") > most).select("digest", "first"))  # at most HOT rows
    rare = often.where(F.col("n") <= most).select("digest", "first")
    both = table.join(hot, "digest").union(table.join(hot.select("digest"), "digest", "left_anti").join(rare, "digest"))
    found = both.where("doc > first").groupBy("doc").agg(F.collect_set("digest").alias("digests"))
    found, _ = stored(found, "repeats-by-document", parts)
    discard(table.sparkSession, path)
    return found


def drop_repeats(docs: DataFrame, unit: str = "sentence", run_words: int = RUN_WORDS) -> DataFrame:
    """doc_id, n_units, n_removed, removed (array of start, stop: code points, end exclusive) and kept_text for each row of docs (doc_id, text).

    A unit (see UNITS) is repeated if an earlier document, by doc_id, has one of the same words in lower case (A-Z), or if an
    earlier unit of its own text has. Units without words count for nothing. A run of repeated units next to each other of at
    least run_words words goes, from the start of its first to the end of its last unit, original offsets in removed;
    shorter runs stay. With run_words 1 and unit line every repeated line goes. A null text has no units and stays null, an
    empty one stays empty. Rows that share a doc_id are one document, which doesn't repeat itself over rows; those without
    doc_id are one document, the last. An empty table gives an empty one; other columns are ignored."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    keyed, parts = docs.select(_document(F.col("doc_id")).alias("doc"), "doc_id", "text"), partitions_for(docs)
    table, path = stored(digests(compact(keyed.select("doc", "text")), unit), "digests")
    found = repeated(table, parts)
    discard(spark, path)

    def dropped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            for lo, texts in sliced(utf8(batch.column(1))):
                units = cut(texts, unit)
                again = _again_inside(units["doc"], units["digest"])
                edge = np.searchsorted(units["doc"], np.arange(len(texts) + 1))
                held = batch.column(2).slice(lo, len(texts))
                for i, known in enumerate(held):
                    if known.is_valid:
                        a, b = edge[i], edge[i + 1]
                        again[a:b] |= np.isin(units["digest"][a:b], known.values.to_numpy())
                doc, start, stop, many = _runs(units, again, run_words)
                removed: list[list[dict]] = [[] for _ in texts]
                kept: list[bytes | None] = list(texts)
                for i in np.unique(doc).tolist():
                    mine = doc == i
                    chars = offsets_of((np.frombuffer(texts[i], dtype=np.uint8) & 0xC0) != 0x80)
                    out, done = [], 0
                    for a, b in zip(start[mine].tolist(), stop[mine].tolist()):
                        out.append(texts[i][done:a])
                        removed[i].append({"start": int(chars[a]), "stop": int(chars[b])})
                        done = b
                    kept[i] = b"".join([*out, texts[i][done:]])
                null = batch.column(1).slice(lo, len(texts)).is_null()
                text = pa.array([None if gone else t for t, gone in zip(kept, null.to_pylist())], pa.binary()).cast(pa.string())
                counts = [np.diff(edge), np.bincount(doc, many, len(texts)).astype(np.int64)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(texts)), *(pa.array(c, pa.int64()) for c in counts), pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), text], names="doc_id n_units n_removed removed kept_text".split())

    joined = keyed.join(found, "doc", "left").select("doc_id", "text", "digests")
    return joined.coalesce(parts).mapInArrow(dropped, "doc_id long, n_units long, n_removed long, removed array<struct<start:long,stop:long>>, kept_text string")
