"""Packing documents into sequences, balanced by estimated attention cost."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import compact, lean, offsets_of, ship
from foliant.llm.tokens import coder

CAPACITY = 4096
#: Cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n (attention stays within a document).
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
#: Tokens that are packed together, at most CAPACITY more: the memory of a task, and at most a few short sequences for each.
WINDOW_TOKENS = 1 << 21

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cost(n):
    return LINEAR * n + QUADRATIC * n * n


def plan(lengths: list[int], capacity: int = CAPACITY) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length) for documents of given lengths.

    Whole runs of capacity tokens of a long document are sequences. What is left goes in descending order to the sequence
    of lowest cost that has room; where none has room for it whole, it is cut at the largest room. As many sequences of
    full capacity are opened as the tokens fill; the remainder fills sequences of powers of two, which need no padding."""
    sequences, rest = [], []
    for i, n in enumerate(lengths):
        full = n // capacity * capacity
        sequences += [[(i, at, capacity)] for at in range(0, full, capacity)]
        if n > full:
            rest.append((n - full, i, full))
    total = sum(r[0] for r in rest)
    sizes = [capacity] * (total // capacity) + [1 << b for b in range((total % capacity).bit_length() - 1, -1, -1) if total % capacity >> b & 1]
    room, spent = np.array(sizes, dtype=np.int64), np.zeros(len(sizes))
    bins: list[list[tuple[int, int, int]]] = [[] for _ in sizes]
    # a short sequence counts as spent by what it lacks, so that it isn't always the cheapest
    spent += cost(capacity) - cost(room.astype(float))
    for n, i, at in sorted(rest, key=lambda r: (-r[0], r[1])):
        while n:
            fits = np.flatnonzero(room >= n)
            k = int(fits[spent[fits].argmin()]) if len(fits) else int(room.argmax())
            take = min(n, int(room[k]))
            bins[k].append((i, at, take))
            room[k] -= take
            spent[k] += cost(take)
            n, at = n - take, at + take
    return sequences + bins


def pack(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """PIECES: where each run of each document's ids lies; docs (doc_id, text).

    A task tokenises its part of the scan and packs it window by window: nothing is shuffled, every id lies in one piece,
    sequence_id is unique over the tasks. A null text is empty and holds its end id alone; a null doc_id stays null; repeated
    rows are packed each; of equal lengths the earlier in the scan goes first; an empty table gives no pieces; other columns
    are ignored."""
    ship(docs.sparkSession)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        lean()
        code, n = coder(tokenizer), TaskContext.get().partitionId() << 40
        names, lengths, held = [], [], []

        def window() -> pa.RecordBatch:
            nonlocal n
            ids = np.concatenate(held).astype("<u4")
            at, out = offsets_of(lengths).tolist(), []
            for seq in plan(lengths):
                place = 0
                for i, start, length in seq:
                    lo = at[i] + start
                    out.append((names[i], start, length, zlib.crc32(ids[lo : lo + length]), lengths[i], n, place))
                    place += length
                n += 1
            cols = list(zip(*out))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        tokens = 0
        for batch in batches:
            ids, many = code.encode_ended(batch.column(1))
            at, lo = offsets_of(many), 0
            ends = at[1:]
            doc = batch.column(0).to_pylist()
            while lo < len(doc):
                hi = min(int(np.searchsorted(ends, at[lo] + WINDOW_TOKENS - tokens)) + 1, len(doc))
                names += doc[lo:hi]
                lengths += many[lo:hi].tolist()
                held.append(ids[at[lo] : at[hi]])
                tokens += int(at[hi] - at[lo])
                lo = hi
                if tokens >= WINDOW_TOKENS:
                    yield window()
                    names, lengths, held, tokens = [], [], [], 0
        if names:
            yield window()

    return compact(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(pieces, PIECES)
