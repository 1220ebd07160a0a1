"""Token-id files: tokenise, order by doc_id, write patched frame-of-reference files, read them back."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm import pfor
from foliant.llm.common import compact, lean, offsets_of, ship, stored
from foliant.llm.tokens import coder

#: A file is closed at so many ids; a longer document fills a file of its own.
FILE_IDS = 1 << 20
FILES = "part int, file int, ids_before long, n_docs long, n_ids long, payload binary"


def write_files(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """docs (doc_id, text) as a stored table of files in ascending doc_id order (part, file), nulls first.

    part is the range partition: its files hold all documents between two bounds. Null texts count as empty; rows that
    repeat a doc_id are written each, by a hash of the text; an empty table gives no files; other columns are ignored."""
    ship(docs.sparkSession)

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        lean()
        part, n, before = TaskContext.get().partitionId(), 0, 0
        names: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        ids: list[np.ndarray] = []

        def row() -> pa.RecordBatch:
            payload = pfor.write(np.concatenate(names), np.concatenate(counts), np.concatenate(ids))
            values = [[part], [n], [before], [sum(map(len, names))], [sum(map(len, ids))], [payload]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names=["part", "file", "ids_before", "n_docs", "n_ids", "payload"])

        code = coder(tokenizer)
        for batch in batches:
            got, many = code.encode_ended(batch.column(1))
            doc = np.array(batch.column(0).fill_null(int(pfor.NULL_ID)).to_numpy(zero_copy_only=False), dtype=np.int64)
            at = offsets_of(many)
            lo = 0
            while lo < len(doc):  # fill the open file as far as it goes
                space = FILE_IDS - sum(map(len, ids))
                hi = int(np.searchsorted(at, at[lo] + space, side="right")) - 1
                if hi <= lo and names:
                    yield row()
                    n, before, names, counts, ids = n + 1, before + sum(map(len, ids)), [], [], []
                    continue
                hi = min(max(hi, lo + 1), len(doc))
                names.append(doc[lo:hi])
                counts.append(many[lo:hi])
                ids.append(got[at[lo] : at[hi]])
                lo = hi
        if names:
            yield row()

    chosen = compact(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    mark = F.xxhash64("text")  # so that rows that repeat a doc_id have an order
    ordered = chosen.repartitionByRange("doc_id", mark).sortWithinPartitions("doc_id", mark)
    return stored(ordered.mapInArrow(files, FILES), "token-files")[0]


def read_files(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files alone; no files, no rows."""
    ship(files.sparkSession)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            for part, before, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                doc, many, ids = pfor.read(payload.as_py())
                at, raw = offsets_of(many), ids.astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(doc), part), pa.int32()), pa.array(doc, pa.int64(), mask=doc == pfor.NULL_ID), pa.array(at[:-1] + before, pa.int64()), pa.array(many, pa.int64()), pa.array(crc, pa.int64())],
                    names=["part", "doc_id", "start", "n_tokens", "ids_crc32"],
                )

    sizes = files.groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    # one row for each range partition
    before = sizes.select("part", F.coalesce(F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    rows = files.select("part", "ids_before", "payload").mapInArrow(documents, "part int, doc_id long, start long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(before), "part").select("doc_id", (F.col("start") + F.col("earlier")).alias("start"), "n_tokens", "ids_crc32")
