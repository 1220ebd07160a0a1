"""Shared plumbing of the corpus operators: code shipping, scratch tables and Arrow text access."""

from __future__ import annotations


import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parents[1]

#: Rows in an Arrow batch handed to Python workers: bounds a worker's memory for texts of tens of kilobytes.
ARROW_ROWS = 1000

#: Input in a partition when small ones are read together; larger ones stay as they are.
PART_BYTES = 16 << 20

_shipped: set[str] = set()
_local_root: list[str] = []


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application, and bound Arrow batches where the user hasn't."""
    sc = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":  # Spark's own
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    if sc.applicationId in _shipped:
        return
    target = Path(tempfile.mkdtemp(prefix="foliant-")) / "foliant_code.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(PACKAGE.parent).as_posix())
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the cluster's shared folder (spark.checkpoint.dir); a local folder only where that is unset and all runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _local_root:
            _local_root.append("file://" + tempfile.mkdtemp(prefix="foliant-scratch-"))
        root = _local_root[0]
    return f"{root.rstrip('/')}/foliant/{label}-{uuid.uuid4().hex}"


def partitions_for(df: DataFrame) -> int:
    """As many partitions as the size of df's input asks for, by the optimizer's estimate, at least two for each core."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-size // PART_BYTES)), 1 << 30)  # an unknown size counts as very large


def compact(df: DataFrame, like: DataFrame | None = None) -> DataFrame:
    """df with small partitions read together: no more of them than like (or df) asks for, so that tasks, workers and files don't multiply."""
    return df.coalesce(partitions_for(df if like is None else like))


def stored(df: DataFrame, label: str, most: int | None = None) -> tuple[DataFrame, str]:
    """Write a table to the shared folder, in at most so many files, and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df = df if most is None else df.coalesce(most)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables that nothing reads any more."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lean() -> None:
    """Let a worker's Arrow memory go back to the system when it is freed; Arrow's own pool would keep it."""
    if pa.default_memory_pool().backend_name != "system":
        pa.set_memory_pool(pa.system_memory_pool())


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; null counts as empty."""
    return [b if b is not None else b"" for b in column.cast(pa.binary()).to_pylist()]


def offsets_of(lengths) -> np.ndarray:
    out = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def sliced(texts: list[bytes], limit: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """(number of the first, texts) of about limit bytes; a longer text is a slice of its own."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= limit):
            size += len(texts[end])
            end += 1
        yield at, texts[at:end]
        at = end


def cuts(data: bytes, limit: int) -> list[tuple[int, int]]:
    """Ranges that cover data, of about limit bytes, cut only at spaces (byte 32)."""
    out, at = [], 0
    while len(data) - at > limit:
        end = data.find(b" ", at + limit)
        if end < 0:
            break
        out.append((at, end))
        at = end
    return [*out, (at, len(data))]


