"""Tables on the cluster's shared folder: scratch tables that cut lineage, and versioned tables that are replaced as a whole."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below spark.checkpoint.dir; a local folder only where that is unset and all runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _local:
            _local.append("file://" + tempfile.mkdtemp(prefix="foliant-scratch-"))
        root = _local[0]
    return f"{root.rstrip('/')}/foliant/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """A table written and read back, and where it is: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def _filesystem(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def discard(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        fs, where = _filesystem(spark, path)
        fs.delete(where, True)


class Store:
    """Versioned tables below a folder: readers see the last complete version, a failed write leaves it as it was.

    A version is a folder of its own; its writer's _SUCCESS file, which comes last, is what makes it current. One writer a
    table at a time."""

    def __init__(self, spark: SparkSession, root: str, keep: int = 10):
        self.spark, self.root, self.keep = spark, root.rstrip("/"), keep

    def versions(self, name: str) -> list[int]:
        """Complete versions, ascending."""
        fs, where = _filesystem(self.spark, f"{self.root}/{name}")
        if not fs.exists(where):
            return []
        done = [x.getPath() for x in fs.listStatus(where)]
        return sorted(int(p.getName()[1:]) for p in done if p.getName()[1:].isdigit() and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def path(self, name: str, version: int) -> str:
        return f"{self.root}/{name}/v{version:08d}"

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """The current version, or a snapshot."""
        known = self.versions(name)
        if not known or (version is not None and version not in known):
            raise FileNotFoundError(f"{self.root}/{name}: no version {version or ''}".rstrip())
        return self.spark.read.parquet(self.path(name, version or known[-1]))

    def replace(self, name: str, df: DataFrame, partition_by: list[str] | None = None, keep: int | None = None) -> int:
        """Write df as the next version and drop all but the last keep of them; df may read the current version."""
        known = self.versions(name)
        version = (known[-1] if known else 0) + 1
        writer = df.write.mode("overwrite")  # of what an unfinished write has left
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(self.path(name, version))
        discard(self.spark, *[self.path(name, v) for v in [*known, version][: -(keep or self.keep)]])
        return version

    def ensure(self, name: str, rebuild, partition_by: list[str] | None = None) -> DataFrame:
        """The current version if it can be read, else a new one from rebuild()."""
        try:
            found = self.read(name)
            found.limit(1).collect()
        except Exception:  # noqa: BLE001 - whatever is wrong with it, the source of truth is elsewhere
            self.replace(name, rebuild(), partition_by)
            found = self.read(name)
        return found
