"""Structured Streaming flows: continuous ingest, audit sink, rate windows, alerts."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def watch(spark: SparkSession, path: str, schema: str, upsert, checkpoint: str) -> StreamingQuery:
    """New files below path, batch by batch, to upsert(batch, number): a batch runs again with the same number after a failure."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(path)
    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Columns of files that Spark reads whole.
FILES = "path string, modificationTime timestamp, length long, content binary"


def watch_files(spark: SparkSession, folder: str, ingest, checkpoint: str, pattern: str = "*.pdf") -> StreamingQuery:
    """New files below folder, at any depth, batch by batch, to ingest(batch of path, modificationTime, length, content; number).

    A stream sees a path once: files that are changed in place are found by changed_files."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("maxFilesPerTrigger", 64).load(folder)
    return files.writeStream.foreachBatch(ingest).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def listing(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """path, modificationTime, length of the files below folder; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).select("path", "modificationTime", "length")


def changed_files(now: DataFrame, before: DataFrame, done: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of listings of this poll and the last one, the paths to ingest, and done (path, modificationTime) as it is without files that are gone.

    A file is ingested when it is new to done or has a later time there, and its length is what it was at the last poll: one
    that is still being written waits."""
    steady = now.join(before.select("path", F.col("length").alias("_length")), "path").where("length = _length").drop("_length")
    known = done.select("path", F.col("modificationTime").alias("_done"))
    todo = steady.join(known, "path", "left").where("_done is null or modificationTime > _done").drop("_done")
    return todo, done.join(now.select("path"), "path", "left_semi")


def append_reads(log: str, reads: DataFrame) -> None:
    """Append rows of (ts, user, file_id, allowed, ip, endpoint) to the read log's JSON lines."""
    reads.withColumn("iso", F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'")).write.mode("append").json(log)


def detected(rows: DataFrame, text: str, detectors: dict) -> DataFrame:
    """rows with a struct<value, error> for each detector, a Python function of a text: one that fails on a row leaves its message there and the others go on."""
    def isolated(f):
        @F.arrow_udf("struct<value:string,error:string>")
        def run(texts: pa.Array) -> pa.Array:
            out = []
            for t in texts.to_pylist():
                try:
                    v = f(t)
                    out.append({"value": None if v is None else str(v), "error": None})
                except Exception as e:  # noqa: BLE001 - a detector may fail in any way
                    out.append({"value": None, "error": f"{type(e).__name__}: {e}"})
            return pa.array(out, pa.struct([("value", pa.string()), ("error", pa.string())]))

        return run

    return rows.withColumns({name: isolated(f)(F.col(text)) for name, f in detectors.items()})


def audit_sink(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append-only JSON lines, exactly once by the sink's log."""
    return events.writeStream.format("json").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def request_counts(events: DataFrame, at: str = "ts", who: str = "user_id", window: str = "60 seconds", late: str = "2 minutes") -> DataFrame:
    """Requests of each user in tumbling windows; state older than the watermark is dropped."""
    return events.withWatermark(at, late).groupBy(F.window(at, window), who).agg(F.count("*").alias("n"))


def new_alerts(results: DataFrame, key: list[str], at: str, late: str = "24 hours") -> DataFrame:
    """Each result once within the watermark."""
    return results.withWatermark(at, late).dropDuplicatesWithinWatermark(key)
