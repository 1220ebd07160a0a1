"""Streams give what a batch gives."""

from pyspark.sql import functions as F

from foliant.streaming import flows


def test_watch_upserts_every_file_once(spark, tmp_path):
    source = spark.range(10).selectExpr("id", "cast(id as string) as text")
    source.write.parquet(str(tmp_path / "in"))
    seen = []
    for _ in range(2):
        flows.watch(spark, str(tmp_path / "in"), "id long, text string", lambda df, n: seen.append(df.count()), str(tmp_path / "check")).awaitTermination()
    assert sum(seen) == 10


def test_request_counts(spark, tmp_path):
    events = spark.range(100).select(F.timestamp_seconds(F.col("id") * 10).alias("ts"), (F.col("id") % 3).alias("user_id"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, user_id long").parquet(str(tmp_path / "in"))
    q = flows.request_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("counts").select("window.start", "user_id", "n").collect())) == sorted(map(tuple, events.groupBy(F.window("ts", "60 seconds"), "user_id").count().select("window.start", "user_id", "count").collect()))
