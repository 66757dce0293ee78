"""Streams give what the batch form gives."""

from pyspark.sql import functions as F

from vellumine.streaming import jobs


def test_windows(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = jobs.event_windows(stream, late="60 days")
    q = out.writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("windows").count() == jobs.event_windows(events).count()


def test_latest_states(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "ts", F.col("user_id").alias("job_id"), F.col("event_type").alias("state"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    jobs.keep_latest(stream, str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    jobs.compacted(spark, str(tmp_path / "t"), str(tmp_path / "u"))
    want = {r.job_id: r.state for r in jobs.latest_states(events).collect()}
    for table in ("t", "u"):
        assert {r.job_id: r.state for r in jobs.current_states(spark, str(tmp_path / table)).collect()} == want
