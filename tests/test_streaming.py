"""Streaming: the stream's answer equals the batch answer, and a restart on
the same checkpoint neither duplicates nor loses results."""

import uuid

from pyspark.sql import functions as F

from loupe.session import scratch_dir
from loupe.streaming import windows as W
from tests.conftest import SF_SMALL


def test_stream_restart_is_idempotent(spark):
    base = scratch_dir(spark, f"test-stream-{uuid.uuid4().hex[:8]}")
    schema = spark.read.parquet(f"{SF_SMALL}/events.parquet").schema
    for _ in range(2):  # second start: same checkpoint, nothing new to read
        ev = W.event_stream(spark, SF_SMALL, schema, pattern="events.parquet", max_files=1)
        W.run_to_table(W.running_counts(ev, "event_type"), ["event_type"], f"{base}/out", f"{base}/chk")
    got = {r["event_type"]: r["count"] for r in W.latest(spark, f"{base}/out", ["event_type"]).collect()}
    batch = {r["event_type"]: r["count"] for r in
             spark.read.parquet(f"{SF_SMALL}/events.parquet").groupBy("event_type").count().collect()}
    assert got == batch


def test_weekly_windows_match_batch(spark):
    base = scratch_dir(spark, f"test-weekly-{uuid.uuid4().hex[:8]}")
    schema = spark.read.parquet(f"{SF_SMALL}/events.parquet").schema
    ev = W.event_stream(spark, SF_SMALL, schema, pattern="events.parquet")
    agg = W.weekly_mean(ev, "value", "event_type").select(F.col("w.start").alias("ws"), "event_type", "n")
    W.run_to_table(agg, ["ws", "event_type"], f"{base}/out", f"{base}/chk")
    got = {(r["ws"], r["event_type"]): r["n"] for r in W.latest(spark, f"{base}/out", ["ws", "event_type"]).collect()}
    b = (spark.read.parquet(f"{SF_SMALL}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
         .groupBy(F.window("ts", "7 days").start.alias("ws"), "event_type").count())
    assert got == {(r["ws"], r["event_type"]): r["count"] for r in b.collect()}
