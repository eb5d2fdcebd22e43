"""Streaming queries (extensions: WIN7 and AGG6 over ``events``)."""

from __future__ import annotations

from pyspark.sql import functions as F

from loupe.plans.common import r
from loupe.plans.registry import query
from loupe.sources.files import new_scratch
from loupe.sources.tables import Tables
from loupe.streaming import windows as W


def _events_stream(spark, d):
    schema = Tables(spark, d).events.schema
    return W.event_stream(spark, d, schema, pattern="events.parquet", max_files=1)


@query("stream_weekly_mean", oracle="""
SELECT time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS window_start, event_type,
       round(avg(value), 6) AS mean, count(*) AS n
FROM events GROUP BY 1, 2""")
def stream_weekly_mean(spark, d):
    """Tumbling 7-day mean of event values per type, computed by a stream."""
    base = new_scratch(spark, "stream-weekly")
    agg = W.weekly_mean(_events_stream(spark, d), "value", "event_type")
    agg = agg.select(F.col("w.start").alias("window_start"), "event_type", "mean", "n")
    W.run_to_table(agg, ["window_start", "event_type"], f"{base}/out", f"{base}/chk")
    res = W.latest(spark, f"{base}/out", ["window_start", "event_type"])
    return res.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type",
                      r("mean").alias("mean"), "n")


@query("stream_value_counts", oracle="SELECT event_type, count(*) AS count FROM events GROUP BY 1")
def stream_value_counts(spark, d):
    """value_counts of event types maintained by a stream."""
    base = new_scratch(spark, "stream-counts")
    W.run_to_table(W.running_counts(_events_stream(spark, d), "event_type"), ["event_type"],
                   f"{base}/out", f"{base}/chk")
    return W.latest(spark, f"{base}/out", ["event_type"])
