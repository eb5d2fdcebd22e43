"""Streaming aggregations: readStream -> windowed aggregate ->
foreachBatch appends to a table in the shared checkpoint folder.

Each micro-batch writes the rows it updated, tagged with its batch id; the
current result is the latest row per key.  A replayed batch appends the same
rows again under its batch id, which changes no latest row, so a restart after
a lost executor or driver is safe; the stream's own checkpoint tracks source offsets and state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def event_stream(spark: SparkSession, folder: str, schema: StructType, pattern: str | None = None,
                 max_files: int | None = None) -> DataFrame:
    """Parquet files arriving in ``folder`` (optionally only names matching
    ``pattern``) as a stream."""
    r = spark.readStream.schema(schema).format("parquet")
    if pattern:
        r = r.option("pathGlobFilter", pattern)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    # withWatermark needs a zoned timestamp, the files hold timestamp_ntz.
    return r.load(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def weekly_mean(events: DataFrame, value: str, key: str, watermark: str | None = None) -> DataFrame:
    """7-day tumbling windows (epoch aligned) per key: mean and count.

    Stored files may come in any order, so no row is late unless a watermark
    is asked for."""
    rows = events.withWatermark("ts", watermark) if watermark else events
    return (rows
            .groupBy(F.window("ts", "7 days").alias("w"), key)
            .agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n")))


def running_counts(events: DataFrame, key: str) -> DataFrame:
    return events.groupBy(key).agg(F.count(F.lit(1)).alias("count"))


def run_to_table(agg: DataFrame, keys: list[str], out_path: str, checkpoint: str) -> None:
    """Drive the query over everything available (``availableNow``) in update
    mode, appending each batch's updated rows to ``out_path``."""
    def upsert(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_batch", F.lit(batch_id)).write.mode("append").parquet(out_path)

    q = (agg.writeStream.outputMode("update").foreachBatch(upsert)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def latest(spark: SparkSession, out_path: str, keys: list[str]) -> DataFrame:
    """Current result: the row of the newest batch for each key."""
    df = spark.read.parquet(out_path)
    w = Window.partitionBy(*keys).orderBy(F.col("_batch").desc())
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_batch")
