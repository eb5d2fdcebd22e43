"""Access to the test tables (one parquet file per table)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events "
          "documents embeddings pages benchmark labels conversations").split()


# Tables whose rows carry long texts: per-row work (regular expressions,
# tokenising, HTML parsing) dominates, so they must be spread over all cores.
TEXT_TABLES = {"documents", "pages", "conversations", "benchmark"}


def spread_small(df: DataFrame) -> DataFrame:
    """Round-robin a scan that yields fewer partitions than the cluster has
    cores (one small file with a single row group is one task).  On large
    inputs the scan already has more splits than cores and this is a no-op;
    filters and column pruning are pushed below the repartition."""
    target = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(target) if df.rdd.getNumPartitions() < target else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table; column pruning and filters reach the parquet scan."""
    if name not in TABLES:
        raise KeyError(f"unknown table {name!r}")
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread_small(df) if name in TEXT_TABLES else df


class Tables:
    """Attribute access to the tables of one scale-factor directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return table(self.spark, self.sf_dir, name)
        raise AttributeError(name)
