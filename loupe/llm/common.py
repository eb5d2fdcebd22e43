"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loupe.session import ensure_checkpoint_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_folders: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch(spark: SparkSession) -> str:
    """This application's folder under the shared ``spark.checkpoint.dir``;
    removed when the driver's Python ends."""
    app = spark.sparkContext.applicationId
    if app not in _folders:
        _folders[app] = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_remove, spark, _folders[app])
    return _folders[app]


def _remove(spark: SparkSession, folder: str) -> None:
    sc = spark.sparkContext
    if sc._jsc is None:  # the session has ended already
        return
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back: the
    lineage ends there, so a lost executor costs no recomputation before it.
    ``batch_rows`` bounds the Arrow batches that its Python functions get."""
    spark, path = df.sparkSession, f"{scratch(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    usual = spark.conf.get(ARROW_ROWS)
    try:
        if batch_rows:
            spark.conf.set(ARROW_ROWS, str(batch_rows))
        df.write.parquet(path)
    finally:
        spark.conf.set(ARROW_ROWS, usual)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only, leave every other character."""
    return F.translate(c, UPPER, LOWER)


def let(x: Column, f) -> Column:
    """``f`` of ``x``, with ``x`` evaluated once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def crc_fold(c: Column, n: int) -> Column:
    return F.crc32(c.cast("string").cast("binary")) % F.lit(n)


def _star(sym: DataFrame, larger: bool) -> DataFrame:
    low = sym.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    if larger:
        out = sym.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = sym.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v")))
    return out.where("u <> v")


def _stars(e: DataFrame) -> bool:
    """Whether every larger id has one edge and none is also a smaller one."""
    ends = e.select(F.col("u").alias("id"), F.lit(1).alias("n")).unionByName(e.select(F.col("v").alias("id"), F.lit(0).alias("n")))
    bad = ends.groupBy("id").agg(F.sum("n").alias("n"), F.min("n").alias("least")).where("n > 1 or (n = 1 and least = 0)")
    return bad.isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """``(a, b)`` links -> ``(id, component)`` for every linked id, the
    component being its smallest id.

    Alternates large-star and small-star contraction on the edge table until
    it is stars; per round only that answer reaches the driver, and a vertex
    with very many links is summed map-side before each join."""
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e = written(e, "cc")
    while not _stars(e):
        sym = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(sym, True)  # repeats are dropped once a round, after both
        e = written(_star(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), False).distinct(), "cc")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
