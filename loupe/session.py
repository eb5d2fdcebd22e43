"""Session helpers: a tuned local/cluster session and a checkpoint folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that matter at any scale: AQE re-plans joins and coalesces
# shuffle partitions at run time, skew-join splits hot partitions, and the
# session clock is pinned to UTC so date arithmetic is reproducible.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def cluster_conf(input_bytes: int, total_cores: int, target_partition_bytes: int = 256 << 20) -> dict:
    """Size shuffles and scan splits for a data volume.

    Initial shuffle partitions = max(3 x cores, input / target) so that no
    shuffle partition outgrows executor memory; AQE then coalesces small ones
    and splits skewed ones toward the advisory size.  Example: 100 TB on
    8,000 cores -> ~400,000 initial partitions of ~256 MB."""
    parts = max(3 * total_cores, int(input_bytes // target_partition_bytes) + 1)
    size = f"{target_partition_bytes >> 20}m"
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": size,
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": size,
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": f"{(4 * target_partition_bytes) >> 20}m",
        # only measured sides below this are broadcast (AQE re-checks at run time)
        "spark.sql.autoBroadcastJoinThreshold": "64m",
    }


def get_spark(master: str | None = None, app: str = "loupe",
              shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Return (or create) a session with ``DEFAULT_CONF`` applied.

    On a cluster leave ``master`` unset so the launcher decides; tests pass
    ``local[N]``.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the shared folder named by ``spark.checkpoint.dir``.

    A cluster names a shared folder there; only when it is unset (local
    tests) do we create one of our own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = tempfile.mkdtemp(prefix="loupe-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


_folders: dict[str, str] = {}


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A sub-folder of this application's own folder under the shared
    checkpoint folder; the application's folder is removed when the driver's
    Python ends."""
    app = spark.sparkContext.applicationId
    if app not in _folders:
        _folders[app] = os.path.join(ensure_checkpoint_dir(spark), f"loupe-{app}-{uuid.uuid4().hex[:8]}")
        atexit.register(_remove, spark, _folders[app])
    return os.path.join(_folders[app], name)


def _remove(spark: SparkSession, folder: str) -> None:
    sc = spark.sparkContext
    if sc._jsc is None:  # the session has ended already
        return
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back: later
    jobs start from it, its size is known to the planner, and a lost executor
    costs no recomputation before it."""
    path = scratch_dir(df.sparkSession, f"{name}-{uuid.uuid4().hex[:12]}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame) -> DataFrame:
    """A small, reused intermediate (a daily series, a design matrix), stored
    so that later jobs do not scan its source again."""
    return stored(df, "table")
