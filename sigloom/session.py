"""Session helpers: local session for tests/bench, checkpoint folder, checked broadcast."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Side of a join we are willing to ship to every executor.  Anything whose
# optimizer size estimate is above this goes through a shuffle join instead.
BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024


def local_session(master: str | None = None, partitions: int | None = None,
                  app: str = "sigloom") -> SparkSession:
    """A session tuned for local runs; on a cluster use the cluster's own session."""
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    master = master or f"local[{cpus}]"
    partitions = partitions or cpus
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.default.parallelism", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SIGLOOM_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the folder is configured by the deployment and is shared
    storage; it is only invented here (under /tmp) when it is unset, which is
    the local/test case.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    jsc = spark.sparkContext._jsc
    current = jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not conf_dir:
        conf_dir = tempfile.mkdtemp(prefix="sigloom-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    spark.sparkContext.setCheckpointDir(conf_dir)
    return conf_dir


def estimated_bytes(df: DataFrame) -> int:
    """Optimizer size estimate of a DataFrame (upper bound for file scans)."""
    try:
        return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString())
    except Exception:  # pragma: no cover - non-classic session
        return 1 << 62


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Broadcast hint only when the size estimate proves the side is small.

    Otherwise the DataFrame is returned unchanged and the planner/AQE choose a
    shuffle join (and may still convert it at runtime from real sizes).
    """
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the session's checkpoint folder (cuts lineage).

    The folder comes from ``spark.checkpoint.dir``; a local one is made only
    when the setting is absent (tests, local runs)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet beside the checkpoints and read it back (cuts lineage).

    Columns are packed, unlike a checkpoint's rows, and the shuffle files of the job that
    writes are dropped when it ends instead of staying until the driver collects its plan."""
    spark, key = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    given = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(key) if given is None else spark.conf.set(key, given)
    return spark.read.schema(df.schema).parquet(path)
