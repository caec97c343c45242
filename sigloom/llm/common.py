"""Helpers shared by the operators: stored intermediate tables, checked broadcasts, components."""

from __future__ import annotations

import gc
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

# A broadcast side has rows of a few longs; so many of them are at most about 50 MB.
BROADCAST_ROWS = 1_000_000
# Characters of a plan's text that the driver keeps for each of up to 1,000 finished writes.
PLAN_TEXT = 8_000


def text_batches(spark, rows: int = 2_000) -> None:
    """Lower the session's Arrow batches to ``rows`` rows, so that batches of long texts stay small in memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def shared_path(spark, kind: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names (shared by all executors)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def store(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage and freezes the rows: a lost executor costs a re-read, never other values."""
    path = shared_path(df.sparkSession, "stored")
    with short_plan_texts(df.sparkSession):
        df.write.parquet(path)
    if heap_grown(df.sparkSession):
        settle(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def short_plan_texts(spark):
    """Cut the texts of plans to ``PLAN_TEXT`` characters, as Spark's documentation advises when they take too much
    of the driver's memory: a long chain's plans are written out anew with every finished stage and kept to the
    session's end. The session's setting is restored; a smaller one stays."""
    key = "spark.sql.maxPlanStringLength"
    given = spark.conf.get(key)
    plain = given.removesuffix("b")  # the default is given in bytes; one in a larger unit is the user's own
    spark.conf.set(key, str(min(PLAN_TEXT, int(plain))) if plain.isdigit() else given)
    try:
        yield
    finally:
        spark.conf.set(key, given)


def small(df: DataFrame, limit: int | None = None, weight=None) -> DataFrame:
    """Broadcast hint for a *stored* table when its counted size is within ``limit`` rows (``BROADCAST_ROWS``).

    ``weight`` is a column with the number of values of a row, for rows with arrays. Beyond the limit the
    table is returned as it is and the join shuffles."""
    n = df.agg(F.count("*") if weight is None else F.sum(weight + 1)).first()[0] or 0
    return F.broadcast(df) if n <= (BROADCAST_ROWS if limit is None else limit) else df


def heap_grown(spark) -> bool:
    """Whether the driver's heap takes more than a third of what it may: a long chain of jobs lets it grow with what
    finished plans left, far beyond what is in use, and only a full collection makes it smaller."""
    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    return runtime.totalMemory() > runtime.maxMemory() // 3


def settle(spark) -> None:
    """Let the driver give back what finished plans left behind: a long chain of jobs otherwise fills its heap with
    plans and broadcast copies that are no longer used, and Spark only drops shuffles and broadcasts of collected
    objects."""
    gc.collect()
    spark._jvm.java.lang.System.gc()


def row_key():
    """Tells rows apart by ``doc_id`` (null is an id of its own) and text; equal 64-bit hashes are taken as equal rows."""
    return F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(v, root)`` for every endpoint of ``edges``; root is the smallest vertex reachable.

    Every round takes the smallest label among the neighbours (an aggregate with map-side combine, so a
    vertex with very many edges is no hot task) and then follows the labels once (pointer jumping)."""
    one = edges.select(F.col(a).alias("v"), F.col(b).alias("w")).where("v <> w")
    both = store(one.unionByName(one.select(F.col("w").alias("v"), F.col("v").alias("w"))).distinct())
    label = store(both.groupBy("v").agg(F.least(F.min("w"), F.col("v")).alias("root")))
    while True:
        near = (both.join(label.select(F.col("v").alias("w"), "root"), "w")
                .groupBy("v").agg(F.min("root").alias("near")))
        step = (label.join(near, "v")
                .select("v", F.col("root").alias("old"), F.least("root", "near").alias("root")))
        jump = label.select(F.col("v").alias("root"), F.col("root").alias("far"))
        nxt = store(step.join(jump, "root", "left")
                    .select("v", "old", F.coalesce(F.least("far", "root"), "root").alias("root")))
        label = nxt.select("v", "root")
        if nxt.where("old <> root").isEmpty():
            return label
