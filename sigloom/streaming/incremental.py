"""Incremental indexing and progress.

New or changed source files arrive in a folder; a Structured Streaming file
source picks them up and every micro-batch extracts their definitions and
appends them to the index with the batch's epoch.  A module indexed twice
keeps the rows of its latest epoch (the reference replaces the module's file),
which ``read_latest`` applies with an aggregate, not a per-module listing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..operators import extract


def module_files(spark: SparkSession, source_dir: str, extension: str,
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming ``(path, text)``: one row per source file under ``source_dir``."""
    r = spark.readStream.option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{extension}")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    # wholetext must be the keyword argument: a plain option is overridden by its default
    df = r.text(source_dir, wholetext=True)
    return df.select(F.regexp_replace(F.col("_metadata.file_path"), r"^file:(//)?", "").alias("path"),
                     F.col("value").alias("text"))


def modules_of(files: DataFrame, library: str, source_dir: str, extension: str) -> DataFrame:
    """``(library, module, path, text)``: module name = path below ``source_dir``."""
    root = source_dir.rstrip("/") + "/"
    rel = F.expr(f"substring(path, {len(root) + 1})")
    ext_re = extension.replace(".", r"\.") + "$"
    mod = F.regexp_replace(F.regexp_replace(rel, ext_re, ""), "/", ".")
    return files.select(F.lit(library).alias("library"), mod.alias("module"), "path", "text")


def index_batch(index_path: str):
    """``foreachBatch`` function: extract one micro-batch and write it as its epoch.

    An epoch is a partition of its own and is overwritten when the batch is retried."""

    def run(batch: DataFrame, epoch: int) -> None:
        # extraction runs several jobs; read the micro-batch from the source once
        mods = batch.select("library", "module", "text").persist()
        try:
            defs = extract.extract_definitions(mods).withColumn("epoch", F.lit(epoch).cast("bigint"))
            (defs.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("library", "epoch").parquet(index_path))
        finally:
            mods.unpersist()

    return run


def start_indexing(spark: SparkSession, source_dir: str, extension: str, library: str, index_path: str,
                   checkpoint_location: str, available_now: bool = True,
                   max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Index files as they arrive (``availableNow`` processes what exists, then stops)."""
    files = module_files(spark, source_dir, extension, max_files_per_trigger)
    mods = modules_of(files, library, source_dir, extension).observe(
        "progress", F.count(F.lit(1)).alias("modules"), F.sum(F.length("text")).alias("chars"))
    w = mods.writeStream.foreachBatch(index_batch(index_path)).option("checkpointLocation", checkpoint_location)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def read_latest(spark: SparkSession, index_path: str) -> DataFrame:
    """The appended index with, per (library, module), only the latest epoch's rows."""
    df = spark.read.parquet(index_path)
    latest = df.groupBy("library", "module").agg(F.max("epoch").alias("epoch"))
    return df.join(latest, ["library", "module", "epoch"], "left_semi")


class ProgressCollector(StreamingQueryListener):
    """Input rows and observed module counts of every finished micro-batch."""

    def __init__(self):
        self.batches: list[dict] = []

    def onQueryStarted(self, event):  # noqa: N802 - Spark's listener API
        pass

    def onQueryProgress(self, event):  # noqa: N802
        p = event.progress
        self.batches.append({"batch": p.batchId, "input_rows": p.numInputRows,
                             "observed": {k: v.asDict() for k, v in (p.observedMetrics or {}).items()}})

    def onQueryIdle(self, event):  # noqa: N802
        pass

    def onQueryTerminated(self, event):  # noqa: N802
        pass
