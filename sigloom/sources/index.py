"""Partitioned Parquet index of definitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import broadcast_if_small, checkpoint


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def write_index(defs: DataFrame, path: str) -> None:
    """Partitioned by library, clustered by module inside files.

    The replaced unit is the module: the other modules of the libraries being
    written are read back, kept and rewritten with them; other libraries are not
    touched. A module with no definition writes nothing.
    """
    spark, defs = defs.sparkSession, checkpoint(defs)
    if _exists(spark, path):
        new = defs.select("library", "module").distinct()
        kept = (spark.read.parquet(path).join(new.select("library").distinct(), "library", "left_semi")
                .join(new, ["library", "module"], "left_anti"))
        defs = defs.unionByName(checkpoint(kept), allowMissingColumns=True)
    (defs.repartitionByRange("library", "module").sortWithinPartitions("module", "inner_path", "name")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("library").parquet(path))


def read_index(spark: SparkSession, path: str, libraries: list[str] | None = None) -> DataFrame:
    """The index; a library filter prunes partitions (directory level)."""
    df = spark.read.parquet(path)
    if libraries is not None:
        df = df.where(F.col("library").isin(libraries))
    return df


def select_modules(defs: DataFrame, selection: DataFrame) -> DataFrame:
    """Only definitions of enabled modules.

    ``selection(library, module, enabled)``; libraries without any enabled
    module contribute nothing.  The selection is one row per module and is
    broadcast only when its size estimate is small.
    """
    sel = selection.where(F.col("enabled")).select("library", "module").distinct()
    return defs.join(broadcast_if_small(sel), ["library", "module"], "left_semi")


def catalog(defs: DataFrame) -> DataFrame:
    """``(library, module, path)``: the module tree as path arrays."""
    return (defs.select("library", "module").distinct()
            .withColumn("path", F.split(F.col("module"), r"\.")))


def cached(defs: DataFrame) -> DataFrame:
    """Keep the loaded (pruned) definitions for repeated searches; call
    ``unpersist()`` and reload after the index is rewritten."""
    return defs.persist()
