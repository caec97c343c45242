"""Library registry, descriptors and source trees (S1-S5), plus file resolution.

Files are read by Spark's own text source (whole-file rows with the file path
taken from ``_metadata``); only the registry's list of descriptor paths -- one
line per library, configuration-sized -- passes through the driver to name
the files Spark should read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def registry(spark: SparkSession, path: str) -> DataFrame:
    """Descriptor paths, one per non-blank line of the registry file."""
    return (spark.read.text(path).select(F.trim("value").alias("descriptor_path"))
            .where(F.col("descriptor_path") != ""))


def _read_whole(spark: SparkSession, paths: list[str]) -> DataFrame:
    df = spark.read.text(paths, wholetext=True)
    return df.select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("text"))


def _strip_scheme(c):
    return F.regexp_replace(c, r"^file:(//)?", "")


def parse_descriptors(descriptors: DataFrame) -> DataFrame:
    """``(descriptor_path, text)`` -> ``(library, descriptor_path, ord, include_dir)``.

    Library name: the first line starting ``name:``, trimmed.  Include dirs:
    every line whose left-trimmed text starts ``include:``, split on spaces and
    commas, empties dropped, in order over all such lines.  Dirs are resolved
    against the descriptor's folder.
    """
    ls = descriptors.select("descriptor_path", F.posexplode(F.split("text", "\n")).alias("ln", "line"))
    ls = ls.withColumn("line", F.regexp_replace("line", "\r$", ""))
    name = (ls.where(F.col("line").startswith("name:"))
            .groupBy("descriptor_path")
            .agg(F.min_by(F.trim(F.substring("line", 6, 1 << 30)), F.col("ln")).alias("library")))
    inc = ls.where(F.ltrim("line").startswith("include:"))
    dirs = inc.select("descriptor_path", "ln",
                      F.posexplode(F.filter(F.split(F.substring(F.ltrim("line"), 9, 1 << 30), "[ ,]"),
                                            lambda x: x != "")).alias("k", "include"))
    base = F.regexp_extract(_strip_scheme(F.col("descriptor_path")), r"^(.*)/[^/]*$", 1)
    dirs = dirs.select("descriptor_path", "ln", "k",
                       F.when(F.col("include").startswith("/"), F.col("include"))
                       .otherwise(F.concat(base, F.lit("/"), F.col("include"))).alias("include_dir"))
    dirs = dirs.select("descriptor_path", "include_dir",
                       F.dense_rank().over(_w_desc_order()).alias("ord"))
    return name.join(dirs, "descriptor_path").select("library", "descriptor_path",
                                                     (F.col("ord") - 1).alias("ord"), "include_dir")


def _w_desc_order():
    from pyspark.sql import Window
    # a descriptor is one row of the registry: its include list is tiny
    return Window.partitionBy("descriptor_path").orderBy("ln", "k")


def read_libraries(spark: SparkSession, registry_path: str) -> DataFrame:
    """S1+S2: every library of a registry with its ordered include dirs."""
    paths = [r["descriptor_path"] for r in registry(spark, registry_path).collect()]
    if not paths:
        return spark.createDataFrame([], "library string, descriptor_path string, ord int, include_dir string")
    d = _read_whole(spark, paths).withColumnRenamed("file_path", "descriptor_path")
    d = d.withColumn("descriptor_path", _strip_scheme(F.col("descriptor_path")))
    return parse_descriptors(d)


def read_modules(spark: SparkSession, libraries: DataFrame, extension: str) -> DataFrame:
    """S3+S5: ``(library, module, path, text, ord)`` for every source file under
    the include dirs; the module name is the path relative to its include dir
    without the extension, separators turned into dots.  When two include dirs
    hold the same module, the later dir wins."""
    return latest_per_module(source_files(spark, libraries, extension))


def source_files(spark: SparkSession, libraries: DataFrame, extension: str) -> DataFrame:
    """S3: every source file under every include dir ``(library, ord, path, text, module)``
    (before S5 picks one file per module)."""
    libs = libraries.select("library", "ord", F.regexp_replace("include_dir", "/+$", "").alias("include_dir"))
    dirs = [r["include_dir"] for r in libs.select("include_dir").distinct().collect()]
    if not dirs:
        return spark.createDataFrame([], "library string, ord int, path string, text string, module string")
    files = (spark.read.text(dirs, wholetext=True, recursiveFileLookup=True,
                             pathGlobFilter=f"*{extension}")
             .select(_strip_scheme(F.col("_metadata.file_path")).alias("path"), F.col("value").alias("text")))
    # a file belongs to every include dir that is one of its folder prefixes: explode the
    # (depth-bounded) prefixes and equi-join, instead of a prefix-match nested loop
    parts = F.split(F.col("path"), "/")
    pref = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))),
                       lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    m = files.select("*", F.explode(pref).alias("include_dir")).join(libs, "include_dir")
    rel = F.expr("substring(path, length(include_dir) + 2)")
    ext_re = extension.replace(".", r"\.") + "$"
    return m.select("library", "ord", "path", "text",
                    F.regexp_replace(F.regexp_replace(rel, ext_re, ""), "/", ".").alias("module"))


def latest_per_module(m: DataFrame) -> DataFrame:
    """One row per (library, module), the one from the highest ``ord``."""
    best = m.groupBy("library", "module").agg(
        F.max_by(F.struct("path", "text", "ord"), F.col("ord")).alias("b"))
    return best.select("library", "module", "b.path", "b.text", "b.ord")


def resolve_files(defs: DataFrame, libraries: DataFrame, files: DataFrame, extension: str) -> DataFrame:
    """Definition -> source file: the library's include dirs in order, the
    first one holding ``module/as/path + extension``; unmatched rows carry an error.

    ``files(path)`` is a listing of existing files (e.g. from ``read_modules``
    or a binary-file listing).
    """
    key = defs.select("library", "module").distinct()
    cand = key.join(libraries.select("library", "ord", "include_dir"), "library")
    cand = cand.withColumn("path", F.concat(F.regexp_replace("include_dir", "/+$", ""), F.lit("/"),
                                            F.replace(F.col("module"), F.lit("."), F.lit("/")), F.lit(extension)))
    hit = cand.join(files.select("path").distinct(), "path", "left_semi")
    first = hit.groupBy("library", "module").agg(F.min_by("path", F.col("ord")).alias("source_path"))
    known = libraries.select("library").distinct().withColumn("__known", F.lit(True))
    out = defs.join(first, ["library", "module"], "left").join(known, "library", "left")
    return out.withColumn("error", F.when(F.col("__known").isNull(), F.lit("unknown library"))
                          .when(F.col("source_path").isNull(), F.lit("file not found"))).drop("__known")
