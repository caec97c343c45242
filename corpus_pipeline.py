"""The corpus pipeline: documents through language ID, near-duplicate removal, benchmark decontamination,
mixing and sharding.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes each result as Parquet in
the shared folder of ``spark.checkpoint.dir`` and hands it to the next stage. All stages but the last return the
columns of ``documents``; the last adds ``size, text_crc32, shard, slot``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sigloom.llm import decontaminate, jaccard_join, language_id, mixing, sharding
from sigloom.llm.common import store
from sigloom.plans.tables import table

SHARDS = 24
#: Repeats of small sources that the mix may use; every document is used at least once.
MAX_REPEATS = 1.25


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 7: documents in no known language (no letters, or n-grams that no learned language covers) go."""
    return language_id.accepted(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 9: of each group of near-duplicates the document with the smallest id stays."""
    return jaccard_join.keep_first_rows(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 4: documents that hold a test item go."""
    items = decontaminate.question_and_answer(table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return decontaminate.rows_without_leaks(docs, items, whole=decontaminate.WHOLE)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 8: every document once, those of small sources repeated up to the limit."""
    return mixing.mix(docs, target_entropy=None, max_repeats=MAX_REPEATS, keep=docs.columns, layout=False)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 3: shards with row counts at most one apart."""
    return sharding.place(docs, SHARDS, keep=docs.columns)


STAGES = [("language_id", identify_language), ("jaccard_join", drop_near_duplicates),
          ("decontaminate", decontaminate_benchmark), ("mixing", mix_sources), ("sharding", shard)]

#: Language ID is a trained model, which SQL cannot express; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
