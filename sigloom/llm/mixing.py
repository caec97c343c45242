"""Mixing sources to target weights by temperature; DataFrame functions only.

A source's weight is its share of all tokens to the power of an exponent between 0 (all sources alike) and 1
(shares as they are), normalised. The exponent is bisected: the largest one that reaches the target entropy
(a fraction of the largest possible), raised until no source repeats its documents more than ``max_repeats``
times. Each round of the bisection is an aggregate over the table of sources, which stays distributed; four
levels are decided by one job.

The token budget is by default the smallest that uses every document of every source at least once; a budget
may be given. A source's documents follow each other in the order of a hash, repeated as often as its quota
needs; a document that begins below the quota is used. The stream is laid out in blocks of ``block_tokens``, each with its
weights' share of every source, and within a block documents are in the order of another hash.

Running sums are taken in two levels, over hash ranges of about ``RANGE_ROWS`` documents and within a range, so a
source with a third of all rows is many tasks.

Tokens of a document are its words between white space and one for its end. Defined results: null and empty
texts count 1; a null source is a source of its own. Repeated rows are documents of their own. Rows without
``doc_id`` are ordered by the hash of their text. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import store

RANGE_ROWS, LEVELS, ROUNDS = 2_000, 4, 8


def token_counts(text: str = "text"):
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"\S+")).cast("long") + 1


def source_key(source: str = "source"):
    """Tells a null source from every string."""
    return F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("-"))


def _bisect(sources: DataFrame, measure, holds) -> float:
    """The point of [0, 1] where ``holds`` turns, to 2^-32; ``measure(exponent)`` is a list of aggregates.

    ``holds(values)`` must be true below the point and false above it."""
    lo, hi, points = 0.0, 1.0, 2 ** LEVELS
    for _ in range(ROUNDS):
        grid = [lo + (hi - lo) * i / points for i in range(1, points)]
        row = sources.agg(*[a.alias(f"m{i}_{j}") for i, x in enumerate(grid) for j, a in enumerate(measure(x))]).first()
        a, b = 0, points  # LEVELS bisections on the values at hand
        while b - a > 1:
            mid = (a + b) // 2
            values = [row[f"m{mid - 1}_{j}"] for j in range(len(measure(grid[mid - 1])))]
            a, b = (mid, b) if holds(values) else (a, mid)
        lo, hi = lo + (hi - lo) * a / points, lo + (hi - lo) * b / points
    return lo


def exponent(sources: DataFrame, target_entropy: float | None, max_repeats: float | None) -> float:
    """The exponent for ``sources(tokens)``, rounded to 6 places so that equal tables give equal mixes."""
    n, total, least, most = sources.agg(F.count("*"), F.sum("tokens"), F.min("tokens"), F.max("tokens")).first()
    if not n or n == 1 or least == most:
        return 1.0
    q = F.col("tokens") / F.lit(float(total))
    out = 1.0
    if target_entropy is not None:
        def entropy(x: float):
            p = F.pow(q, F.lit(x))
            return [F.sum(p), F.sum(p * F.log(q) * F.lit(x))]
        goal = target_entropy * math.log(n)
        out = math.floor(_bisect(sources, entropy, lambda v: math.log(v[0]) - v[1] / v[0] >= goal) * 1e6) / 1e6
    if max_repeats is not None:
        # With every document used once, a source is repeated (largest / own tokens)^(1 - exponent) times.
        def repeats(x: float):
            return [F.max(F.pow(F.lit(float(most)) / F.col("tokens"), F.lit(1 - x)))]
        limit = _bisect(sources, repeats, lambda v: v[0] > max_repeats)
        out = max(out if target_entropy is not None else 0.0, math.ceil(limit * 1e6) / 1e6)
    return min(out, 1.0)


def mix(docs: DataFrame, target_entropy: float | None = 0.95, max_repeats: float | None = 4.0, budget: int | None = None,
        block_tokens: int = 200_000, keep: list[str] | None = None, layout: bool = True) -> DataFrame:
    """One row for each use of a document: ``keep`` columns (default ``doc_id, source``) with ``tokens`` (of the
    document), ``weight`` (of its source), ``exponent``, ``epoch`` (0 for the first use), ``block`` and ``slot``
    (place in the block, from 0); kept columns of these names give way. Without ``layout`` only the ``keep`` columns."""
    given = ("tokens", "weight", "exponent", "epoch", "block", "slot") if layout else ()
    keep = [c for c in keep or ["doc_id", "source"] if c not in given]
    rows = docs.select(*keep, token_counts().alias("__t"), source_key().alias("__s"),
                       F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("t"), "text"), F.lit(""))).alias("__h"))
    sources = store(rows.groupBy("__s").agg(F.sum("__t").alias("tokens"), F.count("*").alias("rows")))
    x = exponent(sources, target_entropy, max_repeats)
    total, most = sources.agg(F.sum("tokens"), F.max("tokens")).first()
    if total is None:
        total = most = 1
    share = F.pow(F.col("tokens") / F.lit(float(total)), F.lit(x))
    norm = sources.agg(F.sum(share)).first()[0] or 1.0
    weights = sources.withColumn("weight", F.round(share / F.lit(norm), 12))
    if budget is None:
        budget = weights.agg(F.max(F.ceil(F.col("tokens") / F.col("weight")))).first()[0] or 0
    ranges = F.ceil(F.col("rows") / RANGE_ROWS)
    weights = weights.select("__s", F.col("weight").alias("__w"), F.col("tokens").alias("__all"), ranges.cast("long").alias("__ranges"),
                             F.ceil(F.col("weight") * budget).cast("long").alias("__quota"),
                             (F.col("weight") * block_tokens).alias("__per_block"))
    rows = rows.join(weights, "__s")
    # Hash ranges of a source, in the order of the hash.
    low = F.conv(F.substring("__h", 1, 10), 16, 10).cast("long")  # 40 bits of the hash
    rows = rows.withColumn("__r", F.floor(low * F.col("__ranges") / (1 << 40)))
    sums = rows.groupBy("__s", "__r").agg(F.sum("__t").alias("n"))
    sums = store(sums.select("__s", "__r", (F.sum("n").over(Window.partitionBy("__s").orderBy("__r")) - F.col("n")).alias("__base")))
    inner = Window.partitionBy("__s", "__r").orderBy("__h", "__t")
    rows = rows.join(sums, ["__s", "__r"]).withColumn(
        "__at", F.col("__base") + F.sum("__t").over(inner.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__t"))
    uses = F.ceil((F.col("__quota") - F.col("__at")) / F.col("__all"))  # epochs whose start is below the quota
    rows = rows.where(F.col("__at") < F.col("__quota")).withColumn("__e", F.explode(F.sequence(F.lit(0).cast("long"), uses - 1)))
    block = F.floor((F.col("__e") * F.col("__all") + F.col("__at")) / F.col("__per_block")).cast("long")
    if not layout:
        return rows.select(*keep)
    rows = rows.withColumn("__b", block).withColumn("__o", F.md5(F.concat_ws(":", "__h", "__e", "__b")))
    slot = F.row_number().over(Window.partitionBy("__b").orderBy("__o", "__h", "__t")) - 1
    return rows.select(*keep, F.col("__t").alias("tokens"), F.col("__w").alias("weight"), F.lit(x).alias("exponent"),
                       F.col("__e").alias("epoch"), F.col("__b").alias("block"),
                       slot.cast("long").alias("slot"))
