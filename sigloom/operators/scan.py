"""Skew-safe running aggregates over ordered groups.

A plain ``Window.partitionBy(key).orderBy(pos)`` sends every row of a key to
one task, so a key that holds a third of the table is scanned by one core.
``running`` cuts the ordered table ``(key, order)`` into contiguous chunks of
about equal size, scans each chunk in its own task, and stitches the chunks of
a key with a carry computed from per-chunk totals.

Chunk boundaries are a deterministic function of the data: sort keys are
sampled by hash (not by a seeded random sampler, whose seed changes between
executions), and a row's chunk is found by a binary-search ``CASE`` on its
sort key.  Every branch of the plan, and every re-execution after a lost
executor, therefore assigns a row to the same chunk.  Only keys that sit on a
chunk boundary can span chunks, so the carry table has at most ``3 * chunks``
rows and is broadcast by construction.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shuffle_partitions

_OPS = ("sum", "min", "max", "last")


def _sample_bounds(df: DataFrame, cols: list[str], n: int, per_chunk: int = 20) -> list:
    """``n - 1`` sort-key boundaries from a hash sample of about ``per_chunk * n`` rows."""
    keys = df.select(*cols)
    total = keys.count()
    k = max(1, total // max(1, per_chunk * n))
    sample = keys
    if k > 1:
        sample = keys.where(F.pmod(F.xxhash64(*[F.col(c) for c in cols]), F.lit(k)) == 0)
    rows = sample.orderBy(*cols).collect()
    if len(rows) < 2 or n < 2:
        return []
    picks = [rows[(i * len(rows)) // n] for i in range(1, n)]
    out, seen = [], set()
    for r in picks:
        t = tuple(r)
        if t not in seen:
            seen.add(t)
            out.append(t)
    return out


def chunk_of(df: DataFrame, cols: list[str], n: int) -> Column:
    """Deterministic chunk number (0..n-1) of each row in ``cols`` order."""
    bounds = _sample_bounds(df, cols, n)
    if not bounds:
        return F.lit(0)
    types = {f.name: f.dataType for f in df.schema.fields}
    key = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(cols)])

    def lit_key(b):
        return F.struct(*[F.lit(v).cast(types[c]).alias(f"k{i}") for i, (c, v) in enumerate(zip(cols, b))])

    def tree(lo: int, hi: int) -> Column:
        # number of bounds <= key, knowing it lies in [lo, hi]
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key < lit_key(bounds[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(bounds))


def _agg(op: str, c: Column, order_struct: Column | None = None) -> Column:
    if op == "sum":
        return F.sum(c)
    if op == "min":
        return F.min(c)
    if op == "max":
        return F.max(c)
    if op == "last":  # value of the latest row: max over (order, value)
        return F.max(F.struct(order_struct.alias("o"), c.alias("v")))
    raise ValueError(f"unknown running op {op!r}; expected one of {_OPS}")


def _combine(op: str, local: Column, carry: Column) -> Column:
    if op == "sum":
        return F.when(local.isNull() & carry.isNull(), F.lit(None)).otherwise(
            F.coalesce(local, F.lit(0)) + F.coalesce(carry, F.lit(0)))
    if op == "min":
        return F.least(local, carry)
    if op == "max":
        return F.greatest(local, carry)
    # last: a value inside this chunk is always later than the carry
    return F.coalesce(local, carry)


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def running(df: DataFrame, by: Sequence[str], order: Sequence[str],
            aggs: dict[str, tuple[str, Column]], *, exclusive: bool = False,
            chunks: int | None = None) -> DataFrame:
    """Add running aggregates ``aggs = {name: (op, expr)}`` per ``by`` in ``order``.

    ``op`` is ``sum``, ``min``, ``max`` or ``last``; ``exclusive`` excludes the
    current row (``last`` exclusive is ``lag``).  ``order`` must be unique
    within a group.  Equivalent to
    ``agg(expr).over(Window.partitionBy(by).orderBy(order).rowsBetween(...))``.
    """
    by, order = list(by), list(order)
    spark = df.sparkSession
    n = chunks or shuffle_partitions(spark)  # a hot key is spread over as many tasks
    tmp = {name: f"__run_in_{i}" for i, name in enumerate(aggs)}
    order_struct = F.struct(*[F.col(o) for o in order])
    base = df.select("*", *[expr.alias(tmp[name]) for name, (op, expr) in aggs.items()])
    rp = base.withColumn("__chunk", chunk_of(df, by + order, n))
    hi = Window.currentRow if not exclusive else -1
    w = (Window.partitionBy(*by, "__chunk").orderBy(*order)
         .rowsBetween(Window.unboundedPreceding, hi))
    local = rp.select("*", *[_agg(op, F.col(tmp[name]), order_struct).over(w).alias(f"__loc_{tmp[name]}")
                             for name, (op, _) in aggs.items()])

    # keys that can span chunks: first and last key of every chunk
    bounds = (rp.groupBy("__chunk")
              .agg(F.min(F.struct(*by)).alias("lo"), F.max(F.struct(*by)).alias("hi")))
    cand = (bounds.select(F.explode(F.array("lo", "hi")).alias("k"))
            .select(*[F.col("k")[b].alias(b) for b in by]).distinct())
    cand = cand.toDF(*[f"__k{i}" for i in range(len(by))])
    spans = _all([F.col(b).eqNullSafe(F.col(f"__k{i}")) for i, b in enumerate(by)])  # a null key is a group, too
    totals = (rp.join(F.broadcast(cand), spans, "left_semi")
              .groupBy(*by, "__chunk")
              .agg(*[_agg(op, F.col(tmp[name]), order_struct).alias(f"__tot_{tmp[name]}")
                     for name, (op, _) in aggs.items()]))
    wc = Window.partitionBy(*by).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*by, "__chunk", *[
        (_agg(op, F.col(f"__tot_{tmp[name]}"), None) if op != "last"
         else F.max(F.col(f"__tot_{tmp[name]}"))).over(wc).alias(f"__car_{tmp[name]}")
        for name, (op, _) in aggs.items()])

    carry = carry.withColumnsRenamed({b: f"__k{i}" for i, b in enumerate(by)}).withColumnRenamed("__chunk", "__c")
    joined = local.join(F.broadcast(carry), spans & (F.col("__chunk") == F.col("__c")), "left")
    outs = []
    for name, (op, _) in aggs.items():
        v = _combine(op, F.col(f"__loc_{tmp[name]}"), F.col(f"__car_{tmp[name]}"))
        if op == "last":
            v = v["v"]
        outs.append(v.alias(name))
    keep = [c for c in df.columns if c not in aggs]
    return joined.select(*[F.col(c) for c in keep], *outs)


def lag(df: DataFrame, by: Sequence[str], order: Sequence[str],
        cols: dict[str, Column]) -> DataFrame:
    """Previous row's value of each expression (NULL for the first row)."""
    return running(df, by, order, {k: ("last", v) for k, v in cols.items()}, exclusive=True)


def row_number(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "rn") -> DataFrame:
    """1-based position within the group, skew-safe."""
    return running(df, by, order, {name: ("sum", F.lit(1))})
