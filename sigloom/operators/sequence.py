"""Sequence operators over ordered ``(key, order, value)`` tables (Q1-Q10).

Row forms work on exploded sequences and use the skew-safe ``running`` scan;
first-match / leading-run questions are answered with aggregates (partial,
map-side) instead of windows.  Array forms work inside one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import lag, running


def _ostruct(order: Sequence[str]) -> Column:
    return F.struct(*[F.col(o) for o in order])


# ---------------------------------------------------------------- Q1 split
def split_segments(df: DataFrame, by: Sequence[str], order: Sequence[str], is_delim: Column,
                   keep_delim: bool = False) -> DataFrame:
    """Label every element with its segment number ``seg`` (0-based).

    Delimiters are dropped (or, with ``keep_delim``, start the next segment).
    """
    r = running(df.withColumn("__d", is_delim.cast("boolean")), by, order,
                {"__nd": ("sum", F.col("__d").cast("int"))})
    if keep_delim:
        return r.withColumn("seg", F.col("__nd")).drop("__d", "__nd")
    return r.where(~F.col("__d")).withColumn("seg", F.col("__nd")).drop("__d", "__nd")


def segments(df: DataFrame, by: Sequence[str], order: Sequence[str], is_delim: Column,
             id_col: str, keep_delim: bool = False) -> DataFrame:
    """One row per segment ``(by, seg, n_items, first_<id>, last_<id>)``.

    Like the reference split: every delimiter closes a segment (so empty
    leading and middle segments are reported), a trailing segment only when it
    is not empty.
    """
    by = list(by)
    r = running(df.withColumn("__d", is_delim.cast("boolean")), by, order,
                {"__nd": ("sum", F.col("__d").cast("int"))})
    closed = r.where(F.col("__d")).select(*by, (F.col("__nd") - 1).alias("seg"))
    member = r.where(~F.col("__d") | F.lit(keep_delim)).withColumn("seg", F.col("__nd"))
    o = _ostruct(order)
    stats = member.groupBy(*by, "seg").agg(
        F.count(F.lit(1)).alias("n_items"),
        F.min_by(F.col(id_col), o).alias(f"first_{id_col}"),
        F.max_by(F.col(id_col), o).alias(f"last_{id_col}"))
    keys = closed.unionByName(stats.select(*by, "seg")).distinct()
    return (keys.join(stats, [*by, "seg"], "left")
            .select(*by, "seg", F.coalesce("n_items", F.lit(0)).cast("bigint").alias("n_items"),
                    f"first_{id_col}", f"last_{id_col}"))


# ---------------------------------------------------------------- Q5 nesting
def nesting_depth(df: DataFrame, by: Sequence[str], order: Sequence[str], opens: Column,
                  closes: Column, name: str = "depth") -> DataFrame:
    """Nesting level after each element (an opener counts at its own position)."""
    step = opens.cast("int") - closes.cast("int")
    return running(df, by, order, {name: ("sum", step)})


def balanced(depth: Column) -> Column:
    return depth == 0


# ---------------------------------------------------------------- Q2/Q3/Q4
def first_match(df: DataFrame, by: Sequence[str], order: Sequence[str], pred: Column,
                value: str, name: str = "first") -> DataFrame:
    """``(by, <name>_value, <name>_pos)``: first element satisfying ``pred`` and its 0-based
    position; groups without a match are absent."""
    by = list(by)
    o = _ostruct(order)
    hit = (df.where(pred).groupBy(*by)
           .agg(F.min(o).alias("__fo"), F.min_by(F.col(value), o).alias(f"{name}_value")))
    before = (df.join(hit.select(*by, "__fo"), by).where(o < F.col("__fo"))
              .groupBy(*by).agg(F.count(F.lit(1)).alias("__n")))
    return (hit.join(before, by, "left")
            .select(*by, f"{name}_value",
                    F.coalesce("__n", F.lit(0)).cast("bigint").alias(f"{name}_pos")))


def leading_run(df: DataFrame, by: Sequence[str], order: Sequence[str], pred: Column,
                name: str = "run") -> DataFrame:
    """``(by, name)``: length of the leading run of elements satisfying ``pred``."""
    by = list(by)
    o = _ostruct(order)
    stop = df.where(~pred | pred.isNull()).groupBy(*by).agg(F.min(o).alias("__fo"))
    sized = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__all"))
    before = (df.join(stop, by).where(o < F.col("__fo")).groupBy(*by)
              .agg(F.count(F.lit(1)).alias("__n")))
    return (sized.join(stop, by, "left").join(before, by, "left")
            .select(*by, F.when(F.col("__fo").isNull(), F.col("__all"))
                    .otherwise(F.coalesce("__n", F.lit(0))).cast("bigint").alias(name)))


# ---------------------------------------------------------------- Q6/Q7/Q8
def with_previous(df: DataFrame, by: Sequence[str], order: Sequence[str],
                  cols: dict[str, Column]) -> DataFrame:
    """Q6: previous element's values next to the current one."""
    return lag(df, by, order, cols)


def all_of(*preds: Column) -> Column:
    """Q7: conjunction where every constraint sees every element (no short-circuit state)."""
    out = F.lit(True)
    for p in preds:
        out = out & p
    return out


def value_is(col: str, value) -> Column:
    """Q8 value-equality constraint."""
    return F.col(col) == F.lit(value)


# ---------------------------------------------------------------- array forms
def array_find(arr: Column, pred) -> Column:
    """Q2 on an array: first element satisfying ``pred`` or NULL."""
    return F.get(F.filter(arr, pred), 0)


def array_find_index(arr: Column, pred) -> Column:
    """Q3 on an array: 0-based index of the first match or NULL."""
    idx = F.filter(F.transform(arr, lambda x, i: F.when(pred(x), i)), lambda i: i.isNotNull())
    return F.get(idx, 0)


def array_leading_run(arr: Column, pred) -> Column:
    """Q4 on an array: length of the leading run satisfying ``pred``."""
    first_bad = array_find_index(arr, lambda x: ~pred(x))
    return F.coalesce(first_bad, F.size(arr))


def array_from_end(arr: Column, n: int) -> Column:
    """Q9: element ``n`` from the end (1 = last)."""
    return F.try_element_at(arr, F.lit(-n))


def pointwise_all(x: Column, y: Column, f) -> Column:
    """``f`` holds on every pair of the common prefix of two arrays."""
    m = F.least(F.size(x), F.size(y))
    return F.forall(F.zip_with(F.slice(x, 1, m), F.slice(y, 1, m), f), lambda z: z)
