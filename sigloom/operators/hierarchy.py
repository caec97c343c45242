"""Tri-state roll-ups and downward propagation over path hierarchies (A1-A5)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tri_state(flag: Column) -> Column:
    """A1 aggregate: all true -> true, some true or mixed (NULL) -> NULL, else false.

    An empty group is true (the reference's empty branch)."""
    f = flag.cast("boolean")
    return (F.when(F.count(F.lit(1)) == 0, F.lit(True))
            .when(F.bool_and(F.coalesce(f, F.lit(False))), F.lit(True))
            .when(F.bool_or(F.coalesce(f, F.lit(True))), F.lit(None).cast("boolean"))
            .otherwise(F.lit(False)))


def rollup_tri_state(df: DataFrame, levels: Sequence[str], flag: Column, name: str = "state") -> DataFrame:
    """Tri-state of every branch of the hierarchy ``levels`` (and the root), from leaf flags.

    Output ``(levels..., lvl, state, n_leaves)``; ``lvl`` counts rolled-up levels
    (0 = deepest branch).  Partial aggregation keeps hot branches cheap."""
    lvl = sum((F.grouping(c) for c in levels), F.lit(0))
    return df.rollup(*levels).agg(lvl.cast("int").alias("lvl"), tri_state(flag).alias(name),
                                  F.count(F.lit(1)).alias("n_leaves"))


def path_prefixes(path: Column) -> Column:
    """All non-empty prefixes of an array path, shortest first."""
    n = F.size(path)
    ks = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.transform(ks, lambda k: F.slice(path, 1, k))


def propagate_down(leaves: DataFrame, assignments: DataFrame, leaf_id: str, path: str = "path",
                   default: bool = True) -> DataFrame:
    """A2: a value set on a branch applies to every leaf below it; the latest
    assignment (largest ``seq``) on the leaf's path wins; mixed (NULL) on a
    leaf reads as false; a leaf without any assignment gets ``default``.

    ``assignments(seq, path array<string>, enabled boolean)``.  Leaves explode
    their path prefixes and meet the assignments on an equi-join.
    """
    pref = leaves.select(leaf_id, F.explode(path_prefixes(F.col(path))).alias("__p"))
    a = assignments.select(F.col("seq").alias("__seq"), F.col(path).alias("__p"),
                           F.col("enabled").alias("__v"))
    hit = (pref.join(a, "__p").groupBy(leaf_id)
           .agg(F.max_by(F.struct(F.col("__v").alias("v")), F.col("__seq")).alias("__w")))
    return (leaves.select(leaf_id).join(hit, leaf_id, "left")
            .select(leaf_id, F.when(F.col("__w").isNull(), F.lit(default))
                    .otherwise(F.coalesce(F.col("__w.v"), F.lit(False))).alias("enabled")))


def ordered_join(values: Column, order: Column, sep: str = ", ") -> Column:
    """A4: string aggregation in a given order (``listagg ... WITHIN GROUP``)."""
    s = F.array_sort(F.collect_list(F.struct(order.alias("o"), values.alias("v"))))
    return F.array_join(F.transform(s, lambda x: x["v"]), sep)
