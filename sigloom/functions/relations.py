"""Native relations between identifiers, leaves and flat signatures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def common_suffix_len(a: Column, b: Column) -> Column:
    n = F.least(F.length(a), F.length(b))
    idx = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(idx, F.lit(0),
                       lambda k, i: F.when((k == i - 1) & (F.substring(a, -i, 1) == F.substring(b, -i, 1)), i)
                       .otherwise(k))


def related_identifier(a: Column, b: Column) -> Column:
    """``a`` and ``b`` name the same thing up to module qualification.

    Equal; or one is the other preceded by a dotted qualifier; or, after the
    last differing character, the common suffix starts with a dot.
    """
    k = common_suffix_len(a, b)
    inner = (k > 0) & (k < F.least(F.length(a), F.length(b))) & \
        (F.substring(a, -k, 1) == F.lit("."))
    return ((a == b) | F.endswith(b, F.concat(F.lit("."), a)) | F.endswith(a, F.concat(F.lit("."), b)) | inner)


def pointwise(x: Column, y: Column, f) -> Column:
    """``f`` holds for every pair of the common prefix of two arrays."""
    m = F.least(F.size(x), F.size(y))
    return F.forall(F.zip_with(F.slice(x, 1, m), F.slice(y, 1, m), f), lambda z: z)


def leaf_same(a: Column, b: Column) -> Column:
    """Leaves are the same: equal tags and values on the common prefix."""
    return pointwise(a, b, lambda x, y: (x["tag"] == y["tag"]) & (x["value"] == y["value"]))


def leaf_related(a: Column, b: Column) -> Column:
    """Leaves are related: equal tags and related identifiers on the common prefix."""
    return pointwise(a, b, lambda x, y: (x["tag"] == y["tag"]) & related_identifier(x["value"], y["value"]))


def leaves_same(qa: Column, da: Column) -> Column:
    """J5 residual for two signatures of the same shape: every leaf pair the same."""
    return (F.size(qa) == F.size(da)) & F.forall(F.zip_with(qa, da, leaf_same), lambda z: F.coalesce(z, F.lit(False)))


def flat_related(short: Column, long: Column, fits=leaf_related) -> Column:
    """The parts of ``short`` are found in order in ``long`` (``fits(part, other)``),
    the pointer not advancing after a hit."""
    n = F.size(long)
    idx = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))

    def step(i, p):
        hit = F.get(F.filter(idx, lambda j: (j >= i) & fits(p, F.element_at(long, j))), 0)
        return F.when(i.isNull(), F.lit(None).cast("int")).otherwise(hit)

    return F.aggregate(short, F.lit(1), step).isNotNull()
