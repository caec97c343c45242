import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sigloom.functions import relations as rel
from sigloom.operators.search import _same_name


def _stated(a, b):
    """The rule, put plainly: equal; or the two differ before a common end that is the shorter name behind a dot,
    or that begins with a dot and is not all of either name."""
    if a == b:
        return True
    short, long = sorted((a, b), key=len)
    if long.endswith(short) and long[len(long) - len(short) - 1] == ".":
        return True
    ends = [a[i:] for i in range(len(a)) if a[i:] and b.endswith(a[i:])]
    longest = max(ends, key=len, default="")
    return longest[:1] == "." and len(longest) < len(a) and len(longest) < len(b)


def _pairs(spark, pairs):
    df = spark.createDataFrame(pairs, "a string, b string")
    return [r["r"] for r in df.select(rel.related_identifier(F.col("a"), F.col("b")).alias("r")).collect()]


def test_related_identifier_cases(spark):
    cases = [("f", "M.f", True), ("M.f", "N.f", True), ("ab.f", "cb.f", False), ("bf", "f", False),
             ("f", "f", True), ("M.N.f", "N.f", True), (".f", "x.f", False), ("g", "f", False)]
    assert _pairs(spark, [(a, b) for a, b, _ in cases]) == [c for _, _, c in cases]


def test_related_identifier_property(spark):
    rnd = random.Random(7)
    alpha = "ab."
    pairs = []
    for _ in range(3000):
        a = "".join(rnd.choice(alpha) for _ in range(rnd.randint(1, 5)))
        b = "".join(rnd.choice(alpha) for _ in range(rnd.randint(1, 5)))
        pairs.append((a, b))
    got = _pairs(spark, pairs)
    assert got == [_stated(a, b) for a, b in pairs]
    assert [_same_name(a, b) for a, b in pairs] == [_stated(a, b) for a, b in pairs]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.sampled_from(["A", "B", "C"]), max_size=4), st.lists(st.sampled_from(["A", "B", "C"]), max_size=4))
def test_pointwise_common_prefix(spark, x, y):
    df = spark.createDataFrame([(x, y)], "x array<string>, y array<string>")
    got = df.select(rel.pointwise(F.col("x"), F.col("y"), lambda a, b: a == b).alias("r")).first()["r"]
    assert got == all(a == b for a, b in zip(x, y))
