import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from sigloom.operators.scan import lag, row_number, running


def _skewed(spark, n=3000, seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        key = 0 if i % 3 == 0 else rnd.randint(1, 40)  # key 0 holds a third of the rows
        rows.append((key, i, rnd.randint(-5, 5)))
    return spark.createDataFrame(rows, "k int, pos int, v int")


def test_running_matches_window_on_hot_key(spark):
    df = _skewed(spark)
    out = running(df, ["k"], ["pos"], {"s": ("sum", F.col("v")), "mx": ("max", F.col("v")),
                                       "mn": ("min", F.col("v"))}, chunks=7)
    w = Window.partitionBy("k").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    ref = df.select("pos", F.sum("v").over(w).alias("s2"), F.max("v").over(w).alias("mx2"),
                    F.min("v").over(w).alias("mn2"))
    j = out.join(ref, "pos")
    assert j.count() == 3000
    assert j.where("s <> s2 OR mx <> mx2 OR mn <> mn2").count() == 0


def test_exclusive_lag_and_row_number(spark):
    df = _skewed(spark, 1200, 2)
    out = lag(df, ["k"], ["pos"], {"prev": F.col("v")})
    w = Window.partitionBy("k").orderBy("pos")
    ref = df.select("pos", F.lag("v").over(w).alias("p2"), F.row_number().over(w).alias("r2"))
    j = out.join(ref, "pos")
    assert j.where("NOT (prev <=> p2)").count() == 0
    rn = row_number(df, ["k"], ["pos"]).join(ref, "pos")
    assert rn.where("rn <> r2").count() == 0


def test_chunk_assignment_is_deterministic(spark):
    from sigloom.operators.scan import chunk_of
    df = _skewed(spark, 2000, 3)
    a = df.select("pos", chunk_of(df, ["k", "pos"], 6).alias("c")).collect()
    b = df.select("pos", chunk_of(df, ["k", "pos"], 6).alias("c")).collect()
    assert sorted(a) == sorted(b)
    assert len({r["c"] for r in a}) > 1


def test_null_keys_are_one_group(spark):
    df = spark.createDataFrame([(None, i) for i in range(40)] + [(1, 100 + i) for i in range(5)], "k int, o int")
    got = row_number(df, ["k"], ["o"]).collect()
    assert sorted(r["rn"] for r in got if r["k"] is None) == list(range(1, 41))
    assert sorted(r["rn"] for r in got if r["k"] == 1) == list(range(1, 6))
