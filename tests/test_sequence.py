from pyspark.sql import functions as F

from sigloom.operators import sequence


def _seq(spark, rows):
    return spark.createDataFrame(rows, "id int, pos int, v string")


def _segments(spark, values, keep=False):
    df = _seq(spark, [(1, i, v) for i, v in enumerate(values)])
    out = sequence.segments(df, ["id"], ["pos"], F.col("v") == "|", "pos", keep_delim=keep)
    return [(r["seg"], r["n_items"]) for r in out.orderBy("seg").collect()]


def test_split_leading_middle_trailing(spark):
    # leading empty kept, empty middle kept, empty trailing dropped
    assert _segments(spark, ["|", "a", "|", "|", "b", "|"]) == [(0, 0), (1, 1), (2, 0), (3, 1)]
    assert _segments(spark, ["a", "b"]) == [(0, 2)]
    assert _segments(spark, ["|", "|"]) == [(0, 0), (1, 0)]


def test_split_keeps_delimiter(spark):
    assert _segments(spark, ["a", "|", "b"], keep=True) == [(0, 1), (1, 2)]


def test_nesting_goes_negative(spark):
    df = _seq(spark, [(1, i, v) for i, v in enumerate(["(", "x", ")", ")", "("])])
    out = sequence.nesting_depth(df, ["id"], ["pos"], F.col("v") == "(", F.col("v") == ")")
    assert [r["depth"] for r in out.orderBy("pos").collect()] == [1, 1, 0, -1, 0]


def test_first_match_and_leading_run(spark):
    df = _seq(spark, [(1, 0, "a"), (1, 1, "b"), (1, 2, "x"), (1, 3, "x"), (2, 0, "x"), (3, 0, "a")])
    f = {r["id"]: (r["first_value"], r["first_pos"])
         for r in sequence.first_match(df, ["id"], ["pos"], F.col("v") == "x", "pos").collect()}
    assert f == {1: (2, 2), 2: (0, 0)}
    run = {r["id"]: r["run"] for r in sequence.leading_run(df, ["id"], ["pos"], F.col("v") != "x").collect()}
    assert run == {1: 2, 2: 0, 3: 1}


def test_previous_and_conjunction(spark):
    df = _seq(spark, [(1, 0, "view"), (1, 1, "buy"), (1, 2, "buy")])
    out = sequence.with_previous(df, ["id"], ["pos"], {"prev": F.col("v")})
    rows = out.orderBy("pos").select("prev", sequence.all_of(F.col("prev") == "view", F.col("v") == "buy").alias("f"))
    assert [tuple(r) for r in rows.collect()] == [(None, False), ("view", True), ("buy", False)]


def test_array_forms(spark):
    df = spark.createDataFrame([([3, 1, -2, 5],), ([],)], "a array<int>")
    r = df.select(sequence.array_find(F.col("a"), lambda x: x < 0).alias("f"),
                  sequence.array_find_index(F.col("a"), lambda x: x < 0).alias("i"),
                  sequence.array_leading_run(F.col("a"), lambda x: x > 0).alias("run"),
                  sequence.array_from_end(F.col("a"), 1).alias("last"),
                  sequence.pointwise_all(F.col("a"), F.array(F.lit(3), F.lit(1)), lambda x, y: x == y).alias("pw")
                  ).collect()
    assert tuple(r[0]) == (-2, 2, 2, 5, True)
    assert tuple(r[1]) == (None, None, 0, None, True)
