from pyspark.sql import functions as F

from sigloom.operators import hierarchy


def test_tri_state(spark):
    df = spark.createDataFrame([("r1", "a", True), ("r1", "b", True), ("r2", "c", True), ("r2", "d", False),
                                ("r3", "e", False), ("r4", "f", None)], "r string, n string, v boolean")
    got = {(r["r"], r["n"]): r["state"] for r in hierarchy.rollup_tri_state(df, ["r", "n"], F.col("v")).collect()}
    assert got[("r1", None)] is True
    assert got[("r2", None)] is None          # mixed
    assert got[("r3", None)] is False
    assert got[("r4", None)] is None          # a mixed leaf makes its branch mixed
    assert got[(None, None)] is None


def test_propagate_down(spark):
    leaves = spark.createDataFrame([(1, ["a", "x", "1"]), (2, ["a", "y", "2"]), (3, ["b", "z", "3"])],
                                   "id int, path array<string>")
    assign = spark.createDataFrame([(1, ["a"], True), (2, ["a", "y"], False), (3, ["a"], None), (4, ["a", "x"], True)],
                                   "seq int, path array<string>, enabled boolean")
    got = {r["id"]: r["enabled"] for r in hierarchy.propagate_down(leaves, assign, "id").collect()}
    # leaf 1: latest on its path is seq 4 (true); leaf 2: seq 3 mixed -> false; leaf 3: no assignment
    assert got == {1: True, 2: False, 3: True}


def test_ordered_join(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (1, 3, "c")], "g int, o int, v string")
    r = df.groupBy("g").agg(hierarchy.ordered_join(F.col("v"), F.col("o"), "-").alias("s")).first()
    assert r["s"] == "a-b-c"
