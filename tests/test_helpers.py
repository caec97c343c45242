from pyspark.sql import functions as F

from sigloom.functions import abbrev
from sigloom.operators import extract, search
from sigloom.sources import index


def test_titles_paths_and_result_split(spark):
    df = spark.createDataFrame([("lib", "A.B", "R.", "f", ": X", None), ("lib", "C", "", "g", None, "boom")],
                               "library string, module string, inner_path string, name string, type_raw string, "
                               "error string")
    r = df.select(extract.title(F.col("name"), F.col("type_raw")).alias("t"),
                  extract.display_path(F.col("library"), F.col("module"), F.col("inner_path")).alias("p")).collect()
    assert [(x["t"], x["p"]) for x in r] == [("f : X", "A.B.R"), ("g", "C")]
    ok, bad = extract.split_results(df)
    assert [x["name"] for x in ok.collect()] == ["f"] and [x["name"] for x in bad.collect()] == ["g"]


def test_dictionary_frame_and_query_scope(spark):
    frame = abbrev.dictionary_frame(spark, '{"a": {" ": "α", "b": "β"}}')
    assert sorted(tuple(r) for r in frame.collect()) == [("a", "α"), ("ab", "β")]
    q = spark.createDataFrame([(1, "L1, L2\tL1", "M.A\n\nM.B", True)],
                              "query_id long, imported_libraries string, imported_modules string, "
                              "include_examined boolean")
    got = sorted((r["kind"], r["name"]) for r in search.query_scope(q).collect())
    assert got == [("library", "L1"), ("library", "L1"), ("library", "L2"), ("module", "M.A"), ("module", "M.B")]
    sel = spark.createDataFrame([("lib", "X"), ("lib", "Y")], "library string, module string")
    assert sorted(tuple(r) for r in search.examined_scope(sel).collect()) == \
        [("library", "lib"), ("module", "X"), ("module", "Y")]


def test_cached_index(spark):
    df = spark.createDataFrame([("lib", "M", "f")], "library string, module string, name string")
    c = index.cached(df)
    assert c.is_cached and c.count() == 1
    c.unpersist()
