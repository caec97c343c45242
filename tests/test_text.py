import pytest
from pyspark.sql import functions as F

from sigloom.functions import abbrev
from sigloom.sources import logs


def test_parse_log(spark):
    df = spark.createDataFrame([("P> (info-action \"*All Done*\" \"a)b\" \"\" x)",),
                                ("(tag)",), ("junk line",), ("()",)], "line string")
    rows = logs.parse_log(df, "line", prompt="P> ").collect()
    assert (rows[0]["tag"], list(rows[0]["args"])) == ("info-action", ["*All Done*", "a)b", "", "x"])
    assert (rows[1]["tag"], list(rows[1]["args"]), rows[1]["error"]) == ("tag", [], None)
    assert rows[2]["tag"] is None and rows[2]["error"] == "junk line"
    assert rows[3]["error"] == "()"


def test_flatten_dictionary():
    d = {"a": {" ": "α", "l": {"l": "∀"}}, " to": "→", "b": "β"}
    assert abbrev.flatten_dictionary(d) == [("a", "α"), ("all", "∀"), ("b", "β"), ("to", "→")]
    with pytest.raises(abbrev.DictionaryError):
        abbrev.flatten_dictionary({"a": "x", " a": "y"})


def test_expand_longest_sequence(spark):
    pairs = abbrev.flatten_dictionary({"a": {" ": "α", "l": {"l": "∀"}}, " to": "→"})
    df = spark.createDataFrame([("\\all x \\a \\al \\to\\q \\",)], "t string")
    r = df.select(abbrev.expand(F.col("t"), pairs).alias("e")).first()["e"]
    assert r == "∀ x α αl →\\q \\"


def test_quote_inside_a_word(spark):
    from sigloom.sources import logs
    df = spark.createDataFrame([('(tag ab"c d" e)',), ('(tag "" x)',), ("junk",)], "line string")
    got = [(r["tag"], r["args"]) for r in logs.parse_log(df).collect()]
    assert got == [("tag", ["abc d", "e"]), ("tag", ["", "x"]), (None, None)]
