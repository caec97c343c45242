from pyspark.sql import functions as F

from sigloom.functions import tokens


def _toks(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    r = df.select(tokens.tokens(F.col("t"), unicode=True).alias("k")).first()["k"]
    return [(x["tag"], x["value"]) for x in r]


def test_rule_order_quirks(spark):
    assert _toks(spark, "0b1") == [("lit_dec", "0"), ("name", "b1")]
    assert _toks(spark, "1.5") == [("lit_dec", "1"), ("name", ".5")] or \
        _toks(spark, "1.5")[0] == ("lit_dec", "1")
    assert _toks(spark, "{{x}}") == [("curlyL", "{"), ("curlyL", "{"), ("name", "x"), ("curlyR", "}"), ("curlyR", "}")]
    assert _toks(spark, "A->B") == [("name", "A->B")]
    assert _toks(spark, "A -> B") == [("name", "A"), ("arrow", "->"), ("name", "B")]
    assert _toks(spark, "x' → M.N.f _+_ _") == [("name", "x'"), ("arrow", "→"), ("name", "M.N.f"),
                                                ("name", "_+_"), ("discard", "_")]
    assert _toks(spark, "λ ⦃ x ⦄ : \"s\" 'c'") == [("lambda", "λ"), ("instsL", "⦃"), ("name", "x"),
                                                  ("instsR", "⦄"), ("colon", ":"), ("lit_str", '"s"'),
                                                  ("lit_chr", "'c'")]


def test_comments(spark):
    assert _toks(spark, "a --c\nb") == [("name", "a"), ("comment", "--c\n"), ("name", "b")]
    assert _toks(spark, "a {-c-} b") == [("name", "a"), ("comment", "{-c-}"), ("name", "b")]
    assert _toks(spark, "") == []


def test_positions_and_gaps(spark):
    df = spark.createDataFrame([(1, "ab ;c\n  d; ")], "id int, t string")
    rows = tokens.token_table(df, "id", "t").orderBy("pos").collect()
    assert [(r["value"], r["start_idx"], r["line"], r["col"]) for r in rows] == \
        [("ab", 0, 1, 1), ("c", 4, 1, 5), ("d", 8, 2, 3)]
    gaps = tokens.unmatched(df, "id", "t").orderBy("pos").collect()
    # the gap before "c" holds ";"; the trailing "; " is not reported
    assert [(r["pos"], r["gap"]) for r in gaps] == [(1, " ;")]


def test_long_names(spark):
    # matched without backtracking, so a name of any length takes no stack
    long = ["a" * 60_000, "b'_c." * 12_000 + "d"]
    df = spark.createDataFrame([(1, " ".join(long)), (2, "")], "id int, t string")
    for unicode in (False, True):
        rows = tokens.token_table(df, "id", "t", unicode).orderBy("pos").collect()
        assert [(r["id"], r["tag"], r["value"], r["start_idx"]) for r in rows] == \
            [(1, "name", long[0], 0), (1, "name", long[1], 60_001)]


def test_names_and_gaps_without_backtracking(spark):
    text = "a_ _b c__d .e f._g h.'i@\\ j;_ k_.l \"m n\" \"o"
    assert _toks(spark, text) == [
        ("name", "a_"), ("name", "_b"), ("name", "c_"), ("name", "_d"), ("name", "e"), ("name", "f._g"),
        ("name", "h.'i"), ("name", "j"), ("discard", "_"), ("name", "k_.l"), ("lit_str", '"m n" "'), ("name", "o")]
