import inspect

from pyspark.sql import functions as F

from sigloom.operators import signature


def _sig(spark, texts, strict_parity=False):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    out = signature.build_signatures(df, "id", "t", strict_parity=strict_parity)
    res = {}
    for r in out.collect():
        leaves = None if r["leaves"] is None else [" ".join(t["value"] for t in leaf) for leaf in r["leaves"]]
        res[r["id"]] = (r["shape"], leaves, r["error"])
    return [res[i] for i in range(len(texts))]


def test_parse_cases(spark):
    got = _sig(spark, ["A → B", "(A → B) → C", "(A) → (B)", "Nat", "->", "{}", "A -> -> B"])
    assert got[0] == ("F2 E E", ["A", "B"], None)
    assert got[1] == ("F2 E F2 E E", ["C", "A", "B"], None)      # leaf sorts before function
    assert got[2] == ("F2 E E", ["A", "B"], None)                # V3: only matching pairs stripped
    assert got[3] == ("E", ["Nat"], None)
    assert got[4] == ("E", [""], None)                          # lone arrow: one empty leaf
    assert got[5][2] == "empty signature part"                   # V8
    assert got[6][2] == "empty signature part"


def test_strict_parity_strips_unmatched(spark):
    got = _sig(spark, ["(A) → (B)"], strict_parity=True)
    assert got[0] == ("E", ["A ) → ( B"], None)


def test_canonical_order(spark):
    got = _sig(spark, ["C → A → B", "B → C → A", "A B → C", "C → A B", "(Y → X) → Z", "Z → (X → Y)"])
    assert got[0] == got[1] == ("F3 E E E", ["A", "B", "C"], None)
    assert got[2] == got[3] == ("F2 E E", ["C", "A B"], None)    # fewer tokens first
    assert got[4] == got[5]                                      # V12: nested parts sorted too


def test_renaming_and_expansion(spark):
    df = spark.createDataFrame([(1, "{A B : Set} → A → B"), (2, "{A A : Set} → A"), (3, "(x : A) → x"),
                                (4, "λ x y → x"), (5, "(A : Set"), (6, "(A) → B"), (7, "y → (y : T) → y")],
                               "id long, t string")
    rows = signature.rename_binders(signature.token_rows(df, "id", "t"), "id")
    arr = {r["id"]: " ".join(t["value"] for t in r["toks"]) for r in signature.collect_tokens(rows, "id").collect()}
    assert arr[1] == "{ @0 : Set } { @1 : Set } → @0 → @1"
    assert arr[2] == "{ @0 : Set } { @0 : Set } → @0"          # V7: every binder once
    assert arr[3] == "( @0 : A ) → @0"
    assert arr[4] == "λ @0 @1 → @0"
    assert arr[5] == "( @0 : Set"                                # unclosed group: renamed, not expanded
    assert arr[6] == "( A ) → B"                                 # no colon: no binder
    assert arr[7] == "y → ( @0 : T ) → @0"                       # names before their binding stay


def test_pattern_lambdas_bind_nothing(spark):
    texts = ["λ { (x : A) → x }", "λ _ x → x", "λ x _ → x", "λ x y → y x", "λ { (a : A) → λ b → b } → (c : A) → c", "λ { { (d : A) } (e : B) → e", "(f : A) → λ { (g : B) → f }",
             "λ { x } (y : A) → y"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    rows = signature.rename_binders(signature.token_rows(df, "id", "t"), "id")
    got = {r["id"]: r["s"] for r in rows.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]), " ").alias("s")).collect()}
    assert [got[i] for i in range(len(texts))] == [
        "λ { ( x : A ) → x }", "λ _ x → x", "λ x _ → x", "λ @0 @1 → @1 @0", "λ { ( a : A ) → λ b → b } → ( @0 : A ) → @0", "λ { { ( d : A ) } ( e : B ) → e",
        "( @0 : A ) → λ { ( g : B ) → @0 }", "λ { x } ( @0 : A ) → @0"]


def test_signature_columns(spark):
    df = spark.createDataFrame([(1, "M.List A → Nat")], "id long, t string")
    r = signature.build_signatures(df, "id", "t").first()
    assert r["arity"] == 2 and not r["has_nested"]
    assert sorted(r["mentions"]) == ["A", "M.List", "Nat"]
    assert sorted(r["leaf_keys"]) == ["name:List", "name:Nat"]
    assert r["exact_key"] is not None


def test_parsing_has_no_cap(spark):
    assert "max_depth" not in inspect.signature(signature.parse_canonical).parameters
    deep = "A"
    for _ in range(6):
        deep = f"({deep} -> B) -> C"
    (got,) = _sig(spark, [deep])
    assert got[2] is None and sorted(got[1]) == ["A"] + ["B"] * 6 + ["C"] * 6
