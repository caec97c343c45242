import random

import pytest
from pyspark.sql import functions as F

from sigloom.operators import extract, search
from sigloom.operators.search import _fits, _tree

CORPUS = """module T where
f : Nat -> Nat
g : Nat -> D
h : D
k : List Nat -> Nat -> Bool
m : (Nat -> D) -> Bool
"""


@pytest.fixture(scope="module")
def index(spark):
    df = spark.createDataFrame([("lib", "T", CORPUS)], "library string, module string, text string")
    defs = extract.extract_definitions(df)
    return search.index_definitions(defs).checkpoint()


def _run(spark, index, qs):
    q = spark.createDataFrame(qs, "query_id long, query string, search_names boolean, strict_names boolean, "
                                  "search_types boolean, strict_types boolean")
    res = search.search(index, search.prepare_queries(q)).join(index.select("def_id", "name"), "def_id")
    out = {}
    for r in res.collect():
        out.setdefault(r["query_id"], set()).add((r["name"], r["by_name"], r["by_type"]))
    return out


def test_switches(spark, index):
    got = _run(spark, index, [
        (1, "f h", True, True, False, True),      # names only
        (2, "D -> Nat", False, True, True, True),  # exact type only, order-insensitive
        (3, "Nat", False, True, True, False),     # related type
        (4, "D", True, False, False, False),      # loose names
        (5, "f", False, True, False, True),       # fully ignored
        (6, "f", True, True, True, True),         # name and type hit -> one row
    ])
    assert got[1] == {("f", True, False), ("h", True, False)}
    assert got[2] == {("g", False, True)}
    assert {n for n, _, _ in got[3]} == {"f", "g", "k", "m"}
    assert {n for n, _, _ in got[4]} == {"g", "h", "m"}
    assert 5 not in got
    assert ("f", True, False) in got[6]


def _rand_sig(rnd, depth=0):
    k = rnd.randint(1, 3)
    parts = []
    for _ in range(k):
        if depth < 1 and rnd.random() < 0.2:
            parts.append("(" + _rand_sig(rnd, depth + 1) + ")")
        else:
            parts.append(" ".join(rnd.choice(["A", "B", "M.A", "C"]) for _ in range(rnd.randint(1, 2))))
    return " → ".join(parts)


def test_blocked_related_and_exact_equal_brute_force(spark):
    rnd = random.Random(11)
    defs_t = [_rand_sig(rnd) for _ in range(60)]
    qs_t = [_rand_sig(rnd) for _ in range(15)]
    d = spark.createDataFrame([(i, f"d{i}", t) for i, t in enumerate(defs_t)],
                              "def_id long, name string, type_raw string")
    idx = search.index_definitions(d).checkpoint()
    q = spark.createDataFrame([(i, t, False, True, True, s) for i, t in enumerate(qs_t) for s in (True,)],
                              "query_id long, query string, search_names boolean, strict_names boolean, "
                              "search_types boolean, strict_types boolean")
    q2 = q.withColumn("query_id", F.col("query_id") + 100).withColumn("strict_types", F.lit(False))
    prepared = search.prepare_queries(q.unionByName(q2))
    got = {(r["query_id"], r["def_id"]) for r in search.search(idx, prepared).collect()}
    encs = {r["def_id"]: _tree(list(r["enc"]))[0] for r in idx.collect() if r["enc"] is not None}
    qenc = {r["query_id"]: _tree(list(r["q_enc"]))[0] for r in prepared.collect() if r["q_enc"] is not None}

    def same(x, y):
        if x[0] != y[0]:
            return False
        if x[0] == "E":
            return all(a == b for a, b in zip(x[1], y[1]))
        return len(x[1]) == len(y[1]) and all(same(a, b) for a, b in zip(x[1], y[1]))

    want = set()
    for qid, qt in qenc.items():
        for did, dt in encs.items():
            if qid < 100 and same(dt, qt):
                want.add((qid, did))
            if qid >= 100 and _fits(dt, qt):
                want.add((qid, did))
    assert got == want


def test_all_function_query_finds_a_leaf(spark):
    text = "module U where\np : A -> C\nq : (A -> B) -> (C -> D)\nr : D -> B\n"
    df = spark.createDataFrame([("lib", "U", text)], "library string, module string, text string")
    idx = search.index_definitions(extract.extract_definitions(df)).checkpoint()
    q = spark.createDataFrame([(1, "(A -> B) -> (C -> D)", False, False, True, False)],
                              "query_id long, query string, search_names boolean, strict_names boolean, "
                              "search_types boolean, strict_types boolean")
    res = search.search(idx, search.prepare_queries(q)).join(idx.select("def_id", "name"), "def_id")
    assert {r["name"] for r in res.collect()} >= {"p", "q"}


def test_failed_checks_are_not_indexed(spark):
    df = spark.createDataFrame([("lib", "V", "module V where\na : X\nb : Y\n")], "library string, module string, text string")
    defs = extract.extract_definitions(df).withColumn("type_error", F.when(F.col("name") == "b", "boom"))
    assert [r["name"] for r in search.index_definitions(defs).collect()] == ["a"]


def _related(spark, defs_t, qs_t):
    d = spark.createDataFrame([(i, f"d{i}", t) for i, t in enumerate(defs_t)], "def_id long, name string, type_raw string")
    idx = search.index_definitions(d).checkpoint()
    q = spark.createDataFrame([(i, t, False, True, True, False) for i, t in enumerate(qs_t)],
                              "query_id long, query string, search_names boolean, strict_names boolean, search_types boolean, strict_types boolean")
    prepared = search.prepare_queries(q)
    got = {(r.query_id, r.def_id) for r in search.related_hits(idx, prepared).collect()}
    trees = {r.def_id: _tree(r.enc)[0] for r in idx.where("enc is not null").collect()}
    asked = {r.query_id: _tree(r.q_enc)[0] for r in prepared.where("q_enc is not null").collect()}

    def parts(t):
        return t if t[0] == "F" else ("F", [t])
    return got, {(i, j) for i, t in asked.items() for j, u in trees.items() if _fits(parts(u), parts(t))}


def test_related_with_empty_leaves_and_deep_functions(spark):
    rnd = random.Random(5)
    names = ["A", "B", "M.A", "C", "N.B"]

    def sig(depth):
        return " → ".join("(" + sig(depth - 1) + ")" if depth and rnd.random() < 0.4 else " ".join(rnd.choices(names, k=rnd.randint(1, 2)))
                          for _ in range(rnd.randint(1, 3)))
    texts = [sig(3) for _ in range(70)] + ["→", "A →", "→ A → B", "(→ A) → B", "A", "A", "A"]
    got, want = _related(spark, texts, [sig(2) for _ in range(25)] + ["→", "A → C", "→ B", "A", "(A → B) → C"])
    assert got == want
    assert any(d == texts.index("→") for q, d in got if q == 26)  # the lone arrow fits A → C


def test_candidates_stay_near_the_hits(spark):
    """A common part must not be probed where a rare one is there."""
    defs_t = [f"Common -> Rare{i % 50} -> (Common -> X{i % 40})" for i in range(2000)]
    d = spark.createDataFrame([(i, "n", t) for i, t in enumerate(defs_t)], "def_id long, name string, type_raw string")
    idx = search.index_definitions(d).checkpoint()
    q = spark.createDataFrame([(i, f"Common -> (X{i} -> Common)", False, True, True, False) for i in range(40)],
                              "query_id long, query string, search_names boolean, strict_names boolean, search_types boolean, strict_types boolean")
    prepared = search.prepare_queries(q)
    _, qs = search.signature_classes(prepared, "query_id", "q_")
    _, ds = search.signature_classes(idx, "def_id")
    assert ds.count() == 200  # 2,000 definitions of 200 different signatures
    pairs = search.related_candidates(qs, ds, search.postings(ds), True)
    hits = search.related_pairs(pairs, qs, ds)
    assert hits.count() > 0 and pairs.count() <= 10 * hits.count()


def test_index_keeps_rows_of_one_id(spark):
    rows = [(1, "a", ": A -> B", None), (1, "b", ": B -> C", None), (1, "c", ": A -> B", "no such name"),
            (None, "d", ": A -> B", None), (None, "d", ": A -> B", None), (2, "e", None, None), (3, "f", ": ->", None)]
    defs = spark.createDataFrame(rows, "def_id long, name string, type_raw string, type_error string")
    built = search.index_definitions(defs).checkpoint()
    got = sorted(((r["def_id"], r["name"], [[t["value"] for t in leaf] for leaf in r["leaves"] or []])
                  for r in built.where("sig_error is null").collect()), key=str)
    assert got == sorted([(1, "a", [["A"], ["B"]]), (1, "b", [["B"], ["C"]]), (2, "e", []),
                          (None, "d", [["A"], ["B"]]), (None, "d", [["A"], ["B"]])]
                         + [(3, "f", [[]])], key=str)
    errors = {(r["def_id"], r["name"], r["stage"], r["error"]) for r in search.index_errors(defs, built).collect()}
    assert (1, "c", "check", "no such name") in errors and built.where("name = 'c'").isEmpty()
    assert built.count() + sum(e[2] == "check" for e in errors) == len(rows)


def test_index_errors_by_stage(spark):
    defs = spark.createDataFrame([(1, "f", ": A -> -> B", None), (2, "g", ": A", "timeout"), (3, "h", ": A", None)],
                                 "def_id long, name string, type_raw string, type_error string")
    built = search.index_definitions(defs).checkpoint()
    errors = sorted(tuple(r) for r in search.index_errors(defs, built).collect())
    assert errors == [(1, "f", "signature", "empty signature part"), (2, "g", "check", "timeout")]
    assert {r["def_id"] for r in built.collect()} == {1, 3}
    empty = search.index_definitions(defs.limit(0))
    assert empty.isEmpty() and search.index_errors(defs.limit(0), empty).isEmpty()


def test_queries_stay_in_their_scope(spark):
    defs = [(1, "base", "Data.Nat", "suc", "Nat -> Nat"), (2, "base", "Data.List", "suc", "List -> Nat"),
            (3, "cubes", "Cube", "suc", "Nat -> Nat"), (4, "cubes", "Path", "turn", "Nat -> List"),
            (5, None, None, "suc", "Nat -> Nat"), (6, "cubes", "Empty", "any", "→")]
    idx = search.index_definitions(spark.createDataFrame(
        defs, "def_id long, library string, module string, name string, type_raw string"))
    examined = spark.createDataFrame([("cubes", "Path"), ("cubes", "Path"), ("base", None)], "library string, module string")
    placed = search.placed_definitions(idx, examined).checkpoint()
    on, off = True, False
    rows = [(1, "suc", on, on, off, on, "base", None, off), (2, "suc", on, on, off, on, "other, base\ncubes", "Cube", off),
            (3, "suc", on, on, off, on, None, None, off), (4, "List", on, off, off, on, "base", None, on),
            (5, "List", on, off, off, on, None, "Data.List\nCube", None), (6, "Nat -> Nat", off, on, on, on, "cubes", None, off),
            (7, "Nat", off, on, on, off, None, "Data.Nat\nData.List", off), (8, "Nat", off, on, on, off, None, "Path", on),
            (9, "Nat -> Nat", off, on, on, on, "nowhere", "nothing", off),
            (10, "Nat -> Nat", off, on, on, off, "cubes", None, off)]
    q = spark.createDataFrame(rows, "query_id long, query string, search_names boolean, strict_names boolean, search_types boolean, "
                                    "strict_types boolean, imported_libraries string, imported_modules string, include_examined boolean")
    prepared = search.prepare_queries(q)
    free = {(r["query_id"], r["def_id"]) for r in search.search(placed, prepared).collect()}
    found = search.search(placed, search.scoped_queries(prepared)).collect()
    got = {(r["query_id"], r["def_id"]) for r in found}
    scopes = {1: {1, 2}, 2: {1, 2, 3, 4, 6}, 3: set(), 4: {1, 2, 4}, 5: {2, 3}, 6: {3, 4, 6}, 7: {1, 2}, 8: {4}, 9: set(), 10: {3, 4, 6}}
    assert got == {(a, b) for a, b in free if b in scopes[a]} and len(found) == len(got)
    assert {(1, 1), (1, 2), (2, 3), (4, 4), (5, 2), (6, 3), (7, 1), (8, 4), (10, 6)} <= got and (1, 5) in free


def test_names_meet_few_terms_where_they_are(spark):
    # a term that most definitions share must not gather them in one task
    defs = spark.createDataFrame([(i, "ring" if i % 2 else "bar", ["small", "small", f"m{i}"]) for i in range(40)] + [(40, None, None)],
                                 "def_id long, name string, mentions array<string>")
    q = spark.createDataFrame([("q", ["ring", "small"], True, False), ("n", ["ring"], True, True), ("x", ["ring"], False, False)],
                              "query_id string, terms array<string>, search_names boolean, strict_names boolean")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        named, loose = search.name_hits(defs, q), search.loose_hits(defs, q)
        for hits in (named, loose):
            plan = hits._jdf.queryExecution().toString()
            assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        odd = {i for i in range(40) if i % 2}
        assert sorted(map(tuple, named.collect())) == sorted((x, i) for x in "qn" for i in odd)
        assert sorted(map(tuple, loose.collect())) == [("q", i) for i in range(40)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
