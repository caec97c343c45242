import inspect
import random

from sigloom.operators import graph


def _levels(spark, edges):
    df = spark.createDataFrame(edges, "src string, dst string")
    return {r["node"]: r["level"] for r in graph.topological_levels(df).collect()}


def test_chain_diamond_parallel(spark):
    assert _levels(spark, [("a", "b"), ("b", "c")]) == {"a": 0, "b": 1, "c": 2}
    assert _levels(spark, [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("c", "d")]) == \
        {"a": 0, "b": 1, "c": 1, "d": 2}


def test_cycles_keep_null_level(spark):
    # self-loop, and a cycle with a tail: nodes on or below a cycle have no level (V5)
    got = _levels(spark, [("s", "s"), ("a", "b"), ("b", "c"), ("c", "b"), ("c", "t"), ("x", "a")])
    assert got == {"s": None, "x": 0, "a": 1, "b": None, "c": None, "t": None}


def test_reverse_and_nodes(spark):
    df = spark.createDataFrame([("a", "b"), ("a", "b"), ("c", "d")], "src string, dst string")
    assert sorted(tuple(r) for r in graph.reverse(df).collect()) == [("b", "a"), ("b", "a"), ("d", "c")]
    assert sorted(r["node"] for r in graph.nodes(df).collect()) == ["a", "b", "c", "d"]


def test_expand_dictionary(spark):
    d = spark.createDataFrame([("v", "[ae]"), ("s", "x(v)"), ("w", "(s)(s)"), ("bad", "(nope)")],
                              "name string, body string")
    got = {r["name"]: (r["expanded"], r["error"]) for r in graph.expand_dictionary(d).collect()}
    assert got["v"] == ("[ae]", None)
    assert got["s"] == ("x(?:[ae])", None)
    assert got["w"] == ("(?:x(?:[ae]))(?:x(?:[ae]))", None)
    assert got["bad"] == (None, "unresolved reference")   # V13


def test_errors_reach_all_that_refer_to_them(spark):
    d = spark.createDataFrame([("a", "x(b)"), ("b", "y(zzz)"), ("c", "(a)(ok)"), ("ok", "1"), ("d", "(ok)"), ("e", "(f)"), ("f", "(e)"), ("g", "(e)"), ("h", "(g)(ok)")],
                              "name string, body string")
    got = {r["name"]: (r["expanded"], r["error"]) for r in graph.expand_dictionary(d).collect()}
    assert {n for n, (_, e) in got.items() if e} == {"a", "b", "c", "e", "f", "g", "h"}
    assert got["ok"] == ("1", None) and got["d"] == ("(?:1)", None) and all(x is None for x, e in got.values() if e)


def test_peeling_has_no_cap(spark):
    assert "max_rounds" not in inspect.signature(graph.topological_levels).parameters
    edges = [(f"n{i}", f"n{i + 1}") for i in range(8)]
    assert _levels(spark, edges) == {f"n{i}": i for i in range(9)}


def test_levels_equal_longest_paths(spark):
    rnd = random.Random(5)
    # layers of unequal width with parallel edges, shortcuts, a hot source, cycles with tails and null ends
    edges = [(rnd.randrange(0, 60), rnd.randrange(60, 120)) for _ in range(80)]
    edges += [(a, a + rnd.randrange(1, 15)) for a in rnd.choices(range(105), k=150)] + [(0, d) for d in range(1, 120)]
    edges += [(200, 201), (201, 202), (202, 200), (202, 203), (3, 203), (203, 204), (205, 206), (205, 206)]
    edges += [(None, 300), (301, None), (None, None)]
    ends = {n for e in edges for n in e} - {None}
    into = {n: {s for s, d in edges if d == n and s is not None} for n in ends}
    want = dict.fromkeys(ends)
    while True:
        ready = {n: 1 + max((want[s] for s in into[n]), default=-1) for n in ends
                 if want[n] is None and all(want[s] is not None for s in into[n])}
        if not ready:
            break
        want |= ready
    got = {r["node"]: r["level"] for r in graph.topological_levels(
        spark.createDataFrame(edges, "src int, dst int")).collect()}
    assert got == want and got[204] is None and got[206] == 1 and got[300] == 0


def test_no_edges_no_levels(spark):
    assert _levels(spark, []) == {}


def _stored_plans(monkeypatch):
    """The plans of all tables that the operators store from now on."""
    plans, stored = [], graph._ckpt
    monkeypatch.setattr(graph, "_ckpt", lambda df: plans.append(df._jdf.queryExecution().toString()) or stored(df))
    return plans


def test_expansion_sends_no_join_side_through_the_driver(spark, monkeypatch):
    # sides that are not counted and small are shuffled, whatever their size estimate
    plans = _stored_plans(monkeypatch)
    monkeypatch.setattr(graph, "BROADCAST_NAMES", 0, raising=False)
    d = spark.createDataFrame([("a", "1"), ("b", "(a)"), ("c", "(b)(a)"), ("d", "(c)(zzz)"), ("e", "(d)"), ("f", "(f)"), ("g", None), ("h", "(g)"), (None, "(a)")],
                              "name string, body string")
    out = graph.expand_dictionary(d)
    assert not any("BroadcastHashJoin" in p for p in [*plans, out._jdf.queryExecution().toString()])
    bad = "unresolved reference"
    assert {r["name"]: (r["expanded"], r["error"]) for r in out.collect()} == {
        "a": ("1", None), "b": ("(?:1)", None), "c": ("(?:(?:1))(?:1)", None), "d": (None, bad), "e": (None, bad),
        "f": (None, bad), "g": (None, None), "h": (None, None), None: (None, None)}


def test_peeling_ends_with_the_last_edge(spark, monkeypatch):
    # edges, nodes, two rounds and a compaction; sinks cost no round, a small frontier leaves the edges in place
    plans = _stored_plans(monkeypatch)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert _levels(spark, [("a", "b"), ("b", "c")]) == {"a": 0, "b": 1, "c": 2}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(plans) == 5 and sum("BroadcastHashJoin" in p for p in plans) == 2
