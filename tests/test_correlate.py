import random
from collections import deque

from pyspark.sql import functions as F

from sigloom.operators.correlate import fifo_pairs, fifo_pairs_by_kind, queues


def test_fifo_matches_queue_simulation(spark):
    rnd = random.Random(3)
    rows, want = [], set()
    for s in range(60):
        q = deque()
        for t in range(rnd.randint(0, 25)):
            k = rnd.choice("RRSx")
            rows.append((s, t, k))
            if k == "R":
                q.append(t)
            elif k == "S" and q:
                want.add((s, q.popleft(), t))
    df = spark.createDataFrame(rows, "sid int, t int, k string").withColumn("eid", F.col("t"))
    got = {(r["sid"], r["req_eid"], r["resp_eid"])
           for r in fifo_pairs(df, ["sid"], ["t"], F.col("k") == "R", F.col("k") == "S", "eid").collect()}
    assert got == want


def _queue(rows, accepts):
    """Plain replay: one list of waiting requests per session."""
    waiting, want = {}, set()
    for s, t, k in sorted(rows, key=lambda r: r[1]):
        line = waiting.setdefault(s, [])
        if k in accepts:
            line.append((t, k))
        else:
            hit = next((w for w in line if k in accepts[w[1]]), None)
            if hit:
                line.remove(hit)
                want.add((s, hit[0], t))
    return want


OVERLAPPING = {"A": {"x", "y"}, "B": {"y"}, "C": {"y", "z"}, "D": {"w"}, "E": {"w"}, "F": set(), "G": {"A"}}


def _events(n, keys, kinds, seed):
    rnd = random.Random(seed)
    # a third of all rows have one session; sessions may be null
    return [(0 if rnd.random() < 0.33 else rnd.choice([None, *range(1, keys)]), t, rnd.choice(kinds)) for t in range(n)]


def _by_kind(spark, rows, accepts, **kw):
    df = spark.createDataFrame(rows, "sid int, t int, k string").withColumn("eid", F.col("t").cast("long"))
    got = [tuple(r) for r in fifo_pairs_by_kind(df, ["sid"], ["t"], "eid", "k", accepts, **kw).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_queues_split_by_shared_responses():
    got = sorted(sorted(q) for q in queues(OVERLAPPING))
    assert got == [["A", "B", "C"], ["D", "E"]]
    assert queues({}) == []


def test_kinds_compete_for_responses(spark):
    rows = _events(600, 12, "AABBCDEFGxyzwq", 1)
    want = _queue(rows, OVERLAPPING)
    assert any(s is None for s, _, _ in want)
    assert _by_kind(spark, rows, OVERLAPPING) == want


def test_blocks_of_a_hot_session_hand_on_their_queue(spark):
    # many more requests than responses: most wait over several blocks
    rows = _events(240, 4, "AABBCCxyz", 2)
    want = _queue(rows, OVERLAPPING)
    assert _by_kind(spark, rows, OVERLAPPING, block_rows=25) == want


def test_kinds_with_one_set_are_one_queue(spark):
    accepts = {"A": {"x", "y"}, "B": {"x", "y"}}
    rows = _events(300, 6, "ABxy", 3)
    assert _by_kind(spark, rows, accepts) == _queue(rows, accepts)


def test_no_rows_no_kinds(spark):
    assert _by_kind(spark, [], OVERLAPPING) == set()
    assert _by_kind(spark, [(1, 1, "A"), (1, 2, None)], OVERLAPPING) == set()
    assert _by_kind(spark, [(1, 1, "A"), (1, 2, "x")], {}) == set()
