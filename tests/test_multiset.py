import random

import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F

from sigloom.operators import multiset


def _baskets(spark, baskets):
    rows = [(i, [("name", a), ("name", b)]) for i, items in enumerate(baskets) for a, b in items]
    return spark.createDataFrame(rows, "id long, leaf array<struct<tag:string,value:string>>")


def _brute(baskets):
    same, related = {}, {}
    for i, q in enumerate(baskets):
        same[i] = sum(1 for d in baskets if sorted(d) == sorted(q))
        n = 0
        for d in baskets:
            if len(q) <= len(d):
                n += set(q) <= set(d)
            else:
                n += set(d) <= set(q)
        related[i] = n
    return same, related


def test_same_and_related_counts_match_brute_force(spark):
    rnd = random.Random(5)
    items = [(b, t) for b in "xyz" for t in "pq"]
    baskets = [[rnd.choice(items) for _ in range(rnd.randint(1, 4))] for _ in range(80)]
    baskets.append(items * 3)  # a large basket (k = 6 > enum_limit below) takes the exact join path
    parts = _baskets(spark, baskets)
    same, related = _brute(baskets)
    got_same = {r["id"]: r["n_same"] for r in multiset.same_signature_counts(parts).collect()}
    got_rel = {r["id"]: r["n_related"] for r in multiset.related_signature_counts(parts, enum_limit=4).collect()}
    assert got_same == same
    assert got_rel == related


def test_mention_counts(spark):
    parts = spark.createDataFrame([(1, ["a", "b"]), (1, ["a", "c"]), (2, ["c", "d"])], "id long, tokens array<string>")
    terms = spark.createDataFrame([("a",), ("c",), ("z",)], "term string")
    got = {r["term"]: r["n_sigs"] for r in multiset.mention_counts(parts, terms).collect()}
    assert got == {"a": 1, "c": 2, "z": 0}


def test_large_baskets_need_no_pairs_over_shared_parts(spark, monkeypatch):
    # baskets of 13 to 16 parts were joined with every basket that shares a part
    monkeypatch.setattr(multiset, "_large_counts", lambda *a: (_ for _ in ()).throw(AssertionError("pairs over shared parts")))
    rnd = random.Random(7)
    items = [(b, t) for b in "wxyz" for t in "pqrst"]
    baskets = [rnd.sample(items, rnd.randint(13, 16)) for _ in range(6)]
    baskets += [rnd.choices(items, k=rnd.randint(1, 5)) for _ in range(60)]
    baskets += [baskets[0], baskets[0] + baskets[0][:2], baskets[0][:9], baskets[10] * 2]
    got = {r["id"]: r["n_related"] for r in multiset.related_signature_counts(_baskets(spark, baskets)).collect()}
    assert got == _brute(baskets)[1]


def test_walk_in_small_steps_finds_every_subset(monkeypatch):
    monkeypatch.setattr(multiset, "WALK_ROWS", 3)
    rnd = random.Random(3)
    pool = [(rnd.getrandbits(62), rnd.getrandbits(62)) for _ in range(9)]
    sets = [sorted(rnd.sample(pool, rnd.randint(1, 9))) for _ in range(12)]
    xor = lambda s, i: int(np.bitwise_xor.reduce([p[i] for p in s]))
    rows = [{"s1": xor(s, 0), "s2": xor(s, 1), "arity": 9, "n": 1, "ps": [{"h1": a, "h2": b} for a, b in s]} for s in sets]
    batch = pa.RecordBatch.from_pylist([rows[0], *rows]).slice(1)
    full = np.full((2, 1), -1, dtype=np.int64)  # lets everything through: every subset but the empty one, once
    got = [(r["c1"], r["s1"], r["s2"]) for out in multiset._walk(iter([batch]), full, 64) for r in out.to_pylist()]
    assert sorted(got) == sorted((xor(s, 0), xor(sub, 0), xor(sub, 1)) for s in sets
                                 for m in range(1, 1 << len(s)) for sub in [[p for i, p in enumerate(s) if m >> i & 1]])


def test_related_counts_in_rounds(spark, monkeypatch):
    # what one pass over all pairs of classes shuffled lay on disk at once
    monkeypatch.setattr(multiset, "ROUND_PAIRS", 50)
    monkeypatch.setattr(multiset, "ROUND_CLASSES", 30)
    monkeypatch.setattr(multiset, "SLICES", 8)
    stored, slices = multiset.stored, []
    monkeypatch.setattr(multiset, "stored", lambda df: slices.append(df.columns) or stored(df))
    rnd = random.Random(11)
    items = [(b, t) for b in "xyz" for t in "pq"]
    baskets = [rnd.choices(items, k=rnd.randint(1, 6)) for _ in range(60)] + [items * 3, [None, items[0]][1:] * 2]
    got = {r["id"]: r["n_related"] for r in multiset.related_signature_counts(_baskets(spark, baskets), enum_limit=5).collect()}
    assert got == _brute(baskets)[1]
    assert slices.count(["c", "m"]) > 2


def test_related_counts_read_the_parts_once(spark):
    # parts were shuffled twice, and all of it again for the answer
    parts = _baskets(spark, [[("x", "p"), ("y", "p")], [("x", "p")], [("z", "q")] * 3])
    plan = multiset.related_signature_counts(parts)._jdf.queryExecution().optimizedPlan().toString()
    assert "h1" not in plan and "LogicalRDD" not in plan and "leaf" not in plan


def test_stored_drops_the_shuffle_files_of_its_job(spark, tmp_path):
    from sigloom.session import stored

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    given = spark.conf.get(key, None)
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager()
    shuffles = lambda: sum(b.isShuffle() for b in _blocks(blocks))
    before = shuffles()
    got = stored(spark.range(100).groupBy((F.col("id") % 7).alias("g")).count())
    assert sorted(r["count"] for r in got.collect()) == [14] * 5 + [15] * 2 and got.columns == ["g", "count"]
    assert shuffles() <= before and spark.conf.get(key, None) == given


def _blocks(manager):
    found = manager.diskBlockManager().getAllBlocks()
    return [found.apply(i) for i in range(found.size())]
