"""Whitening against dense linear algebra, the qd solver on hard spectra, and defined results."""

import math
from fractions import Fraction

import numpy as np
import pytest

from sigloom.llm import qd, whitening

SCHEMA = "vec_id long, embedding array<float>, x int, component string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 7, "clash") for i, v in rows], SCHEMA)


def integers(v, d):
    return tuple(math.floor(256 * float(np.float32(c))) for c in v) + (0,) * (d - len(v))


def expected(rows, k=4):
    """n, exact deviations, covariance, eigenvalues and directions by plain means."""
    rows = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    d = max(len(v) for _, v in rows)
    xs = [integers(v, d) for _, v in rows]
    fit = sorted(set(xs))
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[float(Fraction(n * c - t, n)) for c, t in zip(x, s)] for x in fit])
    values, vecs = np.linalg.eigh(centred.T @ centred / n)
    values, vecs = values[::-1][:k], vecs[:, ::-1][:, :k]
    dev = [sum((n * c - t) ** 2 for c, t in zip(x, s)) for x in xs]
    at = np.array([[float(Fraction(n * c - t, n)) for c, t in zip(x, s)] for x in xs])
    return n, dev, values, at @ vecs / np.sqrt(np.maximum(values, 1e-300)), np.trace(centred.T @ centred / n)


def check(spark, rows, k=4):
    n, dev, values, white, trace = expected(rows, k)
    got = whitening.whiten(frame(spark, rows)).collect()
    ids = [i for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    assert len(got) == len(ids) * len(values) and {r.n for r in got} == {n}
    assert sorted((str(r.vec_id), r.component, r.deviation) for r in got) == sorted((str(i), c + 1, v) for i, v in zip(ids, dev) for c in range(len(values)))
    for c in range(len(values)):
        mine = sorted((str(r.vec_id), r.whitened) for r in got if r.component == c + 1)
        want = sorted((str(i), w) for i, w in zip(ids, white[:, c]))
        a, b = np.array([w for _, w in mine]), np.array([w for _, w in want])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-9
    assert all(abs(r.explained - values[r.component - 1] / trace) < 1e-9 and r.identity_error < 1e-9 for r in got)


def vectors(seed, n, d):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, d)) * np.linspace(1, 0.2, d) + rng.normal(size=d)
    return [[float(c) for c in v] for v in base.astype(np.float32)]


@pytest.mark.parametrize("seed,n,d", [(1, 400, 12), (2, 90, 40), (3, 30, 64), (4, 50, 2), (5, 40, 1)])
def test_whitening(spark, seed, n, d):
    rows = list(enumerate(vectors(seed, n, d)))
    dirty = [(9000, None), (9001, [None] + rows[0][1][1:]), (9002, [float("nan")] * d), (9003, [float("inf")] * d), (9004, [float("-inf")] * d)]
    repeats = [(5, rows[5][1]), (7000, rows[6][1]), (None, rows[7][1]), (None, rows[7][1])]
    check(spark, rows + dirty + repeats)


def test_hot_vector_and_many_partitions(spark):
    rows = list(enumerate(vectors(6, 300, 8))) + [(1000 + i, vectors(6, 300, 8)[0]) for i in range(200)]
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled"), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")  # more triangles than one task joins
    try:
        check(spark, rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old[0])
        spark.conf.set("spark.sql.shuffle.partitions", old[1])


def test_ragged_and_negative_zero(spark):
    rows = [(i, v[:1 + i % 5] + ([] if i % 3 else [-0.0])) for i, v in enumerate(vectors(7, 60, 5))] + [(100, []), (101, [0.0])]
    check(spark, rows)


def test_degenerate_tables(spark):
    assert whitening.whiten(frame(spark, [])).collect() == []
    assert whitening.whiten(frame(spark, [(1, None), (2, [float("nan")])])).collect() == []
    assert whitening.whiten(frame(spark, [(1, []), (2, [])])).collect() == []
    got = whitening.whiten(frame(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])])).collect()
    assert len(got) == 4 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got} == {(1, 0, None, None, None)}
    line = whitening.whiten(frame(spark, [(i, [i / 4, i / 2, 0.0]) for i in range(5)])).collect()
    assert {r.component for r in line if r.whitened is not None} == {1} and all(r.identity_error < 1e-12 for r in line)
    huge = whitening.whiten(frame(spark, [(1, [3e38, 0.0]), (2, [-3e38, 1.0])])).collect()
    assert {r.deviation for r in huge} == {None} and all(abs(abs(r.whitened) - 1) < 1e-9 for r in huge if r.component == 1)


@pytest.mark.parametrize("d", [1, 2, 3, 17, 64])
def test_solver(d):
    rng = np.random.default_rng(d)
    q = np.linalg.qr(rng.normal(size=(300, d)))[0]
    turn = np.linalg.qr(rng.normal(size=(d, d)))[0]
    spectra = {"plain": rng.uniform(1, 9, d), "graded": np.logspace(0, -9, d), "equal": np.ones(d), "tight": 1 + np.arange(d) * 1e-13,
               "pairs": 1.0 + np.arange(d) // 2, "low": np.r_[np.ones(1), np.zeros(d - 1)]}
    for name, s in spectra.items():
        a = q * s @ turn
        r = np.linalg.qr(a, mode="r")
        values, z = qd.right_vectors(r, min(4, d))
        exact = np.linalg.svd(a, compute_uv=False)[:min(4, d)] ** 2
        assert np.abs(values - exact).max() <= 1e-13 * exact[0], name
        assert np.abs(z.T @ z - np.eye(z.shape[1])).max() < 1e-13, name
        assert np.abs(a.T @ (a @ z) - z * values).max() <= 1e-13 * exact[0], name
    # Graded columns keep their small singular values to high relative accuracy.
    b = np.logspace(0, -12, d)
    assert np.allclose(np.sqrt(qd.dqds(b * b, np.zeros(max(d - 1, 0)))), np.sort(b)[::-1], rtol=1e-14)


def test_identity_error_is_measured():
    model = whitening.Whitening(4, [0, 0], np.array([4.0, 1.0]), np.eye(2), 5.0)
    import pyarrow as pa
    x = [[2, 0], [-2, 0], [0, 2], [0, -2]]
    (out,) = whitening._checked([pa.record_batch([pa.array(x, pa.list_(pa.int64()))], ["x"])], model)
    m2 = np.array(out.column("m2")[0].as_py()).reshape(2, 2)
    assert np.allclose(m2 / 4, [[0.5, 0], [0, 2.0]])
