"""Whitening of embeddings by a blockwise QR and a bidiagonal qd solver.

Each entry c of a vector becomes the long ``floor(256 * c)``; every distinct integer vector counts once (the fit
list). Its size and sums are exact. Tasks reduce the centred rows of their part to a triangle, block by block;
triangles are joined ``FAN_IN`` at a time until one is left, a square of the dimension whatever the number of rows.
One task brings it to bidiagonal form, finds the singular values by dqds and the directions by twisted
factorisations (``qd.py``), and all rows are projected on the directions.

Defined results: rows with a null vector, or with null, NaN or infinite entries, are left out. Shorter vectors are
read as if zeros followed (an empty one is all zeros); a table whose vectors are all empty gives no rows. Repeated
rows each get their own result and count once in the fit. ``256 * c`` beyond a long's range stops at about 9.2e18.
``deviation`` is null where the exact sum does not fit a long. A component without variance (all vectors equal, or
of lower rank) has ``whitened`` null; ``identity_error`` covers the others and is null without any; ``explained``
is null where the whole covariance is zero. Null ids are kept. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store
from .qd import EPS, right_vectors

COMPONENTS = 4
FAN_IN = 16        # triangles joined by one task
BLOCK = 1024       # rows reduced at once
LIMIT = 9.2e18     # integers stop here
_SAFE = 1 << 61


@dataclass(frozen=True)
class Whitening:
    """A fitted transform; all but ``n`` are bounded by the square of the dimension."""

    n: int
    sums: list[int]
    values: np.ndarray       # eigenvalues of the covariance, falling
    directions: np.ndarray   # dimension x components
    trace: float
    identity_error: float | None = None

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``x - sums / n`` with one rounding of the exact numerator where it fits a long."""
        return self.numerators(x).astype(np.float64) / self.n

    def numerators(self, x: np.ndarray) -> np.ndarray:
        """``n * x - sums``, exact: as longs, or as Python integers where these could overflow."""
        most = max(int(np.max(np.abs(x), initial=0)) * self.n, max(map(abs, self.sums), default=0))
        if most < _SAFE:
            return x * np.int64(self.n) - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sums of squared numerators, null beyond a long."""
        y = self.numerators(x)
        most = max((abs(int(v)) for v in (y.min(initial=0), y.max(initial=0))), default=0) if y.dtype != object else _SAFE
        if most * most * max(y.shape[1], 1) < 1 << 62:
            return (y * y).sum(axis=1).tolist()
        exact = (y.astype(object) ** 2).sum(axis=1)
        return [int(v) if v < 1 << 63 else None for v in exact]

    @property
    def live(self) -> np.ndarray:
        """Components with variance: above what rounding leaves of a zero."""
        top = float(self.values[0]) if len(self.values) else 0.0
        return self.values > top * (EPS * max(len(self.sums), 1)) ** 2 * 16

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates (NaN for components without variance)."""
        scale = np.where(self.live, np.sqrt(np.where(self.live, self.values, 1.0)), np.nan)
        return self.centred(x) @ self.directions / scale


def quantise(df: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and ``x array<long>`` of the rows whose vector is whole, all of the longest vector's length."""
    c = F.col("embedding").cast("array<double>")
    whole = F.col("embedding").isNotNull() & F.forall(c, lambda v: v.isNotNull() & (F.abs(v) < F.lit(float("inf"))))
    rows = df.where(whole)
    low, high = rows.agg(F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    x = F.transform(c, lambda v: F.floor(F.least(F.greatest(v * 256, F.lit(-LIMIT)), F.lit(LIMIT))).cast("long"))
    if low != high:
        x = F.concat(x, F.array_repeat(F.lit(0).cast("long"), F.lit(high) - F.size("embedding")))
    return rows.select(*keep, x.alias("x"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)


def _sums(batches, d: int):
    total, n = [0] * d, 0
    for batch in batches:
        x = _matrix(batch.column(0), d)
        n += len(x)
        if int(np.max(np.abs(x), initial=0)) * max(len(x), 1) >= _SAFE:
            x = x.astype(object)
        total = [a + int(b) for a, b in zip(total, x.sum(axis=0))]
    if n:
        yield pa.RecordBatch.from_pydict({"dim": list(range(-1, d)), "s": [str(v) for v in [n, *total]]},
                                         pa.schema([("dim", pa.int32()), ("s", pa.string())]))


def _triangle(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


_R = pa.schema([("part", pa.int64()), ("r", pa.list_(pa.float64()))])


def _lines(part: int, r: np.ndarray) -> pa.Table:
    return pa.table({"part": pa.array([part] * len(r), pa.int64()), "r": pa.array(list(r), pa.list_(pa.float64()))}, schema=_R)


def _reduce(batches, model: Whitening):
    """The triangle of a partition's centred rows."""
    d = len(model.sums)
    r = np.zeros((0, d))
    for batch in batches:
        y = model.centred(_matrix(batch.column(0), d))
        for at in range(0, len(y), BLOCK):
            r = _triangle(np.vstack([r, y[at:at + BLOCK]]))
    if len(r):
        yield from _lines(TaskContext.get().partitionId(), r).to_batches()


def _solve(r: np.ndarray, n: int, k: int) -> pa.Table:
    """Components as lines ``part = number, r = [eigenvalue, *direction]``; line 0 holds the trace."""
    values, found = right_vectors(r, k)
    lines = [[float((r * r).sum()) / n], *[[float(v) / n, *map(float, z)] for v, z in zip(values, found.T)]]
    return pa.table({"part": pa.array(range(k + 1), pa.int64()), "r": pa.array(lines, pa.list_(pa.float64()))}, schema=_R)


def _checked(batches, model: Whitening):
    """Count, means and centred products of a partition's whitened live components."""
    n, mean, m2 = 0, None, None
    for batch in batches:
        w = model.project(_matrix(batch.column(0), len(model.sums)))[:, model.live]
        if not len(w):
            continue
        part = w.mean(axis=0)
        off = w - part
        if mean is None:
            n, mean, m2 = len(w), part, off.T @ off
        else:
            n, mean, m2 = _merged(n, mean, m2, len(w), part, off.T @ off)
    if n:
        yield pa.RecordBatch.from_pydict({"n": [n], "mean": [list(mean)], "m2": [list(m2.ravel())]},
                                         pa.schema([("n", pa.int64()), ("mean", pa.list_(pa.float64())), ("m2", pa.list_(pa.float64()))]))


def _merged(n, mean, m2, other_n, other_mean, other_m2):
    both, gap = n + other_n, other_mean - mean
    return both, mean + gap * (other_n / both), m2 + other_m2 + np.outer(gap, gap) * (n * other_n / both)


def fit(quantised: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Fit on the distinct vectors of ``quantised`` (see ``quantise``); None without any entry."""
    listed = store(quantised.select("x").distinct())
    first = listed.first()
    d = len(first.x) if first else 0
    if d == 0:
        return None
    sums = listed.mapInArrow(lambda b: _sums(b, d), "dim int, s string").groupBy("dim").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    found = {r.dim: int(r.s) for r in sums.collect()}  # one row for each dimension
    n, k = found[-1], min(components, d)
    model = Whitening(n, [found[i] for i in range(d)], np.zeros(0), np.zeros((d, 0)), 0.0)
    parts = store(listed.mapInArrow(lambda b: _reduce(b, model), "part long, r array<double>"))
    count = parts.agg(F.max("part")).first()[0] + 1

    def stacked(table: pa.Table) -> np.ndarray:
        return np.array(table.column("r").to_pylist(), np.float64).reshape(-1, d)

    while count > FAN_IN:
        parts = store(parts.withColumn("part", F.floor(F.col("part") / FAN_IN)).groupBy("part").applyInArrow(
            lambda t: _lines(t.column("part")[0].as_py(), _triangle(stacked(t))), "part long, r array<double>"))
        count = -(-count // FAN_IN)
    lines = parts.withColumn("part", F.lit(0).cast("long")).groupBy("part").applyInArrow(lambda t: _solve(_triangle(stacked(t)), n, k), "part long, r array<double>")
    solved = [r.r for r in lines.orderBy("part").collect()]  # components + 1 rows
    model = Whitening(n, model.sums, np.array([v[0] for v in solved[1:]]), np.array([v[1:] for v in solved[1:]]).T, solved[0][0])
    if not model.live.any():
        return model
    total = None
    for r in listed.mapInArrow(lambda b: _checked(b, model), "n long, mean array<double>, m2 array<double>").toLocalIterator():  # a row a task
        part = (r.n, np.array(r["mean"]), np.array(r.m2).reshape(len(r["mean"]), -1))
        total = part if total is None else _merged(*total, *part)
    error = float(np.max(np.abs(total[2] / n - np.eye(len(total[1])))))
    return Whitening(n, model.sums, model.values, model.directions, model.trace, error)


def _apply(batches, model: Whitening, schema: pa.Schema):
    d, k = len(model.sums), len(model.values)
    explained = [float(v) / model.trace if model.trace > 0 else None for v in model.values]
    for batch in batches:
        x = _matrix(batch.column(1), d)
        w = model.project(x).ravel()
        rows = len(x)
        dead = np.tile(~model.live, rows)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(np.arange(rows), k)).cast(pa.int64()) if rows == 0 else batch.column(0).take(pa.array(np.repeat(np.arange(rows), k))),
            pa.array(np.tile(np.arange(1, k + 1), rows), pa.int32()), pa.array([model.n] * (rows * k), pa.int64()),
            pa.array([v for v in model.deviations(x) for _ in range(k)], pa.int64()), pa.array(w, pa.float64(), mask=dead),
            pa.array(explained * rows, pa.float64()), pa.array([model.identity_error] * (rows * k), pa.float64())], schema=schema)


RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
_RESULT = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()),
                     ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])


def whiten(df: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Whitened coordinates of ``df(vec_id, embedding)``: a row for each whole vector and component."""
    rows = quantise(df, [F.col("vec_id").cast("long").alias("vec_id")])
    model = fit(rows, components)
    if model is None:
        return df.sparkSession.createDataFrame([], RESULT)
    return rows.mapInArrow(lambda b: _apply(b, model, _RESULT), RESULT)
