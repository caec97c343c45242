"""Singular values and right singular vectors of a small matrix by quotient-difference transforms.

Householder reflections bring the matrix to an upper bidiagonal B. The squares of B's entries form a qd array;
shifted differential qd transforms (dqds) find the eigenvalues of B'B without subtractions that cancel. A vector
comes from the twisted factorisation of B'B - s for one eigenvalue s: a stationary transform from the top and a
progressive one from the bottom meet where the residual is least.
"""

from __future__ import annotations

import numpy as np

EPS = float(np.finfo(np.float64).eps)
TINY = float(np.finfo(np.float64).tiny)


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal and upper diagonal of B, and the reflection vectors that act on the columns."""
    a = np.array(r, np.float64)
    d = a.shape[1]
    if a.shape[0] < d:
        a = np.vstack([a, np.zeros((d - a.shape[0], d))])
    right = []

    def reflector(x: np.ndarray) -> np.ndarray | None:
        norm = np.linalg.norm(x)
        if norm == 0 or not np.any(x[1:]):
            return None
        v = x / norm
        v[0] += 1.0 if v[0] >= 0 else -1.0
        return v / np.linalg.norm(v)

    for k in range(d):
        if (v := reflector(a[k:, k].copy())) is not None:
            a[k:, k:] -= 2.0 * np.outer(v, v @ a[k:, k:])
        if k + 2 < d and (v := reflector(a[k, k + 1:].copy())) is not None:
            a[k:, k + 1:] -= 2.0 * np.outer(a[k:, k + 1:] @ v, v)
            right.append((k + 1, v))
    return np.diagonal(a).copy(), np.diagonal(a, 1).copy(), right


def from_bidiagonal(z: np.ndarray, right: list) -> np.ndarray:
    """Columns ``z`` of the bidiagonal's basis in the basis of the matrix."""
    z = z.copy()
    for k, v in reversed(right):
        z[k:] -= 2.0 * np.outer(v, v @ z[k:])
    return z


def _sweep(q: list[float], e: list[float], shift: float):
    """One dqds transform: the new arrays and all values of d, or None when the shift was too large."""
    n, d = len(q), q[0] - shift
    nq, ne, ds = [], [], [d]
    for i in range(n - 1):
        if d < 0:
            return None
        top = d + e[i]
        if top <= 0:
            nq.append(0.0)
            ne.append(0.0)
            d = q[i + 1] - shift
        else:
            t = q[i + 1] / top
            nq.append(top)
            ne.append(e[i] * t)
            d = d * t - shift
        ds.append(d)
    if not d >= 0:
        return None
    return nq + [d], ne, ds


def dqds(q: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Eigenvalues of B'B in falling order from its squared diagonal ``q`` and upper diagonal ``e``."""
    found: list[float] = []
    tol = (10 * EPS) ** 2
    blocks = [(list(map(float, q)), list(map(float, e)), 0.0)]
    while blocks:
        q, e, base = blocks.pop()
        while q:
            n = len(q)
            if n == 1:
                found.append(base + q[0])
                break
            if e[-1] <= tol * (base + q[-1]) or e[-1] <= TINY:
                found.append(base + q[-1])
                q, e = q[:-1], e[:-1]
                continue
            cut = next((i for i in range(n - 2, -1, -1) if e[i] <= TINY or e[i] <= tol * (base + min(q[i], q[i + 1]))), None)
            if cut is not None:
                blocks.append((q[:cut + 1], e[:cut], base))
                q, e = q[cut + 1:], e[cut + 1:]
                continue
            if q[0] < q[-1] / 4:  # graded the wrong way: the reversed array has the same eigenvalues
                q, e = q[::-1], e[::-1]
            plain = _sweep(q, e, 0.0)
            ds = plain[2]
            low = min(ds)
            # The sum of the reciprocals is the trace of the inverse, so its reciprocal is a safe shift.
            safe = 0.0 if low <= 0 else 1.0 / sum(1.0 / d for d in ds)
            # The smaller eigenvalue of the last two rows is near the smallest one when the end has settled.
            x, y, z = q[-2] + (e[-2] if n > 2 else 0.0), q[-1] + e[-1], q[-2] * e[-1]
            half = (x + y) / 2
            root = np.sqrt(max(((x - y) / 2) ** 2 + z, 0.0))
            near = (x * y - z) / (half + root) if half + root > 0 else 0.0
            step = None
            for shift in (min(near, low) * (1 - 4 * EPS), safe * (1 - 4 * n * EPS)):
                if shift > 0 and (step := _sweep(q, e, shift)) is not None:
                    base += shift
                    break
            q, e = (step or plain)[:2]
    return np.sort(np.array(found))[::-1]


def _twisted(q: np.ndarray, ratio: np.ndarray, value: float):
    """Factors from both ends of ``L Q L' - value`` and the residual at every twist position."""
    n = len(q)
    guard = EPS * max(float(np.max(q)), TINY) * EPS + TINY
    down, s, above = np.zeros(n - 1), np.zeros(n), np.zeros(n)
    s[0] = -value
    for i in range(n - 1):
        pivot = s[i] + q[i]
        above[i] = pivot = pivot if abs(pivot) > guard else guard
        down[i] = q[i] * ratio[i] / pivot
        s[i + 1] = down[i] * ratio[i] * s[i] - value
    up, p, below = np.zeros(n - 1), np.zeros(n), np.zeros(n)
    p[-1] = q[-1] - value
    for i in range(n - 2, -1, -1):
        pivot = q[i] * ratio[i] ** 2 + p[i + 1]
        below[i + 1] = pivot = pivot if abs(pivot) > guard else guard
        t = q[i] / pivot
        up[i] = ratio[i] * t
        p[i] = p[i + 1] * t - value
    gamma = s + p + value
    return down, up, np.where(np.abs(gamma) > guard, gamma, guard), above, below


def _vector(down: np.ndarray, up: np.ndarray, at: int) -> np.ndarray:
    z = np.zeros(len(down) + 1)
    z[at] = 1.0
    for i in range(at - 1, -1, -1):
        z[i] = -down[i] * z[i + 1]
    for i in range(at, len(up)):
        z[i + 1] = -up[i] * z[i]
    return z / np.linalg.norm(z)


def _product(a: np.ndarray, b: np.ndarray, z: np.ndarray) -> np.ndarray:
    """``B'B z``."""
    bz = a * z
    bz[:-1] += b * z[1:]
    out = a * bz
    out[1:] += b * bz[:-1]
    return out


def _solved(z: np.ndarray, down, up, gamma, above, below, at: int) -> np.ndarray:
    """A step of inverse iteration: the twisted factors of ``B'B - value`` applied backwards to ``z``."""
    w = z.copy()
    for i in range(at):
        w[i + 1] -= down[i] * w[i]
    for i in range(len(up) - 1, at - 1, -1):
        w[i] -= up[i] * w[i + 1]
    w /= np.r_[above[:at], gamma[at], below[at + 1:]]
    for i in range(at - 1, -1, -1):
        w[i] -= down[i] * w[i + 1]
    for i in range(at, len(up)):
        w[i + 1] -= up[i] * w[i]
    return w / np.linalg.norm(w)


def _apart(z: np.ndarray, known: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for k in known:
            z = z - k * (k @ z)
    return z


def vectors(a: np.ndarray, b: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors (columns) of B'B for its largest eigenvalues ``values``.

    Where eigenvalues lie so close that the vector at the best twist is not new, other twists are tried, and the
    vector is made orthogonal to the earlier ones and sharpened by inverse iteration with the same factors."""
    top = max(float(np.max(np.abs(a))), float(np.max(np.abs(b), initial=0.0)), TINY)
    a = np.where(np.abs(a) > EPS * EPS * top, a, EPS * EPS * top)  # a zero on the diagonal has no ratio
    q, ratio = a * a, b / a[:-1]
    out: list[np.ndarray] = []
    for value in values:
        down, up, gamma, above, below = _twisted(q, ratio, float(value))
        twists = np.argsort(np.abs(gamma), kind="stable")
        best, rest = None, -1.0
        for at in twists:
            z = _apart(_vector(down, up, int(at)), out)
            left = float(np.linalg.norm(z))
            if left > rest and np.isfinite(left):
                best, rest = z, left
            if rest > 0.5:
                break
        z = best / np.linalg.norm(best)
        for _ in range(4):
            if np.linalg.norm(_product(a, b, z) - value * z) <= 4 * EPS * top * top:
                break
            step = _apart(_solved(z, down, up, gamma, above, below, int(twists[0])), out)
            size = np.linalg.norm(step)
            if not size > 0 or not np.isfinite(size):
                break
            z = step / size
        out.append(z)
    return np.array(out).T.reshape(len(a), len(values))


def right_vectors(r: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of ``r'r`` and their unit eigenvectors (columns).

    The sign of a vector makes its largest entry (the first of equals) positive."""
    d = r.shape[1]
    scale = float(np.max(np.abs(r), initial=0.0))
    if scale == 0:
        return np.zeros(k), np.eye(d, k)
    a, b, right = bidiagonalise(r / scale)
    values = dqds(a * a, b * b)[:k]
    found = from_bidiagonal(vectors(a, b, values), right)
    found *= np.sign(found[np.argmax(np.abs(found), axis=0), np.arange(k)])
    return values * scale * scale, found
