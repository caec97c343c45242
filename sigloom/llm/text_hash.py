"""Vectorised hashes of words and word windows, straight from Arrow's UTF-8 buffers.

A word's hash is a polynomial over its bytes modulo 2^64: with running sums of ``value * P^position`` the
hash of any byte range is one subtraction and one multiplication by an inverse power, so a whole batch of
texts is hashed without a Python object per word. Windows of words use the same trick on word hashes.
Equal 64-bit hashes are taken as equal words or windows.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

PIECE = 1 << 18          # bytes hashed at once; longer texts are cut between words
SLICE = 1 << 19          # bytes of texts handled together (a longer text alone)
_M64 = (1 << 64) - 1
_P = 0x9E3779B97F4A7C15  # any odd number has an inverse modulo 2^64
_Q = 0xD1342543DE82EF95


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]), dtype=np.uint64)


class _Powers:
    """Powers of a base and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse, self.n = base, pow(base, -1, 1 << 64), -1

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(2 * n, 1 << 16)
            self.up, self.down = _powers(self.base, self.n), _powers(self.inverse, self.n)
        return self.up, self.down


_BYTES, _WORDS = _Powers(_P), _Powers(_Q)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_Q))
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
CASED = _VALUE
_fold = np.arange(256)
_fold[65:91] += 32
FOLDED = _VALUE[_fold]       # A-Z hash like a-z
NO_WORD = np.ones(256, bool)  # everything but ASCII letters, digits and the bytes of other characters
NO_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


try:
    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library
    _trim = None


def give_back() -> None:
    """Return freed memory to the system; a Python worker lives on and would keep its largest batch's."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows (null: empty)."""
    give_back()
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0]:offs[-1]], offs.astype(np.int64) - int(offs[0])


def slices(offs: np.ndarray, limit: int = SLICE):
    """Row ranges ``[i, j)`` whose bytes stay within ``limit``, or single rows."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def words(buf: np.ndarray, offs: np.ndarray, sep: np.ndarray = SPACE,
          value: np.ndarray = CASED) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and for each text the index of its first word (one more entry at the end)."""
    hashes, places, pos, n = [], [], 0, len(buf)
    breaks = np.unique(offs[(offs > 0) & (offs < n)])
    while pos < n:
        end = min(pos + PIECE, n)
        if end < n:
            nxt = int(np.searchsorted(breaks, end))
            stop = int(breaks[nxt]) if nxt < len(breaks) else n
            while end < stop:
                gap = np.flatnonzero(sep[buf[end:min(end + 65536, stop)]])
                if len(gap):
                    end += int(gap[0])
                    break
                end = min(end + 65536, stop)
        piece = buf[pos:end]
        live = ~sep[piece]
        cut = np.zeros(len(piece) + 1, bool)  # a text begins here
        cut[breaks[(breaks >= pos) & (breaks < end)] - pos] = True
        before = np.concatenate([[False], live[:-1]])
        after = np.concatenate([live[1:], [False]])
        s = np.flatnonzero(live & (~before | cut[:-1]))
        e = np.flatnonzero(live & (~after | cut[1:])) + 1
        up, down = _BYTES.upto(len(piece))
        run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value[piece] * up[:len(piece)], dtype=np.uint64)])
        hashes.append(mix((run[e] - run[s]) * down[s]))
        places.append(s + pos)
        pos = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offs), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(places), offs)


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all ``k`` consecutive values (those that cross texts too: the caller masks them)."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    up, down = _WORDS.upto(len(h))
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[:len(h)], dtype=np.uint64)])
    return mix((run[k:] - run[:-k]) * down[:len(h) - k + 1] + np.uint64(k))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` consecutive values, by doubling."""
    have, out = 1, x
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[:len(out) - step], out[step:])
        have += step
    return out


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the ``k``-word shingles of one text (all its words if fewer)."""
    if len(h) == 0:
        return np.zeros(0, np.uint64)
    return np.unique(windows(h, min(k, len(h))))
