"""Simple-8b word-aligned coding of ids, in numpy.

Every 64-bit word has a 4-bit selector and 60 bits that hold a fixed number of ids of a fixed width. Ids are
coded in blocks; the payload has the index of each block's first word, so blocks decode independently and
all words of one selector are unpacked at once. An id of 2^60 or more is an escape: its word holds a place in
a list of whole 64-bit ids behind the words.

Payload, little-endian: ids u64, words u64, escapes u64, ids per block u64, first word of every block u32,
words u64, escapes u64.
"""

from __future__ import annotations

import numpy as np

BLOCK = 4096
#: (ids, bits of each) by selector; 0 is the escape.
COUNT = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTH = np.array([60, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
_PAD = 120
_BOUND = np.array([1 << int(w) for w in WIDTH[1:]], np.uint64)  # first id too large for selectors 1, 2, ...
_TABLE = (np.searchsorted(_BOUND, np.arange(1 << 16, dtype=np.uint64), "right") + 1).astype(np.uint8)


def _tightest(ids: np.ndarray) -> np.ndarray:
    """For every id the last selector position that fits it (16: none does)."""
    if len(ids) and ids.max() < len(_TABLE):
        return _TABLE[ids]
    return (np.searchsorted(_BOUND, ids, "right") + 1).astype(np.uint8)


def _selectors(need: np.ndarray) -> np.ndarray:
    """The selector that packs most ids, for a word that begins at any place of a block (rows: blocks)."""
    out = np.where(need > 15, 0, 15).astype(np.uint8)
    top, have = need, 1
    for s in range(14, 0, -1):
        count = int(COUNT[s])
        while have < count:
            step = min(have, count - have)
            top = np.maximum(top[:, :top.shape[1] - step], top[:, step:])
            have += step
        fits = top <= s
        if not fits.any():  # no run of ids fits; longer runs of narrower ids don't either
            break
        out[:, :fits.shape[1]][fits] = s
    return out


def encode(ids: np.ndarray, block: int = BLOCK) -> bytes:
    ids = np.asarray(ids, np.uint64)
    n, blocks = len(ids), -(-len(ids) // block)
    padded = np.zeros((blocks, block + _PAD), np.uint64)
    full = np.zeros(blocks * block, np.uint64)
    full[:n] = ids
    padded[:, :block] = full.reshape(blocks, block)
    length = np.full(blocks, block)
    if blocks:
        length[-1] = n - (blocks - 1) * block
    sel = _selectors(np.pad(_tightest(full).reshape(blocks, block), ((0, 0), (0, _PAD)), constant_values=1))
    steps, at, rows = [], np.zeros(blocks, np.int64), np.arange(blocks)
    while len(rows):  # one word of every unfinished block
        s = sel[rows, at[rows]]
        steps.append((rows, at[rows], s))
        at[rows] += COUNT[s]
        rows = rows[at[rows] < length[rows]]
    row, col, s = (np.concatenate([x[i] for x in steps]) if steps else np.zeros(0, np.int64) for i in range(3))
    order = np.lexsort((col, row))
    row, col, s = row[order], col[order], s[order].astype(np.int64)
    words = s.astype(np.uint64) << np.uint64(60)
    line, place = padded.reshape(-1), row * (block + _PAD) + col
    for k in range(2, 16):
        w = np.flatnonzero(s == k)
        if len(w):
            at, word = place[w], words[w]
            for lane in range(COUNT[k]):
                word |= line[at + lane] << np.uint64(lane * WIDTH[k])
            words[w] = word
    escape = np.flatnonzero(s == 0)
    words[escape] |= np.arange(len(escape), dtype=np.uint64)
    first = np.searchsorted(row, np.arange(blocks))
    head = np.array([n, len(words), len(escape), block], "<u8")
    return b"".join([head.tobytes(), first.astype("<u4").tobytes(), words.astype("<u8").tobytes(),
                     padded[row[escape], col[escape]].astype("<u8").tobytes()])


def decode(payload: bytes) -> np.ndarray:
    n, n_words, n_escapes, block = (int(x) for x in np.frombuffer(payload, "<u8", 4))
    blocks = -(-n // block)
    first = np.frombuffer(payload, "<u4", blocks, 32).astype(np.int64)
    words = np.frombuffer(payload, "<u8", n_words, 32 + 4 * blocks)
    escapes = np.frombuffer(payload, "<u8", n_escapes, 32 + 4 * blocks + 8 * n_words)
    s = (words >> np.uint64(60)).astype(np.int64)
    ends = np.cumsum(COUNT[s])
    row = np.searchsorted(first, np.arange(n_words), "right") - 1
    before = np.concatenate([[0], ends])
    col = before[:-1] - before[first][row] if blocks else before[:-1]
    out = np.zeros((blocks, block + _PAD), np.uint64)
    line, place = out.reshape(-1), row * (block + _PAD) + col
    for k in range(2, 16):
        w = np.flatnonzero(s == k)
        if len(w):
            at, word, mask = place[w], words[w], np.uint64((1 << int(WIDTH[k])) - 1)
            for lane in range(COUNT[k]):
                line[at + lane] = (word >> np.uint64(lane * WIDTH[k])) & mask
    w = np.flatnonzero(s == 0)
    out[row[w], col[w]] = escapes[(words[w] & np.uint64((1 << 60) - 1)).astype(np.int64)]
    return out[:, :block].reshape(-1)[:n]
