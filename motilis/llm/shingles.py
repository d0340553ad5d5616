"""Word shingles as 64-bit hashes, computed for a whole batch of texts at once in numpy.

A word's hash is a polynomial in its bytes modulo 2**64, taken from running sums over the batch; a shingle mixes the hashes of
its words in order. Words are `[^\\x20\\x09-\\x0D]+`, as they stand. A text of fewer words than a shingle holds, but at least
one, has the one shingle of all its words; a text without words has none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

WORDS = 5
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_STEP = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads each bit over all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[str, np.ndarray] = {"p": np.ones(1, np.uint64), "q": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["p"]) < n:
        size = 1 << (n - 1).bit_length()
        for name, base in (("p", _P), ("q", _INVERSE)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _POWERS[name] = np.cumprod(a, dtype=np.uint64)
    return _POWERS["p"][:n], _POWERS["q"][:n]


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a string column without nulls, in order, and the number of words before each text (one entry more than texts)."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None or offsets[0] == offsets[-1]:
        return np.zeros(0, np.uint64), np.zeros(len(column) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    inside = ~_SPACE[raw]
    before = np.empty(len(raw), bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[offsets[1:-1][offsets[1:-1] < len(raw)]] = False  # a text's first byte begins a word, whatever ends the text before
    starts = np.flatnonzero(inside & ~before)
    cut = np.zeros(len(raw) + 1, bool)
    cut[offsets] = True
    after = np.zeros(len(raw), bool)
    after[:-1] = inside[1:]
    after &= ~cut[1:]
    ends = np.flatnonzero(inside & ~after) + 1
    p, q = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * p[: len(raw)], out=sums[1:])
    words = mix((sums[ends] - sums[starts]) * q[starts])
    return words, np.searchsorted(starts, offsets)


def shingle_hashes(column: pa.Array, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of a string column without nulls, in order with repeats, and the number of shingles before each text."""
    words, at = word_hashes(column)
    counts = np.diff(at)
    n = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    before = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=before[1:])
    first = np.repeat(at[:-1] - before[:-1], n) + np.arange(before[-1])  # the word each shingle begins with
    room = np.repeat(np.minimum(counts, k), n)  # words in each shingle
    out = room.astype(np.uint64)
    padded = np.concatenate([words, np.zeros(k, np.uint64)])
    for j in range(k):
        w = padded[first + j]
        if j:
            w = np.where(room > j, w, np.uint64(0))
        out = mix(out * _STEP[j % len(_STEP)] + w)
    return out, before


def sets(column: pa.Array, k: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    hashes, before = shingle_hashes(column, k)
    return [np.unique(hashes[a:b]) for a, b in zip(before[:-1].tolist(), before[1:].tolist())]
