"""Content-defined anchors of byte strings, for a whole batch of texts at once in numpy.

Every string of `length` bytes has one anchor, the leftmost of its `GRAM`-byte substrings with the least hash. Equal strings
have their anchor at the same place, whatever surrounds them, so all places where a string starts share their anchor's bytes.
Consecutive starts with the same anchor form a run; a run is split where the distance to the anchor passes half the window, so
that the starts of a part have a common substring of more than half the length, whose hash is the part's key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .shingles import _powers, mix

GRAM = 64


def prefix_sums(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p, q = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * p[: len(raw)], out=sums[1:])
    return sums, q


def window_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of x[i : i + width] for each i that has as many."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[: len(x) - have], x[have:])
        have *= 2
    if have < width:
        x = np.minimum(x[: len(x) - (width - have)], x[width - have :])
    return x


def parts(raw: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Parts of runs in concatenated texts that end at `ends`: first and last start, how far behind the last one the anchor lies, and key."""
    none = np.zeros(0, np.int64)
    if len(raw) < length:
        return none, none, none, none.view(np.uint64)
    room = length - GRAM + 1
    half = (room + 1) // 2
    sums, q = prefix_sums(raw)
    grams = mix((sums[GRAM:] - sums[:-GRAM]) * q[: len(raw) - GRAM + 1])
    packed = (grams >> np.uint64(24) << np.uint64(24)) | np.arange(len(grams), dtype=np.uint64)
    anchor = (window_min(packed, room) & np.uint64((1 << 24) - 1)).astype(np.int64)
    left = np.repeat(ends, np.diff(np.concatenate([[0], ends])))[: len(anchor)] - np.arange(len(anchor))
    starts = np.flatnonzero(left >= length)
    if not len(starts):
        return none, none, none, none.view(np.uint64)
    anchor = anchor[starts]
    far = anchor - starts >= half
    new = np.empty(len(starts), bool)
    new[0] = True
    new[1:] = (starts[1:] != starts[:-1] + 1) | (anchor[1:] != anchor[:-1]) | (far[1:] != far[:-1])
    at = np.flatnonzero(new)
    first, last = starts[at], starts[np.concatenate([at[1:], [len(starts)]]) - 1]
    anchor, far = anchor[at], far[at]
    # strings that start at most half - 1 before the anchor all cover [anchor, anchor + length - half + 1); the others
    # start at least half before it and cover [anchor - half, anchor - room + 1 + length)
    a = np.where(far, anchor - half, anchor)
    b = np.where(far, anchor - (room - 1) + length, anchor + length - (half - 1))
    key = mix(mix((sums[b] - sums[a]) * q[a]) + far.astype(np.uint64))
    return first, last, anchor - last, key


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, and where each text ends."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets[1:] - offsets[0]
