"""Suffix sorting by induction, with common prefixes, over queues that spill to files.

The order of the leftmost-S suffixes (those smaller than the suffix after them and preceded by a larger one) determines that
of all others: scanning suffixes in ascending order, each puts the L suffix before it at the front of its character's bucket;
scanning in descending order, each puts the S suffix before it at the back. Both scans pop a priority queue by (character,
arrival) whose tuples carry a position and the common prefix with the tuple popped before; a pushed tuple's common prefix is
one more than the least of those since the last push to its bucket. A batch of tuples is handled at once in numpy. The
leftmost-S substrings are named by sorting; unless the names are unique, the string of names is sorted by recursion while its
alphabet is small against its length, and by doubling else.

Order and common prefixes are exact up to `depth` symbols, which is all that its user needs. The queue keeps `budget` bytes of
tuples in memory and writes the rest to files in the given folder; only the text itself, its types and the leftmost-S
positions stay in memory, a few bytes for each symbol.
"""

from __future__ import annotations

import uuid
from collections import defaultdict, deque
from collections.abc import Callable, Iterator

import numpy as np

from . import sharedfs

#: A string of names is sorted by recursion if it has this many symbols to a name, and more than the least.
REPEATS, LEAST = 256, 1 << 12
#: Bytes compared at a time.
_WIDE = 64


class BucketQueue:
    """Priority queue of (bucket, arrival): tuples of a bucket leave in the order they came. Each push hands over arrays of tuples."""

    def __init__(self, budget: int, folder: str | None) -> None:
        self.budget, self.folder, self.size, self.spilled = budget, folder, 0, 0
        self.chunks: dict[int, deque] = defaultdict(deque)
        self.in_memory: dict[int, int] = defaultdict(int)

    def push(self, bucket: int, positions: np.ndarray, common: np.ndarray) -> None:
        """Tuples in memory always lie behind those on disk, as a spill takes all that a bucket has in memory."""
        chunks = self.chunks[bucket]
        if chunks and not isinstance(chunks[-1], str) and len(chunks[-1][0]) < 1024 and len(positions) < 1024:
            a, b = chunks.pop()
            positions_, common_ = np.concatenate([a, positions]), np.concatenate([b, common])
            chunks.append((positions_, common_))
        else:
            chunks.append((positions, common))
        self.in_memory[bucket] += positions.nbytes + common.nbytes
        self.size += positions.nbytes + common.nbytes
        while self.size > self.budget and self.folder:
            self._spill(max(self.in_memory, key=self.in_memory.get))

    def _spill(self, bucket: int) -> None:
        """Write a bucket's tuples in memory to one file behind those on disk already."""
        chunks = self.chunks[bucket]
        held = []
        while chunks and not isinstance(chunks[-1], str):
            held.append(chunks.pop())
        positions, common = (np.concatenate(x) for x in zip(*reversed(held)))
        path = f"{self.folder}/{uuid.uuid4().hex}.run"
        sharedfs.write_whole(path, [np.int64(len(positions)).tobytes(), positions.astype(np.int64).tobytes(), common.astype(np.uint16).tobytes()])
        self.spilled += 1
        chunks.append(path)
        self.size -= self.in_memory.pop(bucket)

    def pop(self, bucket: int, last: bool = False) -> tuple[np.ndarray, np.ndarray] | None:
        """The first (or last) tuples of a bucket, as many as were handed over together, or None."""
        chunks = self.chunks.get(bucket)
        if not chunks:
            return None
        chunk = chunks.pop() if last else chunks.popleft()
        if isinstance(chunk, str):
            where, path = sharedfs.resolve(chunk)
            with where.open_input_stream(path) as f:
                n = int(np.frombuffer(f.read(8), np.int64)[0])
                chunk = np.frombuffer(f.read(8 * n), np.int64), np.frombuffer(f.read(2 * n), np.uint16)
            where.delete_file(path)
        else:
            self.in_memory[bucket] -= chunk[0].nbytes + chunk[1].nbytes
            self.size -= chunk[0].nbytes + chunk[1].nbytes
        return chunk


def s_types(text: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the one after it; the last one counts as such."""
    n = len(text)
    differs = np.flatnonzero(text[1:] != text[:-1])
    up = np.concatenate([text[differs] < text[differs + 1], [True]])
    return np.repeat(up, np.diff(np.concatenate([[-1], differs, [n - 1]])))


def range_min(values: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function of (first, last) arrays: the least of values[first..last]."""
    table = [values]
    while 2 << (len(table) - 1) <= len(values):
        half = 1 << (len(table) - 1)
        table.append(np.minimum(table[-1][:-half], table[-1][half:]))
    levels = np.array([len(t) for t in table])
    del levels

    def least(first: np.ndarray, last: np.ndarray) -> np.ndarray:
        level = np.frexp((last - first + 1).astype(np.float64))[1] - 1
        out = np.empty(len(first), values.dtype)
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(table[k][first[at]], table[k][last[at] - (1 << k) + 1])
        return out

    return least


class _Scan:
    """One induction scan: takes batches in order and pushes the suffix before each to its bucket."""

    def __init__(self, text: np.ndarray, depth: int, queue: BucketQueue) -> None:
        self.text, self.depth, self.queue = text, depth, queue
        self.since: dict[int, int] = {}  # least common prefix since the last push to a bucket

    def take(self, positions: np.ndarray, common: np.ndarray, chosen: np.ndarray, before: np.ndarray) -> None:
        """common: of each tuple with the one before it in this scan. chosen: indices whose preceding suffix is pushed; before: its character."""
        if len(chosen):
            order = np.argsort(before, kind="stable")
            at, char = chosen[order], before[order]
            new = np.flatnonzero(np.concatenate([[True], char[1:] != char[:-1]]))
            first = np.concatenate([[0], at[:-1] + 1])
            first[new] = 0
            got = np.minimum(range_min(common)(first, at).astype(np.int64) + 1, self.depth)
            ends = np.concatenate([new[1:], [len(char)]])
            suffix = np.minimum.accumulate(common[::-1])[::-1]  # least from an index to the batch's end
            whole = int(suffix[0])
            pushed = set()
            for a, b in zip(new.tolist(), ends.tolist()):
                c = int(char[a])
                known = self.since.get(c)
                got[a] = 0 if known is None else min(int(got[a]), known + 1)
                self.queue.push(c, positions[at[a:b]] - 1, got[a:b].astype(np.uint16))
                tail = int(at[b - 1]) + 1
                self.since[c] = int(suffix[tail]) if tail < len(common) else self.depth
                pushed.add(c)
        else:
            whole, pushed = int(common.min()), ()
        for c in self.since:
            if c not in pushed and self.since[c] > whole:
                self.since[c] = whole


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Symbols that the suffixes at a and b share, up to depth. The text is padded with depth + _WIDE symbols behind its last one."""
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    if text.dtype != np.uint8:
        k = 0
        while len(live) and k < depth:
            live, k = live[text[a[live] + k] == text[b[live] + k]], k + 1
            out[live] = k
        return np.minimum(out, depth)
    k, wide = 0, 8  # most differ in the first bytes; what does not is compared in longer strides
    while len(live) and k < depth:
        rows = np.lib.stride_tricks.as_strided(text, (max(len(text) - wide + 1, 0), wide), (1, 1))
        x = rows[a[live] + k].view(np.uint64) ^ rows[b[live] + k].view(np.uint64)
        at = (x != 0).argmax(1)
        word = x[np.arange(len(x)), at]
        same = word == 0
        low = word[~same]
        out[live[~same]] = k + 8 * at[~same] + (np.frexp((low & (~low + np.uint64(1))).astype(np.float64))[1] - 1) // 8
        live, k, wide = live[same], k + wide, _WIDE
        out[live] = k
    return np.minimum(out, depth)


def leftmost_order(text: np.ndarray, s: np.ndarray, n: int, depth: int, least: int = LEAST, budget: int = 1 << 28, folder: str | None = None) -> np.ndarray:
    """Leftmost-S positions of text[:n] in the order of their suffixes."""
    p = np.flatnonzero(s[1:n] & ~s[: n - 1]) + 1
    if len(p) < 2:
        return p
    q = np.concatenate([p[1:], [n - 1]])
    length = q - p + 1
    length[-1] = 1
    bits = int(2 * int(text[:n].max()) + 1).bit_length()
    each = max(1, 63 // bits)

    def word(k: np.ndarray, at: int) -> np.ndarray:
        key = np.zeros(len(k), np.int64)
        for j in range(at, at + each):
            i = np.minimum(p[k] + j, n - 1)
            key = (key << bits) | np.where(j < length[k], 2 * text[i].astype(np.int64) + s[i], 0)
        return key

    order, rank = _ranked(np.arange(len(p)), word(np.arange(len(p)), 0), np.zeros(len(p), np.int64), len(p))
    at = each
    while True:  # substrings that agree so far and go on
        tied = _tied(order, rank)
        tied = tied[length[tied] > at]
        if not len(tied):
            break
        order, rank = _ranked(tied, word(tied, at), rank, len(p), order)
        at += each
    names = np.cumsum(np.concatenate([[0], (rank[order][1:] != rank[order][:-1]).astype(np.int64)]))
    if names[-1] == len(p) - 1:
        return p[order]
    name = np.empty(len(p), np.int64)
    name[order] = names + 1
    if len(p) > least and (names[-1] + 2) * REPEATS < len(p):
        return p[suffix_order(np.concatenate([name, [0]]), depth, least, budget, folder)[1:]]
    step = 1
    while step < depth:
        tied = _tied(order, rank)
        if not len(tied):
            break
        beyond = tied + step
        key = np.where(beyond < len(p), rank[np.minimum(beyond, len(p) - 1)] + 1, 0)
        order, rank = _ranked(tied, key, rank, len(p), order)
        step *= 2
    return p[order]


def _tied(order: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Members of groups of equal rank, in order."""
    r = rank[order]
    same = np.zeros(len(r) + 1, bool)
    same[1:-1] = r[1:] == r[:-1]
    return order[same[:-1] | same[1:]]


def _ranked(members: np.ndarray, key: np.ndarray, rank: np.ndarray, n: int, order: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Order and ranks after members of tied groups are sorted by key within their group. A rank is the index of its group's first member in the order."""
    if order is None:
        order, rank = np.argsort(key), rank.copy()
        k = key[order]
        first = np.concatenate([[True], k[1:] != k[:-1]])
        rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        return order, rank
    old = rank[members]
    by = np.argsort(old * (int(key.max()) + 1) + key) if int(key.max()) < (1 << 62) // n else np.lexsort((key, old))
    members, key, old = members[by], key[by], old[by]
    begin = np.concatenate([[True], old[1:] != old[:-1]])
    place = old + np.arange(len(old)) - np.maximum.accumulate(np.where(begin, np.arange(len(old)), 0))
    order, rank = order.copy(), rank.copy()
    order[place] = members
    first = begin | np.concatenate([[True], key[1:] != key[:-1]])
    rank[members] = np.maximum.accumulate(np.where(first, place, 0))
    return order, rank


def induce(text: np.ndarray, depth: int, emit: Callable[[int, np.ndarray, np.ndarray, bool], None], budget: int = 1 << 28, folder: str | None = None, least: int = LEAST) -> int:
    """Sort the suffixes of a text that ends with its only least symbol or a separator, 0, and begins with one.

    emit(character, positions, common, s) gets the L suffixes of each character in ascending batches (s False), characters
    ascending, then the S suffixes in descending batches (s True), characters descending; common is shared with the suffix
    handed over before it, 0 at a character's first. Returns the number of files written."""
    n = len(text)
    s = s_types(text)
    leftmost = leftmost_order(text, s, n, depth, least, budget, folder)
    padded = np.concatenate([text, np.zeros(depth + _WIDE, text.dtype)])
    shared = np.zeros(len(leftmost), np.uint16)
    if len(leftmost) > 1:
        shared[1:] = common_prefix(padded, leftmost[:-1], leftmost[1:], depth)
    chars = text[leftmost]
    bounds = np.searchsorted(chars, np.arange(int(text.max()) + 2)) if len(leftmost) else np.zeros(int(text.max()) + 2, np.int64)

    def seam(a: int, b: int) -> int:
        return int(common_prefix(padded, np.array([a]), np.array([b]), depth)[0])

    # ascending scan
    queue, kept = BucketQueue(budget // 2, folder), BucketQueue(budget // 2, folder)
    scan = _Scan(text, depth, queue)
    for c in range(int(text.max()) + 1):
        end = None
        while (chunk := queue.pop(c)) is not None:
            positions, common = chunk
            emit(c, positions, common, False)
            kept.push(c, positions, common)
            before = text[positions - 1]
            chosen = np.flatnonzero(before >= max(c, 1))
            scan.take(positions, common, chosen, before[chosen])
            end = int(positions[-1])
        a, b = int(bounds[c]), int(bounds[c + 1])
        if a < b:
            positions, common = leftmost[a:b], shared[a:b].copy()
            common[0] = 0 if end is None else seam(end, int(positions[0]))
            before = text[positions - 1]
            chosen = np.flatnonzero((before > c) & (positions > 0))
            scan.take(positions, common, chosen, before[chosen])
    # descending scan
    spilled = queue.spilled
    queue = BucketQueue(budget // 2, folder)
    scan = _Scan(text, depth, queue)
    for c in range(int(text.max()), 0, -1):
        end = None
        while (chunk := queue.pop(c)) is not None:
            positions, common = chunk
            emit(c, positions, common, True)
            before = text[positions - 1]
            chosen = np.flatnonzero((before <= c) & (before > 0))
            scan.take(positions, common, chosen, before[chosen])
            end = int(positions[-1])
        larger = None  # common prefix of the chunk's last suffix with the one after it
        while (chunk := kept.pop(c, last=True)) is not None:
            positions, common = chunk
            down = np.empty(len(common), np.uint16)
            down[1:] = common[:0:-1]
            down[0] = larger if larger is not None else (0 if end is None else seam(end, int(positions[-1])))
            larger = int(common[0])
            positions = positions[::-1]
            before = text[positions - 1]
            chosen = np.flatnonzero((before < c) & (before > 0))
            scan.take(positions, down, chosen, before[chosen])
    return spilled + queue.spilled + kept.spilled


def suffix_order(text: np.ndarray, depth: int, least: int = LEAST, budget: int = 1 << 28, folder: str | None = None) -> np.ndarray:
    """All suffixes of a string of symbols above 0 that is ended by 0, in order (exact up to depth)."""
    lows: dict[int, list[np.ndarray]] = defaultdict(list)
    highs: dict[int, list[np.ndarray]] = defaultdict(list)

    def emit(c: int, positions: np.ndarray, common: np.ndarray, s: bool) -> None:
        (highs if s else lows)[c].append(positions - 1)

    shifted = np.concatenate([[0], text])
    induce(shifted, depth, emit, budget, folder, least)
    out = [np.array([len(text) - 1])]
    for c in range(1, int(text.max()) + 1):
        out += lows.get(c, [])
        out += [x[::-1] for x in reversed(highs.get(c, []))]
    return np.concatenate(out)


def repeated_starts(segments: list[np.ndarray], depth: int, budget: int = 1 << 28, folder: str | None = None, report: Callable[[int], None] | None = None) -> Iterator[np.ndarray]:
    """For each byte segment, the starts whose next `depth` bytes also start elsewhere in the segments. report gets the number of files spilled."""
    at = np.cumsum([1, *(len(x) + 1 for x in segments)])
    text = np.zeros(int(at[-1]), np.uint8)
    for a, x in zip(at[:-1].tolist(), segments):
        text[a : a + len(x)] = x + 1
    marked = np.zeros(len(text), bool)
    ends: dict[tuple[int, bool], int] = {}
    edges: dict[int, int] = {}

    def emit(c: int, positions: np.ndarray, common: np.ndarray, s: bool) -> None:
        if c == 0:
            return
        hit = np.flatnonzero(common >= depth)
        marked[positions[hit]] = True
        marked[positions[hit[hit > 0] - 1]] = True
        if len(hit) and hit[0] == 0:
            marked[ends[c, s]] = True
        if not s:
            edges[c] = int(positions[-1])  # the largest L suffix of the character; its smallest S suffix is the last handed over
        ends[c, s] = int(positions[-1])

    spilled = induce(text, depth, emit, budget, folder)
    if report:
        report(spilled)
    padded = np.concatenate([text, np.zeros(depth + _WIDE, np.uint8)])
    for c, low in edges.items():
        high = ends.get((c, True))
        if high is not None and common_prefix(padded, np.array([low]), np.array([high]), depth)[0] >= depth:
            marked[low] = marked[high] = True
    for a, x in zip(at[:-1].tolist(), segments):
        yield np.flatnonzero(marked[a : a + max(0, len(x) - depth + 1)])
