"""BPE encoding and decoding.

A word's symbols form a doubly linked list; a priority queue holds the possible merges as (rank, position) and entries that
an earlier merge made stale are skipped when popped. Decoding concatenates the vocabulary's byte strings. Words repeat, so
each worker remembers the ids of the words it has met, up to a fixed number of them.

Defined results: null or empty text has no ids and decodes to an empty text; a text of any length is encoded whole; rows are
handled one by one, so ties, repeated rows and other columns make no difference.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from array import array
from collections.abc import Iterator

import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import by_batch, id_text, load

#: Words whose ids a worker remembers; beyond it the memory starts anew.
REMEMBERED = 250_000
#: Longer words are not remembered.
LONG_WORD = 64

_TABLES: dict[str, "ByteBpe"] = {}


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies: printable Latin-1 stands for itself, the rest follows from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + len(letters) - len(plain))
    return letters


def merge_word(symbols: list[int], ranks: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Merge neighbours by rank, the leftmost first among equals. ranks: pair of ids -> (rank, merged id)."""
    n = len(symbols)
    if n < 2:
        return symbols
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    queue = [(m[0], i, m[1], symbols[i], symbols[i + 1]) for i in range(n - 1) if (m := ranks.get((symbols[i], symbols[i + 1])))]
    heapq.heapify(queue)
    while queue:
        _, i, new, a, b = heapq.heappop(queue)
        j = after[i]
        if symbols[i] != a or j < 0 or symbols[j] != b:  # stale: one of the two has been merged meanwhile
            continue
        symbols[i], symbols[j] = new, -1
        k = after[i] = after[j]
        after[j] = -1
        if k >= 0:
            before[k] = i
            if m := ranks.get((new, symbols[k])):
                heapq.heappush(queue, (m[0], i, m[1], new, symbols[k]))
        if (h := before[i]) >= 0 and (m := ranks.get((symbols[h], new))):
            heapq.heappush(queue, (m[0], h, m[1], symbols[h], new))
    return [s for s in symbols if s >= 0]


class ByteBpe:
    """A byte-level BPE vocabulary in the file format of the tokenizers library."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        of_letter = {c: b for b, c in letters.items()}
        self.first = [vocab[letters[b]] for b in range(256)]
        self.ranks = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.ranks.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.strings = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]))
        for token, i in vocab.items():
            self.strings[i] = bytes(of_letter[c] for c in token)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in self.added.items():
            self.strings[i] = token.encode()
        self.words = regex.compile(public_tokenizers.PATTERN)
        self.split_added = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.known: dict[str, bytes] = {}

    def word(self, word: str) -> bytes:
        """The ids of a word as 32-bit integers."""
        first = self.first
        out = array("I", merge_word([first[b] for b in word.encode()], self.ranks)).tobytes()
        if len(word) <= LONG_WORD:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[word] = out
        return out

    def _plain(self, text: str) -> bytes:
        known, word = self.known.get, self.word
        return b"".join([known(w) or word(w) for w in self.words.findall(text)])

    def encode(self, text: str) -> bytes:
        """Ids of the text as little-endian unsigned 32-bit integers; the strings of added tokens become their ids."""
        if self.split_added is None or not any(t in text for t in self.added):
            return self._plain(text)
        return b"".join(array("I", [self.added[part]]).tobytes() if part in self.added else self._plain(part) for part in self.split_added.split(text) if part)

    def decode(self, ids: bytes) -> str:
        strings = self.strings
        return b"".join([strings[i] for i in array("I", ids)]).decode("utf-8", "replace")


def tables(path: str) -> ByteBpe:
    """The vocabulary at path, read once by each worker."""
    if path not in _TABLES:
        _TABLES[path] = ByteBpe(path)
    return _TABLES[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (binary, little-endian unsigned 32-bit integers) of each row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = tables(path)
        ids = [bpe.encode(t) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return id_text(docs).mapInArrow(by_batch(run), "doc_id long, ids binary")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Encode and decode each row: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = tables(path)
        n, a, b = [], [], []
        for text in _texts(batch):
            ids = bpe.encode(text)
            n.append(len(ids) // 4)
            a.append(hashlib.sha256(ids).hexdigest())
            b.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return id_text(docs).mapInArrow(by_batch(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _texts(batch: pa.RecordBatch) -> Iterator[str]:
    column = batch.column("text")
    for i in range(len(column)):
        yield column[i].as_py()


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
