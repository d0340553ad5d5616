"""Token ids in fixed-width bit-packed files.

File format (little-endian), one shard per file:
  8 bytes magic "MOTIDS2\\0"; uint32 bits per id; uint32 ids per block; uint64 documents; uint64 ids;
  uint64 documents whose doc_id is null, which come first; int64[documents] doc_id (0 for these); uint64[documents + 1] first id of each document, within the shard;
  uint64[blocks + 1] byte offsets of the blocks within the payload; payload: blocks of packed ids, each padded to whole bytes.
Each id takes the fewest bits that hold the vocabulary's largest id. A block is unpacked by vectorised numpy, and any range of
ids is read by opening only the blocks that it touches.

Documents are dealt out by ranges of (doc_id, hash of the text), so that partitions, shards and documents are all in ascending order and a task
holds one shard of bounded size at a time. Offsets across shards come from a manifest with one row per shard.

Defined results: null or empty text has only the end id; a null doc_id sorts first; equal doc_ids are ordered by a hash of
the text, then by the text; an empty table writes no shard and reads back empty; other columns play no part.
"""

from __future__ import annotations

import gc
import os
import struct
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import sharedfs
from .bpe import byte_letters
from .common import cut, id_text, load, pieces, scratch

MAGIC = b"MOTIDS2\0"
HEAD = struct.Struct("<8sIIQQQ")
BLOCK_IDS = 4096
#: Ids in a shard before the next one begins; a single longer document makes a longer shard.
SHARD_IDS = 4 << 20
END_ID = 2
#: Words in the younger half of a worker's memory; beyond it that half becomes the older one.
REMEMBERED = 500_000
LONG_WORD = 64
#: Commonest words, and tokens after which they are chosen.
HOT, SETTLED = 16_384, 1_000_000
MARKS = ".,;:!?$%&*#@^~+=_()[]{}\"/-"
#: Letters below this one are composed and in lower case letter by letter.
LATIN_END = "\u0180"

_ENCODERS: dict[str, "WordEncoder"] = {}


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids in `bits` bits each, lowest bit first, padded to a whole byte."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    return np.packbits(((ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1).astype(np.uint8), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return flat.astype(np.uint32) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


def shard_chunks(doc_ids: list[int | None], docs: list[bytes], bits: int, block: int = BLOCK_IDS) -> Iterator[bytes]:
    """The bytes of a shard file. docs: the ids of each document, as little-endian unsigned 32-bit integers."""
    starts = np.zeros(len(docs) + 1, np.uint64)
    starts[1:] = np.cumsum([len(d) // 4 for d in docs])
    ids = np.frombuffer(b"".join(docs), "<u4")
    blocks = [pack(ids[i : i + block], bits) for i in range(0, len(ids), block)]
    offsets = np.zeros(len(blocks) + 1, np.uint64)
    offsets[1:] = np.cumsum([len(b) for b in blocks])
    yield HEAD.pack(MAGIC, bits, block, len(docs), len(ids), sum(i is None for i in doc_ids))
    yield np.array([i or 0 for i in doc_ids], "<i8").tobytes()
    yield starts.astype("<u8").tobytes()
    yield offsets.astype("<u8").tobytes()
    yield from blocks


class Shard:
    """Random access to a shard file."""

    def __init__(self, uri: str) -> None:
        where, path = sharedfs.resolve(uri)
        self.file = where.open_input_file(path)
        magic, self.bits, self.block, n_docs, self.n_ids, self.n_null = HEAD.unpack(self.file.read_at(HEAD.size, 0))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no shard of token ids")
        n_blocks = -(-self.n_ids // self.block)
        at = HEAD.size
        self.doc_ids = np.frombuffer(self.file.read_at(8 * n_docs, at), "<i8")
        at += 8 * n_docs
        self.starts = np.frombuffer(self.file.read_at(8 * (n_docs + 1), at), "<u8").astype(np.int64)
        at += 8 * (n_docs + 1)
        self.offsets = np.frombuffer(self.file.read_at(8 * (n_blocks + 1), at), "<u8").astype(np.int64)
        self.payload = at + 8 * (n_blocks + 1)

    def ids(self, first: int, end: int) -> np.ndarray:
        """Ids first..end of the shard, opening only the blocks they lie in."""
        if first >= end:
            return np.zeros(0, np.uint32)
        a, b = first // self.block, -(-end // self.block)
        data = self.file.read_at(int(self.offsets[b] - self.offsets[a]), self.payload + int(self.offsets[a]))
        parts = [unpack(data[int(self.offsets[k] - self.offsets[a]) : int(self.offsets[k + 1] - self.offsets[a])], self.bits, min(self.block, self.n_ids - k * self.block)) for k in range(a, b)]
        return np.concatenate(parts)[first - a * self.block : end - a * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))

    def close(self) -> None:
        self.file.close()


def plain_latin(word: str) -> bool:
    """Latin letters only, before and after they are put in lower case."""
    low = word.lower()
    return low.isalpha() and word.isalpha() and max(low) < LATIN_END and max(word) < LATIN_END


class WordEncoder:
    """Encodes by the tokenizers library, a word between spaces or line ends at a time, each distinct word once.

    The vocabulary drops white space and no merge or special token spans it, so the ids of a text are those of its words. It
    also splits letters from the marks behind them, so these are encoded apart where the letters are Latin ones that stay letters
    in lower case; elsewhere a letter may be taken apart, and what it ends in belongs to the marks. Latin letters need no more of the library's
    normalisers than lower case and no more of its splitters than its letters for bytes; they go straight to its BPE model."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.vocabulary = 1 + max(self.library.get_vocab(with_added_tokens=True).values())
        self.letters = {b: ord(c) for b, c in byte_letters().items()}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.hot: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        self.counts: Counter = Counter()
        self.met = 0

    def _ids(self, word: str) -> bytes:
        """Ids of letters or marks, whatever they are."""
        if plain_latin(word):
            low = word.lower()
            letters = low if low.isascii() else low.encode().decode("latin-1").translate(self.letters)
            return array("I", [t.id for t in self.library.model.tokenize(letters)]).tobytes()
        return array("I", self.library.encode(word, add_special_tokens=False).ids).tobytes()

    def _meet(self, words: set[str]) -> dict[str, bytes]:
        """Ids of words that are not in the younger half of the memory."""
        if len(self.known) + len(words) > REMEMBERED:
            self.older = dict(self.known)
            self.known.clear()
        known, older, ids, own = self.known, self.older, self._ids, {}
        for w in words:
            x = older.get(w)
            if x is None:
                stem = w.rstrip(MARKS)
                tail = w[len(stem) :] if plain_latin(stem) else ""
                if not tail:
                    stem = w
                if stem.isascii() and "<|" not in stem:
                    stem = stem.lower()
                x = known.get(stem)
                if x is None:
                    x = older.get(stem)
                    if x is None:
                        x = ids(stem)
                    if len(stem) <= LONG_WORD:
                        known[stem] = x
                if tail:
                    end = self.tails.get(tail)
                    if end is None:
                        end = ids(tail)
                        if len(tail) <= 8 and len(self.tails) < 10_000:
                            self.tails[tail] = end
                    x += end
            own[w] = x
            if len(w) <= LONG_WORD:
                known[w] = x
        return own

    def encode(self, texts: list[str], end: bytes = b"") -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers, followed by end."""
        watched = gc.isenabled()
        gc.disable()  # nothing here makes cycles, and the collector would walk millions of words again and again
        try:
            return self._encode(texts, end)
        finally:
            if watched:
                gc.enable()

    def _encode(self, texts: list[str], end: bytes) -> list[bytes]:
        docs = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        if self.met < SETTLED:  # the commonest words get a small table of their own, which stays in the processor's caches
            self.counts.update(chain.from_iterable(docs))
            self.met += sum(map(len, docs))
            if self.met >= SETTLED:
                self.hot = {w: x for w, _ in self.counts.most_common(HOT) if (x := self.known.get(w)) is not None}
                self.counts.clear()
        get, known = self.hot.get, self.known.get
        ids = [[*map(get, doc)] for doc in docs]
        gaps = []
        for doc, own in zip(docs, ids):
            at = []
            for i, x in enumerate(own):
                if x is None:
                    x = own[i] = known(doc[i])
                    if x is None:
                        at.append(i)
            if at:
                gaps.append((doc, own, at))
        if gaps:
            met = self._meet({doc[i] for doc, _, at in gaps for i in at})
            for doc, own, at in gaps:
                for i in at:
                    own[i] = met[doc[i]]
        for own in ids:
            own.append(end)
        return [b"".join(own) for own in ids]


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def write(docs: DataFrame, path: str, folder: str, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Write all documents as shards in folder, in ascending doc_id order. Returns the manifest: uri, part, k, n_docs, n_ids, start."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(path), TaskContext.get().partitionId()
        bits, end, k = bits_for(max(enc.vocabulary, end_id + 1)), array("I", [end_id]).tobytes(), 0
        ids, held, total = [], [], 0

        def shard() -> pa.RecordBatch:
            uri = f"{folder}/part-{part:06d}-{k:06d}.ids"
            sharedfs.write_whole(uri, shard_chunks(ids, held, bits))
            return pa.RecordBatch.from_pydict({"uri": [uri], "part": [part], "k": [k], "n_docs": [len(held)], "n_ids": [total]}, schema=pa.schema({"uri": pa.string(), "part": pa.int64(), "k": pa.int64(), "n_docs": pa.int64(), "n_ids": pa.int64()}))

        for batch in batches:
            for piece in pieces(batch):
                for i, x in zip(piece.column("doc_id").to_pylist(), enc.encode(piece.column("text").to_pylist(), end)):
                    if held and total + len(x) // 4 > shard_ids:
                        yield shard()
                        ids, held, total, k = [], [], 0, k + 1
                    ids.append(i)
                    held.append(x)
                    total += len(x) // 4
        if held:
            yield shard()

    keyed = id_text(docs).withColumn("tk", F.xxhash64("text"))
    ordered = keyed.repartitionByRange(n, "doc_id", "tk").sortWithinPartitions("doc_id", "tk", "text").drop("tk")
    shards = cut(ordered.mapInArrow(run, "uri string, part long, k long, n_docs long, n_ids long"), "manifest")
    # one row per partition; the running sum over them and then over a partition's shards keeps any single task small
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = parts.withColumn("before", F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select("part", F.coalesce("before", F.lit(0)).alias("before"))
    inside = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return shards.withColumn("inside", inside).join(before, "part").select("uri", "part", "k", "n_docs", "n_ids", (F.col("before") + F.col("inside")).cast("long").alias("start"))


def read(manifest: DataFrame) -> DataFrame:
    """Documents of the shards named by a manifest: doc_id, start, n_tokens, ids (binary, little-endian unsigned 32-bit)."""
    return _dealt(manifest).mapInArrow(_reader(lambda x: x.astype("<u4").tobytes(), pa.binary(), "ids"), "doc_id long, start long, n_tokens long, ids binary")


def digests(manifest: DataFrame) -> DataFrame:
    """As read(), with ids_crc32 for ids."""
    return _dealt(manifest).mapInArrow(_reader(lambda x: zlib.crc32(x.astype("<u4").tobytes()), pa.int64(), "ids_crc32"), "doc_id long, start long, n_tokens long, ids_crc32 long")


def _dealt(manifest: DataFrame) -> DataFrame:
    """A shard or a few to each task; the manifest itself is small."""
    return manifest.select("uri", "start").repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "uri")


def _reader(f, kind: pa.DataType, name: str):
    schema = pa.schema({"doc_id": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64(), name: kind})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard = Shard(uri)
                n = len(shard.doc_ids)
                a = 0
                while a < n:  # about a million ids at a time
                    b = max(a + 1, int(np.searchsorted(shard.starts, shard.starts[a] + (1 << 20), "right")) - 1)
                    ids = shard.ids(int(shard.starts[a]), int(shard.starts[b]))
                    own = shard.starts[a : b + 1] - shard.starts[a]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(shard.doc_ids[a:b], mask=np.arange(a, b) < shard.n_null),
                            pa.array((shard.starts[a:b] + start).astype(np.int64)),
                            pa.array(np.diff(own).astype(np.int64)),
                            pa.array([f(ids[own[i] : own[i + 1]]) for i in range(b - a)], kind),
                        ],
                        schema=schema,
                    )
                    a = b
                shard.close()

    return run


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), scratch(spark, "ids"))
    return digests(cut(manifest, "shards"))
