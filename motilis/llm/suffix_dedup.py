"""Removal of byte strings that start in more than one place, by suffix sorting.

1. Anchors (anchors.py): every 400-byte string falls into a part of a run, and equal strings fall into parts of one key. Parts
   whose key occurs once hold no repeated string and go no further.
2. A key with very many different parts (a passage that stands in many surroundings) is dealt out anew: its parts are cut into
   pieces of 16 starts at fixed distances from the anchor, whose keys take in all but a few bytes of their strings, so that the
   pieces inside the passage are one and those beyond it fall apart, and pieces that are still that common into single starts.
   Exact, as equal strings have their anchor at one distance.
3. Shards of whole keys go through external induced sorting (induced_sort.py), whose queues spill to files: of parts with equal
   bytes (by a 128-bit cryptographic digest) the first and the last place, of others the only one. Neighbours in suffix order
   with a common prefix of 400 bytes are repeated strings. A start is in one part only, so such neighbours are different places.
   All ranges come from the sort; what it finds for the two places of equal parts holds for the places between them.
   A part takes the 399 bytes behind its last start along. Where the only bytes of a key are followed by the only ones of another
   at both of their places, as inside a long passage, the two are sorted as one chain, which takes such bytes along once: all
   places of their strings are places of those very bytes, so no other shard can hold one.
4. Ranges to remove are gathered per document, joined to the texts and cut out.

Only a document's own ranges are gathered in one place, never those of a key or of the corpus. Tables that meet the texts are
broadcast while their measured size is below `MOST_BYTES`, and shuffled beyond it.

Defined results: null text counts as empty; texts shorter than 400 bytes are kept whole; strings are judged on the input;
overlaps count, so a run of one character longer than 400 bytes repeats itself; rows that repeat doc_id and text are places of
their own; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .anchors import parts, utf8
from .common import cut, id_text, load, pieces, scratch, sized
from .induced_sort import repeated_starts
from .jaccard_join import groups

LENGTH = 400
#: Bytes of text that anchors are found in at a time; a longer text goes through in overlapping stretches.
STRETCH = 2 << 20
#: Bytes of segments after which a shard ends at the next key; a larger key is sorted whole, over spilled queues.
SHARD_BYTES = 2 << 20
#: Starts (as a power of two) at whose multiples a chain of parts ends, so that one of a long document is not a shard by itself.
CHAIN_BITS = 16
#: Bytes of suffix tuples in memory for a shard, a tenth of what a shard's tuples take.
QUEUE_BYTES = 4 << 20
#: Measured size up to which a table is broadcast to meet the texts.
MOST_BYTES = 1 << 20
#: Different parts beyond which a key is dealt out anew, and starts in a piece, at first and then.
HOT_KEY, PIECES = 2000, (16, 1)

_PARTS = pa.schema([("key", pa.int64()), ("digest", pa.binary()), ("doc_id", pa.int64()), ("tk", pa.int64()), ("span", pa.int64())])
_PARTS_SQL = "key long, digest binary, doc_id long, tk long, span long"


def packed(first, further, beyond):
    """First start, number of further starts and distance of the anchor behind the last one in one long."""
    return (first << 20) | (further << 10) | beyond


def hashed(data, size: int) -> bytes:
    return hashlib.blake2b(data, digest_size=size).digest()


def part_table(docs: DataFrame, length: int) -> DataFrame:
    """key, digest, doc_id, tk (hash of the text), span of all parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", STRETCH):
                raw, ends = utf8(piece.column("text"))
                begins = np.concatenate([[0], ends[:-1]])
                doc_ids, tks = piece.column("doc_id"), piece.column("tk")
                for a in range(0, max(len(raw), 1), STRETCH):
                    own = raw[a : a + STRETCH + length - 1]
                    first, last, beyond, key = parts(own, np.minimum(np.maximum(ends - a, 0), len(own)), length)
                    doc = np.searchsorted(ends, first + a, side="right")
                    at, view = pa.array(doc), memoryview(np.ascontiguousarray(own))
                    digest = [hashed(view[i : j + length], 16) for i, j in zip(first.tolist(), last.tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(digest, pa.binary()), doc_ids.take(at), tks.take(at), pa.array(packed(first + a - begins[doc], last - first, beyond))], schema=_PARTS)

    return docs.mapInArrow(run, _PARTS_SQL)


def fits(df: DataFrame, bytes_of_row) -> bool:
    """Whether a table is small enough to broadcast, by its measured size."""
    return (df.agg(F.sum(bytes_of_row)).first()[0] or 0) <= MOST_BYTES


def on_text(small: DataFrame, docs: DataFrame):
    return docs.doc_id.eqNullSafe(small.id_) & (docs.tk == small.tk_)


def met_by(docs: DataFrame, wanted: DataFrame, *columns: str) -> DataFrame:
    """doc_id, tk, text of the rows of docs that wanted (doc_id, tk and more) names, with parts: an array of the columns."""
    wanted = wanted.groupBy("doc_id", "tk").agg(F.collect_list(F.struct(*columns)).alias("parts"))
    wanted = cut(wanted.withColumnsRenamed({"doc_id": "id_", "tk": "tk_"}), "wanted")
    if fits(wanted, F.size("parts") * 48 + 32):
        wanted = F.broadcast(wanted)
    return docs.join(wanted, on_text(wanted, docs)).select("doc_id", "tk", "text", "parts")


def finer(docs: DataFrame, table: DataFrame, length: int, size: int) -> DataFrame:
    """The parts of a table cut into pieces by the distance of their starts from the anchor, as part_table() has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", STRETCH):
                out = []
                for doc_id, tk, text, own in zip(*(piece.column(c).to_pylist() for c in ("doc_id", "tk", "text", "parts"))):
                    raw = memoryview(text.encode())
                    for x in own:
                        first, further, beyond = x["span"] >> 20, x["span"] >> 10 & 1023, x["span"] & 1023
                        last = first + further
                        while first <= last:
                            distance = last + beyond - first
                            end = min(last, first + distance % size)  # starts first..end have one distance // size
                            nearest = first + distance % size  # the start of that kind that is nearest to the anchor, be it in this part or not
                            common = b"%d|%d|" % (x["key"], distance // size) + raw[nearest : nearest - size + 1 + length]
                            key = int.from_bytes(hashed(common, 8), "little", signed=True)
                            out.append((key, hashed(raw[first : end + length], 16), doc_id, tk, packed(first, end - first, last + beyond - end)))
                            first = end + 1
                    if len(out) > 4000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _PARTS)], schema=_PARTS)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _PARTS)], schema=_PARTS)

    return met_by(docs, table, "key", "span").mapInArrow(run, _PARTS_SQL)


def repeated_keys(table: DataFrame, label: str) -> DataFrame:
    """The rows of a part table whose key occurs more than once."""
    # written on its own, so that the join meets two plain exchanges and a hot key's rows can be split
    often = cut(table.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"), "often")
    return cut(table.join(sized(often), "key", "left_semi"), label)


def distinct_parts(table: DataFrame) -> DataFrame:
    """key, digest, n, and the first and last place of the parts with equal bytes."""
    place = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "tk", "span")
    return cut(table.groupBy("key", "digest").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("x"), F.max(place).alias("y")), "distinct")


def chained(same: DataFrame) -> DataFrame:
    """Distinct parts in chains, most of a single part: key, digest, starts of each part and at, its distance from the chain's first start;
    head and head_digest, of the chain's first part. Its last part has last, and then the chain's starts and places as copies."""
    first, starts = (lambda place: F.shiftright(f"{place}.span", 20)), F.shiftright("x.span", 10).bitwiseAND(1023) + 1
    alone = F.count(F.lit(1)).over(Window.partitionBy("key")) == 1
    rows = same.select("*", alone.alias("alone"), first("x").alias("fx"), first("y").alias("fy"), starts.alias("starts"))
    of_pair = Window.partitionBy("alone", "x.doc_id", "x.tk", "y.doc_id", "y.tk").orderBy("fx", "fy", "key", "digest")
    past = lambda c: F.lag(c).over(of_pair)
    follows = F.col("alone") & (past("fx") + past("starts") == F.col("fx")) & (past("fy") + past("starts") == F.col("fy")) & (F.shiftright(past("fx"), CHAIN_BITS) == F.shiftright("fx", CHAIN_BITS))
    rows = rows.withColumn("new", ~F.coalesce(follows, F.lit(False)))
    head = F.last(F.when(F.col("new"), F.struct("key", "digest", "fx", "fy")), ignorenulls=True).over(of_pair)
    rows = rows.withColumn("z", head).withColumn("last", F.coalesce(F.lead("new").over(of_pair), F.lit(True)))
    copy = lambda k, place, at: F.struct(F.lit(k).alias("copy"), f"{place}.doc_id", f"{place}.tk", F.col(at).alias("first"))
    copies = F.when(F.col("n") > 1, F.array(copy(0, "x", "z.fx"), copy(1, "y", "z.fy"))).otherwise(F.array(copy(-1, "x", "z.fx")))
    at = F.col("fx") - F.col("z.fx")
    return cut(rows.select("key", "digest", F.col("starts").cast("int").alias("starts"), at.cast("int").alias("at"), F.col("z.key").alias("head"), F.col("z.digest").alias("head_digest"), "last",
        F.when(F.col("last"), (at + F.col("starts")).cast("int")).alias("chain_starts"), F.when(F.col("last"), copies).alias("copies")), "chained")


def sorted_ranges(docs: DataFrame, chains: DataFrame, length: int, folder: str, shard_bytes: int, queue_bytes: int) -> DataFrame:
    """Ranges of bytes in repeated strings: key and digest (of the chain's first part), doc_id, tk, first start of the place, a, b from there, spilled (files of its shard)."""
    spark = docs.sparkSession
    chosen = chains.filter("last").select(F.col("head").alias("key"), F.col("head_digest").alias("digest"), F.col("chain_starts").alias("starts"), F.explode("copies").alias("z"))
    chosen = chosen.select("key", "digest", "z.copy", "z.doc_id", "z.tk", "z.first", "starts")
    cut_schema = pa.schema([("key", pa.int64()), ("digest", pa.binary()), ("copy", pa.int32()), ("doc_id", pa.int64()), ("tk", pa.int64()), ("first", pa.int64()), ("data", pa.binary())])

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                out, held = [], 0
                for doc_id, tk, text, own in zip(*(piece.column(c).to_pylist() for c in ("doc_id", "tk", "text", "parts"))):
                    raw = text.encode()
                    for x in own:
                        a = x["first"]
                        out.append((x["key"], x["digest"], x["copy"], doc_id, tk, a, raw[a : a + x["starts"] - 1 + length]))
                        held += len(out[-1][-1])
                        if held > STRETCH:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), cut_schema)], schema=cut_schema)
                            out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), cut_schema)], schema=cut_schema)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = met_by(docs, chosen, "key", "digest", "copy", "first", "starts").mapInArrow(segments, "key long, digest binary, copy int, doc_id long, tk long, first long, data binary").repartition(n, "key").sortWithinPartitions("key")
    schema = pa.schema([*cut_schema][:2] + [("one", pa.bool_())] + [*cut_schema][3:6] + [("a", pa.int32()), ("b", pa.int32()), ("spilled", pa.int32())])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def shard() -> pa.RecordBatch:
            out, files = [], [0]
            for (key, digest, copy, doc_id, tk, first, _), starts in zip(held, repeated_starts([np.frombuffer(x[-1], np.uint8) for x in held], length, queue_bytes, folder, files.append)):
                if copy < 1 and len(starts):
                    edge = np.flatnonzero(np.diff(starts) > 1)
                    for a, b in zip(starts[np.concatenate([[0], edge + 1])].tolist(), starts[np.concatenate([edge, [len(starts) - 1]])].tolist()):
                        out.append((key, digest, copy < 0, doc_id, tk, first, a, b + length, sum(files)))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema) if out else pa.RecordBatch.from_pydict({f.name: [] for f in schema}, schema=schema)

        for g in groups(batches, ["key"]):
            own = dict.fromkeys(zip(*(g[c] for c in cut_schema.names)))  # a row that repeats doc_id and text brings its parts twice
            held += own
            size += sum(len(x[-1]) + 1 for x in own)
            if size >= shard_bytes:
                yield shard()
                held, size = [], 0
        if held:
            yield shard()

    return dealt.mapInArrow(sort, "key long, digest binary, one boolean, doc_id long, tk long, first long, a int, b int, spilled int")


def found_ranges(docs: DataFrame, length: int = LENGTH, shard_bytes: int = SHARD_BYTES, queue_bytes: int = QUEUE_BYTES, hot: int = HOT_KEY) -> tuple[DataFrame, DataFrame]:
    """The parts whose key is repeated, and what the sort finds among them."""
    table = repeated_keys(part_table(docs, length).transform(lambda t: cut(t, "parts")), "candidates")
    same = distinct_parts(table)
    for size in PIECES:
        many = cut(same.groupBy("key").agg(F.count(F.lit(1)).alias("d")).filter(F.col("d") > hot).select("key"), "many")
        if not many.limit(1).count():
            break
        many = sized(many)
        pieces_ = cut(finer(docs, table.join(many, "key", "left_semi"), length, size), "pieces")
        table = cut(table.join(many, "key", "left_anti").unionByName(repeated_keys(pieces_, "fine")), "dealt")
        same = distinct_parts(table)
    chains = chained(same)
    found = cut(sorted_ranges(docs, chains, length, scratch(docs.sparkSession, "runs"), shard_bytes, queue_bytes), "sorted")
    return table, found.filter("one").unionByName(of_parts(found.filter("not one"), chains, length))


def of_parts(found: DataFrame, chains: DataFrame, length: int) -> DataFrame:
    """Ranges found in chains as those of their parts, from the part's first start on."""
    parts_ = chains.select("key", "digest", "starts", "at", F.col("head").alias("key_"), F.col("head_digest").alias("digest_"))
    found = found.withColumnsRenamed({"key": "key_", "digest": "digest_"})
    a, b = F.greatest(F.lit(0), F.col("a") - F.col("at")), F.least(F.col("starts") - 1 + length, F.col("b") - F.col("at"))
    rows = parts_.join(sized(found), ["key_", "digest_"])
    return rows.select("key", "digest", "one", "doc_id", "tk", "first", a.alias("a"), b.alias("b"), "spilled").filter(F.col("b") - F.col("a") >= length)


def repeated_ranges(docs: DataFrame, length: int = LENGTH, **how) -> DataFrame:
    """docs: doc_id, tk, text. One row per document with repeated strings: id_, tk_, ranges (array of a, b)."""
    table, found = found_ranges(docs, length, **how)
    first = F.shiftright("span", 20)
    alone = found.filter("one").select("doc_id", "tk", (F.col("first") + F.col("a")).alias("a"), (F.col("first") + F.col("b")).alias("b"))
    equal = cut(found.filter("not one").select("key", "digest", "a", "b"), "equal")
    equal = table.join(sized(equal), ["key", "digest"]).select("doc_id", "tk", (first + F.col("a")).alias("a"), (first + F.col("b")).alias("b"))
    ranges = equal.unionByName(alone).groupBy("doc_id", "tk").agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("ranges"))
    return cut(ranges.withColumnsRenamed({"doc_id": "id_", "tk": "tk_"}), "ranges")


def with_ranges(docs: DataFrame, **how) -> DataFrame:
    """doc_id, text, ranges (null if there are none) of each row."""
    docs = id_text(docs).withColumn("tk", F.xxhash64("text"))
    ranges = repeated_ranges(docs, **how)
    if fits(ranges, F.size("ranges") * 16 + 32):
        ranges = F.broadcast(ranges)
    return docs.join(ranges, on_text(ranges, docs), "left").select("doc_id", "text", "ranges")


def merged(ranges: list) -> list[tuple[int, int]]:
    """Maximal runs of sorted ranges; those that touch are one."""
    out: list[list[int]] = []
    for x in ranges:
        a, b = x["a"], x["b"]
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def dedup_bytes(docs: DataFrame, **how) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept (binary, the bytes left)."""
    return _settle(with_ranges(docs, **how), lambda kept: kept, "kept binary", pa.binary())


def dedup_digests(docs: DataFrame, **how) -> DataFrame:
    """As dedup_bytes(), with kept_sha256 for kept."""
    return _settle(with_ranges(docs, **how), lambda kept: hashlib.sha256(kept).hexdigest(), "kept_sha256 string", pa.string())


def _settle(rows: DataFrame, f, column: str, kind: pa.DataType) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), (column.split()[0], kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                out = []
                for doc_id, text, ranges in zip(*(piece.column(c).to_pylist() for c in ("doc_id", "text", "ranges"))):
                    raw = text.encode()
                    spans = merged(ranges) if ranges else []
                    at, left = 0, []
                    for a, b in spans:
                        left.append(raw[at:a])
                        at = b
                    left.append(raw[at:])
                    out.append((doc_id, len(raw), sum(b - a for a, b in spans), len(spans), f(b"".join(left))))
                yield pa.RecordBatch.from_arrays([pa.array(c, g.type) for c, g in zip(zip(*out), schema)], schema=schema)

    return rows.mapInArrow(run, f"doc_id long, n_bytes long, n_removed long, n_spans long, {column}")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_digests(load(spark, sf_dir, "documents"))
