"""Document fingerprints by I-Match.

The lexicon keeps the terms whose document frequency lies in a band of inverse document frequencies. A text's distinct
lexicon terms are sorted and hashed once whole and once for each of several randomised subsets of the lexicon, whose shares
fall geometrically, so that small subsets survive large edits and large ones tell close texts apart. The likeness of two
fingerprints is the share of equal hashes among the subsets in which either has a term.

Terms are 64-bit hashes, computed for a batch of texts at once. Document frequencies of all terms are counted over all documents,
by sums that each task begins and a shuffle completes. The band holds at most (mean number of distinct terms in a document) /
(its lower end) terms, however many documents there are: with 1,000 distinct terms a document a million. They are counted, and
broadcast as eight bytes each up to LEXICON_BYTES; a larger lexicon meets the documents' terms in a join. No term of the band is
left out.

Defined results: null text counts as empty; a text without lexicon terms gets a hash of its distinct terms, so that such
texts match only when these agree; words are lower-cased in A-Z; equal texts have equal fingerprints; an empty table gives an
empty result; a null doc_id comes after all others in descending order and rows of the same doc_id are ordered by a hash of
the text, descending, then by the text; other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, id_text, load, pieces, sized
from .shingles import mix, word_hashes

#: The band, as shares of the documents that hold the term.
BAND = (0.001, 0.2)
#: Subset 0 is the whole lexicon; the others hold a share of it each, the smaller shares in more subsets.
SHARES = (1.0, *(2.0**-i for i in range(1, 4) for _ in range(3)), *(2.0**-i for i in range(4, 10) for _ in range(9)))
WIDTH = 8
#: Bytes of text whose terms are hashed at a time, and of a range of documents.
PIECE, RANGE_BYTES = 1 << 20, 32 << 20
#: Quantiles of doc_id that reach the driver at most; bytes of guests' keys, and of a lexicon, that are sent to all tasks at most.
MARKS, GUEST_BYTES, LEXICON_BYTES = 4096, 64 << 20, 64 << 20
_LEAST = -(1 << 63)
_SALTS = mix(np.arange(1, len(SHARES) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_STEP = np.uint64(0xD6E8FEB86659FD93)


def term_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct term hashes of each text of a string column without nulls, one text after another, and the index of the text each is of."""
    words, at = word_hashes(pc.ascii_lower(column))
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((words, doc))
    words, doc = words[order], doc[order]
    new = np.ones(len(words), bool)
    new[1:] = (words[1:] != words[:-1]) | (doc[1:] != doc[:-1])
    return words[new], doc[new]


def sequence_hashes(terms: np.ndarray, doc: np.ndarray, n: int, salt: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """For each of n texts a hash of its terms in their order, and how many there are."""
    count = np.bincount(doc, minlength=n)
    ends = np.cumsum(count)
    rank = np.arange(len(terms)) - np.repeat(ends - count, count)
    sums = np.zeros(len(terms) + 1, np.uint64)
    np.cumsum(mix((terms ^ salt) + rank.astype(np.uint64) * _STEP), out=sums[1:])
    return mix((sums[ends] - sums[ends - count]) ^ salt), count


def _prints(terms: np.ndarray, doc: np.ndarray, whole: np.ndarray) -> list[str]:
    """Fingerprints from the lexicon's terms in each text, sorted, and each text's hash of all its terms."""
    n = len(whole)
    out = np.zeros((n, len(SHARES)), np.uint32)
    for k, share in enumerate(SHARES):
        own = slice(None) if share == 1 else mix(terms + _SALTS[k]) < np.uint64(int(share * 2**64))
        h, count = sequence_hashes(terms[own], doc[own], n, _SALTS[k])
        out[:, k] = np.where(count > 0, np.maximum(h >> np.uint64(32), np.uint64(1)), np.uint64(0))
    empty = out[:, 0] == 0
    digits = out.astype(">u4").tobytes().hex()
    width = WIDTH * len(SHARES)
    return [f"x{w:016x}" if e else digits[i * width : (i + 1) * width] for i, (e, w) in enumerate(zip(empty.tolist(), whole.tolist()))]


def fingerprints_of(column: pa.Array, lexicon: np.ndarray) -> list[str]:
    """lexicon: sorted term hashes."""
    terms, doc = term_sets(column)
    at = np.searchsorted(lexicon, terms)
    known = lexicon[np.minimum(at, len(lexicon) - 1)] == terms if len(lexicon) else np.zeros(len(terms), bool)
    whole, _ = sequence_hashes(terms, doc, len(column), np.uint64(0))
    return _prints(terms[known], doc[known], whole)


def likeness(a: str, b: str) -> float:
    """Share of equal hashes among the subsets in which either text has a term, 0 to 1."""
    if a == b:
        return 1.0
    if a[:1] == "x" or b[:1] == "x":
        return 0.0
    p, q = (np.frombuffer(bytes.fromhex(x), np.uint32) for x in (a, b))
    either = int(((p | q) != 0).sum())
    return int(((p == q) & (p != 0)).sum()) / either


def document_frequencies(docs: DataFrame, every: int = 1 << 21) -> DataFrame:
    """term, df over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def summed() -> tuple[np.ndarray, np.ndarray]:
            terms, counts = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(terms, kind="stable")
            terms, counts = terms[order], counts[order]
            at = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]]))
            return terms[at], np.add.reduceat(counts, at)

        def sent(terms: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(terms), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(terms[i : i + 100_000].view(np.int64)), pa.array(counts[i : i + 100_000])], ["term", "df"])

        for batch in batches:
            for piece in pieces(batch, "text", PIECE):
                terms, _ = term_sets(piece.column("text"))
                if len(terms):
                    terms, counts = np.unique(terms, return_counts=True)
                    held.append((terms, counts.astype(np.int64)))
                    size += len(terms)
                if size > every:
                    held = [summed()]
                    size = len(held[0][0])
                    if 2 * size > every:
                        yield from sent(*held.pop())
                        size = 0
        if held:
            yield from sent(*summed())

    return docs.select("text").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def band_terms(docs: DataFrame, band: tuple[float, float] = BAND) -> DataFrame:
    """term: the hashes of the terms whose document frequency lies in the band, as a written table."""
    low, high = band
    total = docs.count()
    return cut(document_frequencies(docs).filter((F.col("df") >= low * total) & (F.col("df") <= high * total)).select("term"), "lexicon")


def build_lexicon(docs: DataFrame, band: tuple[float, float] = BAND) -> np.ndarray:
    """The sorted hashes of the band's terms."""
    return _sorted_terms(band_terms(docs, band))


def _sorted_terms(terms: DataFrame) -> np.ndarray:
    return np.sort(terms.toArrow()["term"].to_numpy().astype(np.int64).view(np.uint64))


def _ranges(docs: DataFrame, n: int, marks_at_most: int = MARKS) -> DataFrame:
    """docs (k, tk, ...) with bucket: about n ranges of (k, tk), ascending.

    At most `marks_at_most` quantiles of k are taken to the driver; what more ranges are wanted are cuts of equal width between
    two of them. A k that several quantiles fall on is many rows', and is cut into as many ranges of tk, times those cuts."""
    spark = docs.sparkSession
    coarse = max(1, min(n, marks_at_most))
    cuts = -(-n // coarse)
    told = docs.agg(F.percentile_approx("k", [i / coarse for i in range(1, coarse)] or [0.5], 2 * MARKS).alias("m"), F.min("k").alias("lo"), F.max("k").alias("hi")).first()
    often = Counter(float(m) for m in (told.m or []) if coarse > 1)
    starts = sorted(often)
    bounds = [float(told.lo or 0), *starts, float(told.hi or 0)]
    ranges, bucket = [], 0  # range of k, its first bucket, its bounds, the k that many rows have, the number of that k's ranges
    for i in range(len(starts) + 1):
        many = often[starts[i - 1]] if i and often[starts[i - 1]] > 1 else 0
        ranges.append((i, bucket, bounds[i], bounds[i + 1], int(starts[i - 1]) if many else None, many * cuts))
        bucket += cuts + many * cuts
    table = F.broadcast(spark.createDataFrame(ranges, "range int, first long, lo double, hi double, often long, parts long"))
    x = F.col("k").cast("double")
    ranged = Bucketizer(splits=[-float("inf"), *(starts or [0.0]), float("inf")], inputCol="x", outputCol="range").transform(docs.withColumn("x", x)) if starts else docs.withColumn("x", x).withColumn("range", F.lit(0))
    inside = F.coalesce(F.least(F.greatest(F.floor(F.try_divide(F.col("x") - F.col("lo"), F.col("hi") - F.col("lo")) * cuts), F.lit(0)), F.lit(cuts - 1)), F.lit(0))
    share = (F.col("tk").cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    own = F.least(F.floor(share * F.col("parts")), F.col("parts") - 1)
    # within a range: its first k, if that is many rows' (one that only rounds to it comes before), then the rest
    part = F.when(F.col("often").isNull() | (F.col("k") > F.col("often")), F.col("parts") + inside).when(F.col("k") == F.col("often"), own).otherwise(F.lit(0))
    return ranged.withColumn("range", F.col("range").cast("int")).join(table, "range").withColumn("bucket", (F.col("first") + part).cast("long"))


def with_next(docs: DataFrame, range_bytes: int = RANGE_BYTES, marks_at_most: int = MARKS) -> DataFrame:
    """Rows dealt into ranges of (doc_id, hash of the text), each range in descending order and followed by a guest, the first row of the range below (of the highest range after the lowest): bucket, guest, doc_id, text.

    A doc_id that many rows share is cut into ranges of the hash. Which row is whose guest is worked out by tasks; the guests' keys, 24
    bytes for each range, are broadcast as far as they are few."""
    spark = docs.sparkSession
    docs = docs.withColumn("k", F.coalesce("doc_id", F.lit(_LEAST))).withColumn("tk", F.xxhash64("text"))
    shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = max(3 * shuffled, -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // range_bytes))
    tops = cut(_ranges(docs.select("k", "tk"), n, marks_at_most).groupBy("bucket").agg(F.max(F.struct("k", "tk")).alias("top")), "tops")
    placed = tops.repartitionByRange(shuffled, F.desc("bucket")).sortWithinPartitions(F.desc("bucket")).withColumn("id", F.monotonically_increasing_id())
    placed = cut(placed.withColumn("part", F.shiftright("id", 33)), "ranges")
    # the range below: the next row of a partition, or the first of the next partition that has one
    inner = placed.withColumn("below", F.lead("top").over(Window.partitionBy("part").orderBy("id")))
    firsts = sorted((r.part, tuple(r.top)) for r in placed.groupBy("part").agg(F.min_by("top", "id").alias("top")).collect())  # a row for each partition
    if not firsts:
        return docs.withColumn("bucket", F.lit(0).cast("long")).withColumn("guest", F.lit(0)).select("bucket", "guest", "doc_id", "text")
    after = [(p, *firsts[(i + 1) % len(firsts)][1]) for i, (p, _) in enumerate(firsts)]
    inner = inner.join(F.broadcast(spark.createDataFrame(after, "part long, nk long, ntk long")), "part")
    extra = inner.select("bucket", F.coalesce(F.col("below.k"), F.col("nk")).alias("k"), F.coalesce(F.col("below.tk"), F.col("ntk")).alias("tk"))
    own = _ranges(docs, n, marks_at_most).select("bucket", F.lit(0).alias("guest"), "k", "tk", "doc_id", "text")
    sent = docs.join(sized(cut(extra, "guests"), GUEST_BYTES), ["k", "tk"]).select("bucket", F.lit(1).alias("guest"), "k", "tk", "doc_id", "text")
    return own.unionByName(sent).repartition(min(n, 4 * shuffled), "bucket").sortWithinPartitions("bucket", "guest", F.desc("k"), F.desc("tk"), "text").drop("k", "tk")


def fingerprints(docs: DataFrame, band: tuple[float, float] = BAND, lexicon_bytes: int = LEXICON_BYTES) -> DataFrame:
    """doc_id and fingerprint of each row."""
    docs = id_text(docs)
    terms = band_terms(docs, band)
    if 8 * terms.count() > lexicon_bytes:
        return _joined(_texts_alone, docs, terms, "doc_id long").select("doc_id", F.col("prints")[0].alias("fingerprint"))
    held = docs.sparkSession.sparkContext.broadcast(_sorted_terms(terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", PIECE):
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(fingerprints_of(piece.column("text"), held.value), pa.string())], ["doc_id", "fingerprint"])

    return docs.mapInArrow(run, "doc_id long, fingerprint string")


def _texts_alone(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple], list[list[str]]]]:
    for batch in batches:
        for piece in pieces(batch, "text", PIECE):
            yield [(i,) for i in piece.column("doc_id").to_pylist()], [[t] for t in piece.column("text").to_pylist()]


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple], list[list[str]]]]:
    """(doc_id, n_chars, digest of the edited text) of the rows of with_next, and the text, the edited one and the next one of each."""
    last = None  # bucket, doc_id and text of the row that waits for the next one
    for batch in batches:
        for piece in pieces(batch, "text", PIECE):
            told, texts = [], []
            for bucket, guest, doc_id, text in zip(*(piece.column(c).to_pylist() for c in ("bucket", "guest", "doc_id", "text"))):
                if guest and (last is None or last[0] != bucket):  # all but the first guest of a range
                    continue
                if last is not None:
                    n = len(last[2])
                    edited = last[2][: n - n // 2] + text[: n // 2]
                    told.append((last[1], n, hashlib.sha256(edited.encode()).hexdigest()))
                    texts.append([last[2], edited, text])
                last = None if guest else (bucket, doc_id, text)
            if told:
                yield told, texts


def _joined(rows_of, docs: DataFrame, terms: DataFrame, shape: str) -> DataFrame:
    """What rows_of tells of docs, and prints, the fingerprints of its texts: terms meet a lexicon too large to send around in a join.

    Each text's distinct terms leave the task that read it and those of the band come back to it by its number, so no row is longer
    than a text's terms."""
    fields = [f.strip().split() for f in shape.split(",")]
    kinds = {"long": pa.int64(), "string": pa.string()}
    schema = pa.schema([("rid", pa.int64()), ("role", pa.int32()), *((n, kinds[k]) for n, k in fields), ("whole", pa.int64()), ("terms", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid = TaskContext.get().partitionId() << 33
        for told, texts in rows_of(batches):
            for role in range(len(texts[0])):
                column = pa.array([t[role] for t in texts], pa.large_string())
                found, doc = term_sets(column)
                whole, count = sequence_hashes(found, doc, len(texts), np.uint64(0))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.array(found.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(rid, rid + len(texts))), pa.array(np.full(len(texts), role, np.int32)), *(pa.array([r[i] for r in told], kinds[k]) for i, (_, k) in enumerate(fields)), pa.array(whole.view(np.int64)), lists], schema=schema)
            rid += len(told)

    rows = cut(docs.mapInArrow(run, f"rid long, role int, {shape}, whole long, terms array<long>"), "terms")
    known = rows.select("rid", "role", F.explode("terms").alias("term")).join(terms, "term").groupBy("rid", "role").agg(F.collect_list("term").alias("known"))  # a text's own terms
    names = [n for n, _ in fields]
    met = rows.drop("terms").join(known, ["rid", "role"], "left").select("rid", *names, F.struct("role", "whole", F.coalesce("known", F.array().cast("array<long>")).alias("known")).alias("t"))
    met = met.groupBy("rid", *names).agg(F.array_sort(F.collect_list("t")).alias("t"))  # one entry for each role

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for ts in batch.column("t").to_pylist():
                known = [np.sort(np.array(t["known"], np.int64).view(np.uint64)) for t in ts]
                doc = np.repeat(np.arange(len(ts)), [len(k) for k in known])
                out.append(_prints(np.concatenate(known), doc, np.array([t["whole"] for t in ts], np.int64).view(np.uint64)))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(out, pa.list_(pa.string()))], [*names, "prints"])

    return met.select(*names, "t").mapInArrow(printed, f"{shape}, prints array<string>")


_TOLD = "doc_id long, n_chars long, edited_sha256 string"
_EDITED = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _compared(told: list[tuple], prints: list[list[str]]) -> pa.RecordBatch:
    """told, and of the prints of a text, its edited form and the next text the first two and their likeness to the first."""
    rows = [(*t, a, e, likeness(a, e), likeness(a, b)) for t, (a, e, b) in zip(told, prints)]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _EDITED)], schema=_EDITED)


def edited_fingerprints(docs: DataFrame, band: tuple[float, float] = BAND, lexicon_bytes: int = LEXICON_BYTES) -> DataFrame:
    """Fingerprints of each text, of the text whose last half is replaced by the start of the next document, and their likeness."""
    docs = id_text(docs)
    terms, shape = band_terms(docs, band), f"{_TOLD}, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    if 8 * terms.count() > lexicon_bytes:

        def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield _compared(list(zip(*(batch.column(i).to_pylist() for i in range(3)))), batch.column("prints").to_pylist())

        return _joined(_edited, with_next(docs), terms, _TOLD).mapInArrow(compared, shape)
    held = docs.sparkSession.sparkContext.broadcast(_sorted_terms(terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for told, texts in _edited(batches):
            # a text that is one row's next is most often the following row's own: each is looked at once
            flat = list(dict.fromkeys(t for ts in texts for t in ts))
            of = dict(zip(flat, fingerprints_of(pa.array(flat, pa.large_string()), held.value)))
            yield _compared(told, [[of[t] for t in ts] for ts in texts])

    return with_next(docs).mapInArrow(run, shape)


def op10_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(load(spark, sf_dir, "documents"))
