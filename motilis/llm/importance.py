"""Importance resampling towards a target's distribution of hashed word features, with identical texts collapsed.

Documents are grouped by their whole text, so features are taken, hashed and weighed once for each distinct text, and counts
are multiplied by the number of its copies. Features are runs of 1 to 2 consecutive words; a feature's bucket is the crc32 of
its bytes modulo BUCKETS. The two bucket tables have a fixed number of rows, whatever the corpus, and are the only thing sent to all
tasks. A weight is the mean of the gains of a text's features. Weights meet the documents again by the text's digest: those of
texts with very many copies by broadcast, fewer than SPLIT of them by construction, all others by a join in which no text has
more than a SPLITth of all rows. Only then does each document draw its own Gumbel noise from its id, and the highest
scores are taken, which is sampling without replacement in proportion to exp(weight / 1000).

Ranks come from one range shuffle of the candidates, numbered within partitions and moved on by the partitions' sizes.

crc32 of all words and pairs of a batch comes from numpy: words byte by byte through the polynomial's table, a pair from its
two words, since appending n bytes is a linear map of the checksum (kept as tables for each n).

Defined results: null and empty texts have no words, no features, weight 0, and are never drawn; a null doc_id draws noise as
if its decimal form were empty and comes after all others among ties; rows that repeat a doc_id are ranked one after another;
with no target text every t is 0; an empty table gives an empty result; other columns, whatever their names, play no part.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, load, pieces, sized

BUCKETS = 10_000
SEED = 7
LEAST_WORDS, PERCENT = 20, 25
SPLIT = 1000
#: Bytes of text taken at a time.
PIECE = 1 << 20

_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True  # after A-Z are lower-cased
_SHORT = 64


def _byte_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> np.uint32(1)) ^ np.uint32(0xEDB88320), c >> np.uint32(1))
    return c


_TABLE = _byte_table()


def _zeros(c: np.ndarray, n: int) -> np.ndarray:
    """A checksum's state after n zero bytes, without the inversions at either end."""
    for _ in range(n):
        c = _TABLE[c & np.uint32(255)] ^ (c >> np.uint32(8))
    return c


def _moves() -> tuple[np.ndarray, list[np.ndarray]]:
    """Tables of the maps that append n zero bytes, one for each byte of the state: for each n below _SHORT, and for n = 2**k."""
    bytes_of = np.array([np.arange(256, dtype=np.uint32) << np.uint32(8 * j) for j in range(4)])
    short = [bytes_of]
    for _ in range(_SHORT - 1):
        short.append(_zeros(short[-1], 1))
    powers = [_zeros(bytes_of, 1)]
    for _ in range(31):
        powers.append(_move(powers[-1], powers[-1]))
    return np.array(short), powers


def _move(table: np.ndarray, c: np.ndarray) -> np.ndarray:
    return table[0][c & 255] ^ table[1][(c >> 8) & 255] ^ table[2][(c >> 16) & 255] ^ table[3][c >> 24]


_MOVES, _POWERS = _moves()


def _appended(c: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Checksums c of some bytes, each moved on by n further bytes, to be combined by xor with the checksum of these."""
    few = np.minimum(n, _SHORT - 1)
    out = _MOVES[few, 0, c & 255] ^ _MOVES[few, 1, (c >> 8) & 255] ^ _MOVES[few, 2, (c >> 16) & 255] ^ _MOVES[few, 3, c >> 24]
    for i in np.flatnonzero(n >= _SHORT).tolist():  # long words, one by one
        x = c[i : i + 1]
        for k in range(int(n[i]).bit_length()):
            if int(n[i]) >> k & 1:
                x = _move(_POWERS[k], x)
        out[i] = x[0]
    return out


def word_checksums(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """crc32 and length of each word of a string column without nulls, in order, and the number of words before each text (one entry more than texts)."""
    column = pc.ascii_lower(column).cast(pa.large_string())  # in this order: lower-casing a cast slice gives wrong bytes
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None or offsets[0] == offsets[-1]:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(len(column) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    inside = _INSIDE[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[offsets] = True  # a word never runs on into the next text
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | first[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | first[1:-1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    n = ends - starts
    order = np.argsort(-np.minimum(n, _SHORT), kind="stable")  # the longest first, so that the j-th step is over a front part
    at, c = starts[order], np.full(len(n), 0xFFFFFFFF, np.uint32)
    reach = np.searchsorted(-np.minimum(n, _SHORT)[order], -np.arange(1, _SHORT + 1), "right")
    for j in range(_SHORT):
        k = int(reach[j])
        if not k:
            break
        c[:k] = _TABLE[(c[:k] ^ raw[at[:k] + j]) & 255] ^ (c[:k] >> np.uint32(8))
    out = np.empty(len(n), np.uint32)
    out[order] = c ^ np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(n > _SHORT).tolist():
        out[i] = zlib.crc32(raw[starts[i] : ends[i]])
    return out, n, np.searchsorted(starts, offsets)


def feature_buckets(column: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features of a string column without nulls, text by text with repeats, and the number of features before each text."""
    words, n, at = word_checksums(column)
    count = np.diff(at)
    before = np.zeros(len(at), np.int64)
    np.cumsum(2 * count - (count > 0), out=before[1:])
    spaced = np.uint32(0xFFFFFFFF) ^ words  # the state after a word; one more byte, a space
    spaced = (_TABLE[(spaced ^ np.uint32(0x20)) & 255] ^ (spaced >> np.uint32(8))) ^ np.uint32(0xFFFFFFFF)
    follows = np.ones(len(words), bool)
    follows[at[:-1][count > 0]] = False  # a text's first word ends no pair
    second = np.flatnonzero(follows)
    pairs = _appended(spaced[second - 1], n[second]) ^ words[second]
    out = np.empty(before[-1], np.uint32)
    text = np.repeat(np.arange(len(count)), count)
    out[before[text] + (np.arange(len(words)) - at[text])] = words
    out[before[text[second]] + count[text[second]] + (second - at[text[second]] - 1)] = pairs
    return out % np.uint32(buckets), before


def distinct_texts(docs: DataFrame) -> DataFrame:
    """digest (SHA-256 of the text), text, copies: documents grouped by their whole text, null as empty."""
    texts = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text")).groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    return texts.select(F.unhex(F.sha2("text", 256)).alias("digest"), "text", "copies")


def featured(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """digest, copies, n_features and features (binary, a little-endian number of two or four bytes for each) of each distinct text."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", PIECE):
                found, before = feature_buckets(piece.column("text"), buckets)
                data, width = found.astype(kind).tobytes(), int(kind[2])
                own = [data[a * width : b * width] for a, b in zip(before[:-1].tolist(), before[1:].tolist())]
                yield pa.RecordBatch.from_arrays([piece.column("digest"), piece.column("copies"), pa.array(np.diff(before)), pa.array(own, pa.binary())], ["digest", "copies", "n_features", "features"])

    return texts.mapInArrow(run, "digest binary, copies long, n_features long, features binary")


def bucket_counts(features: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket's features occur in all documents, copies counted. At most `buckets` rows reach the driver."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            for copies, data in zip(batch.column("copies").to_pylist(), batch.column("features").to_pylist()):
                own = np.frombuffer(data, kind)
                if len(own) < buckets // 8:
                    np.add.at(sums, own, copies)
                else:
                    sums += copies * np.bincount(own, minlength=buckets)
        met = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(sums[met])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in features.select("copies", "features").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the smoothed log ratio of a bucket's shares in the target and in the source, floored."""
    k, s, t = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float((b + 1) * (s + k)) / float((a + 1) * (t + k)))) for a, b in zip(source.tolist(), target.tolist())], np.int64)


def weighed(features: DataFrame, gain: np.ndarray) -> DataFrame:
    """digest, copies, n_features, weight of each distinct text: the floored mean of its features' gains."""
    kind = "<u2" if len(gain) <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n_features").to_numpy()
            sums = np.array([int(gain[np.frombuffer(x, kind)].sum()) for x in batch.column("features").to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("digest"), batch.column("copies"), batch.column("n_features"), pa.array(sums // np.maximum(n, 1))], ["digest", "copies", "n_features", "weight"])

    return features.mapInArrow(run, "digest binary, copies long, n_features long, weight long")


def _ranked(rows: DataFrame, most: int) -> DataFrame:
    """rows with rank 1, 2, 3... by descending score, then doc_id, null last; null beyond `most` and where the row is no candidate."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("spread")]
    chosen = rows.filter("candidate").repartitionByRange(n, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        for batch in batches:
            m = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(m, part)), pa.array(np.arange(k, k + m))], [*batch.schema.names, "part", "place"])
            k += m

    placed = cut(chosen.select("doc_id", "n_features", "weight", "score").mapInArrow(run, "doc_id long, n_features long, weight long, score long, part long, place long"), "placed")
    # a row for each partition; its sum reaches the driver and goes back to all tasks
    sizes = sorted((r.part, r.n) for r in placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())
    starts, total = [], 0
    for part, size in sizes:
        starts.append((part, total))
        total += size
    before = F.broadcast(rows.sparkSession.createDataFrame(starts, "part long, before long"))
    place = F.col("before") + F.col("place") + 1
    ranked = placed.join(before, "part").select("doc_id", "n_features", "weight", "score", F.when(place <= most, place).alias("rank"))
    return ranked.unionByName(rows.filter("not candidate").select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null if undrawn) of every document; target has a column text."""
    features = cut(featured(distinct_texts(docs), buckets), "features")
    aimed = featured(distinct_texts(target), buckets)
    weights = cut(weighed(features, gains(bucket_counts(features, buckets), bucket_counts(aimed, buckets))), "weights")
    total, candidates = weights.agg(F.sum("copies"), F.sum(F.when(F.col("n_features") >= 2 * least_words - 1, F.col("copies")))).first()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)).alias("digest"))
    weights = weights.withColumn("hot", F.col("copies") * SPLIT > F.lit(total or 0))
    hot = F.broadcast(weights.filter("hot").drop("hot", "copies"))  # fewer than SPLIT rows: each holds more than a SPLITth of all documents
    rows = rows.join(hot, "digest", "left")
    rest = sized(weights.filter("not hot").select("digest", F.col("n_features").alias("n2"), F.col("weight").alias("w2")))
    met = rows.filter("weight is null").drop("n_features", "weight").join(rest, "digest").select("doc_id", "digest", F.col("n2").alias("n_features"), F.col("w2").alias("weight"))
    rows = rows.filter("weight is not null").select("doc_id", "digest", "n_features", "weight").unionByName(met)

    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((drawn + 0.5) / 4294967296.0)))
    rows = rows.withColumn("score", (F.col("weight") + noise).cast("long")).withColumn("candidate", F.col("n_features") >= 2 * least_words - 1).withColumn("spread", F.xxhash64("digest"))
    return _ranked(cut(rows.drop("digest"), "scores"), (candidates or 0) * percent // 100)


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


SQL = r"""
WITH RECURSIVE tbl AS (
  SELECT i, 0 AS k, CAST(i AS BIGINT) AS c FROM range(256) r(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM tbl WHERE k < 8
), byte AS (SELECT i, c FROM tbl WHERE k = 8),
words AS (
  SELECT 'd' AS kind, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
), runs AS (
  SELECT kind, doc_id, unnest(w) AS f FROM words
  UNION ALL
  SELECT kind, doc_id, concat(w[i], ' ', w[i + 1]) FROM (SELECT kind, doc_id, w, unnest(range(1, len(w))) AS i FROM words)
), feature AS (
  SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM runs)
), step AS (
  SELECT f, x, 0 AS k, 4294967295 AS c FROM feature
  UNION ALL
  SELECT f, x, k + 1, xor(byte.c, step.c >> 8) FROM step JOIN byte ON byte.i = xor(step.c & 255, CAST('0x' || substr(x, 2 * k + 1, 2) AS BIGINT)) WHERE 2 * k < length(x)
), bucket AS (
  SELECT f, xor(c, 4294967295) % 10000 AS b FROM step WHERE 2 * k = length(x)
), used AS (
  SELECT b, count(*) FILTER (kind = 'd') AS s, count(*) FILTER (kind = 'b') AS t FROM runs JOIN bucket USING (f) GROUP BY b
), gain AS (
  SELECT b, CAST(floor(1000 * ln(CAST((t + 1) * ((SELECT sum(s) FROM used) + 10000) AS DOUBLE) / CAST((s + 1) * ((SELECT sum(t) FROM used) + 10000) AS DOUBLE))) AS BIGINT) AS g FROM used
), mean AS (
  SELECT doc_id, count(*) AS n_features, CAST(floor(CAST(sum(g) AS DOUBLE) / count(*)) AS BIGINT) AS weight FROM runs JOIN bucket USING (f) JOIN gain USING (b) WHERE kind = 'd' GROUP BY doc_id
), drawn AS (
  SELECT doc_id, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(CAST('0x' || substr(sha256('7:' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296))) AS BIGINT) AS score
  FROM documents LEFT JOIN mean USING (doc_id)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 39 ORDER BY score DESC, doc_id) AS r FROM drawn
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 39 AND r <= (SELECT count(*) * 25 // 100 FROM drawn WHERE n_features >= 39) THEN r END AS rank FROM ranked
"""
