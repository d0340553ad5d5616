"""Scoring by a hashed maximum-entropy language model with class-factored softmax.

A token's probability is P(its class | history) times P(its part of the class | class, history) times P(the word | part). The
first two factors are softmaxes whose scores add up hashed features of the history: the word before (bigram), the two before
together (trigram), and the second and third before (skips); in the second factor the class is hashed along, so that its
features are n-grams and skips of a few words. The most frequent words of a class are parts of their own, so that for them both
factors together are a softmax over words. The last factor is what is left for rarer words, which share a part: its only feature
is the word itself, whose maximum-likelihood weight is its count; a discount of the part's share of words seen once goes to
unknown words. So the V known tokens and, part by part, the unknown word share a probability of 1 after every history.

Weights are trained by rounds of distributed gradient updates over all training documents: tasks send the features' expected
counts under the present weights, and the gradient (observed less expected counts, less the pull of a Gaussian prior) moves each
weight, in the scale of what its feature was expected to count. Tasks are as few as keep what they send to a share of the corpus, and blocks of the sums are
added up by a shuffle.

Words up to a rank stand for themselves, the others for their last two bytes; both are grouped into classes by the words that
precede them, counted over the corpus. That rank and the rows of the feature table grow with the square root of the number of
training tokens, up to `MOST_ROWS`, which bounds the table that is broadcast. Counts of all words are kept in a table. The
`HEAVY` most frequent of no more than `LONG` bytes are broadcast, the rest meet their counts by a shuffled join of
per-document word counts, which leaves word order out of it because their part, not their count, enters the softmaxes.

Only documents with crc32(doc_id as text) mod 7 other than 2 are learnt from; all are scored.

Defined results: null text counts as empty and has the end token only; a null doc_id is learnt from; without any training
document every score is finite and base_score is 0; rows that repeat are scored as rows of their own; a long text is scored
whole; other columns play no part.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, id_text, load, pieces

FOLDS, HELD_OUT = 7, 2
HEAVY, LONG = 1 << 18, 64
SUFFIXES = 1024
CONTEXTS = 128
CLASSES, PARTS = 32, 32
ROUNDS = 2
LEAST_ROWS, MOST_ROWS = 1 << 14, 1 << 19
FEATURES = 4
#: Prior count behind each feature and outcome.
KAPPA = 4.0
#: Weight of the Gaussian prior that holds weights back where a feature is rare.
DECAY = 4.0
#: Step of the gradient, and the most that a weight moves in a round.
STEP, MOST_STEP = 0.5, 1.0
MOST_WEIGHT = np.float32(12)
#: Bytes that tasks send for a sum, as a share of the bytes of the ids, and of a block of it.
SENT, BLOCK_BYTES = 0.25, 1 << 16
END = b""
_CHUNK = 1 << 16
#: Histories whose class scores are held at a time, so that they stay in the cache.
_SCORED = 1 << 11


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_OUT


def tokens_of(text: str) -> list[bytes]:
    """Words, A-Z in lower case, and the end."""
    return [*text.encode().lower().split(), END]


def suffix(token: bytes) -> int:
    return zlib.crc32(token[-2:]) % SUFFIXES


def count_tokens(docs: DataFrame, every: int = 1 << 19) -> DataFrame:
    """token, c over the training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def sent() -> Iterator[pa.RecordBatch]:
            items = list(held.items())
            for i in range(0, len(items), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in items[i : i + 50_000]], pa.binary()), pa.array([c for _, c in items[i : i + 50_000]], pa.int64())], ["token", "c"])

        for batch in batches:
            for piece in pieces(batch):
                for doc_id, text in zip(piece.column("doc_id").to_pylist(), piece.column("text").to_pylist()):
                    if not held_out(doc_id):
                        held.update(tokens_of(text))
                if len(held) > every:
                    yield from sent()
                    held.clear()
        yield from sent()

    return docs.mapInArrow(run, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


def encode(docs: DataFrame, heavy: Any) -> DataFrame:
    """doc_id, held_out, ids (32-bit: a heavy word's rank, or HEAVY + suffix), and the other words with their counts in the document."""
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("ids", pa.binary()), ("words", pa.list_(pa.binary())), ("times", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = ranks_of(heavy.value)
        for batch in batches:
            for piece in pieces(batch):
                doc_ids, ids, words, times = piece.column("doc_id").to_pylist(), [], [], []
                for text in piece.column("text").to_pylist():
                    tokens = tokens_of(text)
                    own = [*map(rank.get, tokens)]
                    other: Counter = Counter()
                    if None in own:
                        for i, x in enumerate(own):
                            if x is None:
                                t = tokens[i]
                                own[i] = HEAVY + suffix(t)
                                other[t] += 1
                    ids.append(np.array(own, np.uint32).tobytes())
                    words.append(list(other))
                    times.append(list(other.values()))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array([held_out(i) for i in doc_ids]), pa.array(ids, pa.binary()), pa.array(words, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int32()))], schema=schema)

    return docs.mapInArrow(run, "doc_id long, held_out boolean, ids binary, words array<binary>, times array<int>")


_RANKS: dict[int, dict[bytes, int]] = {}


def ranks_of(tokens: list[bytes]) -> dict[bytes, int]:
    key = zlib.crc32(b"\n".join(tokens))
    if key not in _RANKS:
        _RANKS.clear()
        _RANKS[key] = {t: i for i, t in enumerate(tokens)}
    return _RANKS[key]


def table_rows(n_tokens: int) -> int:
    """Rows of the feature table: a power of two about the square root of the number of tokens."""
    return min(MOST_ROWS, max(LEAST_ROWS, 1 << round(math.log2(max(1.3 * n_tokens**0.5, 1)))))


def code_table(tokens: list[bytes], frequent: int) -> np.ndarray:
    """Codes by id: frequent words have their own, all others that of their suffix; the last code stands before a text."""
    out = np.empty(HEAVY + SUFFIXES, np.int64)
    out[: len(tokens)] = [i if i < frequent else frequent + suffix(t) for i, t in enumerate(tokens)]
    out[len(tokens) : HEAVY] = frequent
    out[HEAVY:] = frequent + np.arange(SUFFIXES)
    return out


def histories(columns: list[bytes], codes: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Ids, codes, and the three codes before each, of about `_CHUNK` tokens at a time; document: index of each token's text."""
    held, size, begin = [], 0, codes[-1] + 1
    for k, ids in enumerate(columns):
        own = np.frombuffer(ids, np.uint32)
        for a in range(0, len(own), _CHUNK):  # a long text goes through in parts that overlap by three tokens
            part = own[max(0, a - 3) : a + _CHUNK]
            c = codes[part]
            lead = min(a, 3)
            c = np.concatenate([np.full(3 - lead, begin), c])
            held.append((part[lead:], c, np.full(len(part) - lead, k)))
            size += len(part) - lead
            if size >= _CHUNK:
                yield _joined(held)
                held, size = [], 0
    if held:
        yield _joined(held)


def _joined(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    c = [h[1] for h in held]
    return (np.concatenate([h[0] for h in held]), *(np.concatenate([x[3 - k : len(x) - k] for x in c]) for k in range(4)), np.concatenate([h[2] for h in held]))


_MIX = np.uint64(0x9E3779B97F4A7C15)


def feature_hashes(one: np.ndarray, two: np.ndarray, three: np.ndarray, codes: int) -> list[np.ndarray]:
    """Hashes of bigram, trigram and two skip features of a history."""
    return [(x.astype(np.uint64) * np.uint64(FEATURES) + np.uint64(k) + np.uint64(1)) * _MIX for k, x in enumerate((one, one * (codes + 1) + two, two, three))]


def rows_of_hashes(hashes: list[np.ndarray], rows: int, classes: np.ndarray | None = None) -> list[np.ndarray]:
    """Rows of the weight table of the first factor, or with the class hashed along of the second."""
    shift = np.uint64(64 - (rows.bit_length() - 1))
    if classes is not None:
        along = (classes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        hashes = [(h ^ along) * _MIX for h in hashes]
    return [(h >> shift).astype(np.int64) for h in hashes]


def softmax_scores(rows: list[np.ndarray], bias: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores of the outcomes after each history, their exponentials and the sums of these. Weights are bounded by `MOST_WEIGHT`, so that nothing overflows."""
    z = np.take(weights, rows[0], axis=0, mode="clip")
    one = np.empty_like(z)
    for r in rows[1:]:
        z += np.take(weights, r, axis=0, out=one, mode="clip")
    z += bias
    e = np.exp(z)
    return z, e, e @ np.ones(e.shape[1], e.dtype)


def factors(m: dict, code: np.ndarray, one: np.ndarray, two: np.ndarray, three: np.ndarray):
    """For both factors: the rows of the features, the outcome of each token, the bias (a line for each token or one for all) and the weights' place."""
    hashes, c = feature_hashes(one, two, three, len(m["classes"])), m["classes"][code]
    yield rows_of_hashes(hashes, m["rows"]), c, m["bias"][0][None], 0
    yield rows_of_hashes(hashes, m["rows"], c), m["parts"][code], m["bias"][1][c], 1


def log_factors(m: dict, code: np.ndarray, one: np.ndarray, two: np.ndarray, three: np.ndarray) -> np.ndarray:
    """log of P(class | history) * P(part | class, history) of each token."""
    out = np.zeros(len(code))
    for rows, outcome, bias, f in factors(m, code, one, two, three):
        for a in range(0, len(code), _SCORED):
            at = slice(a, a + _SCORED)
            z, _, total = softmax_scores([r[at] for r in rows], bias if len(bias) == 1 else bias[at], m["weights"][f])
            out[at] += z[np.arange(len(z)), outcome[at]].astype(np.float64) - np.log(total)
    return out


def add_by_row(rows: np.ndarray, values: np.ndarray, out: np.ndarray) -> None:
    """Add values (a line for each class) to the columns of out (a line for each class) that `rows` names."""
    for k in range(len(values)):
        out[k] += np.bincount(rows, values[k], out.shape[1])


def add_counts(rows: np.ndarray, classes: np.ndarray, out: np.ndarray) -> None:
    """Count pairs of class and row in out (a line for each class)."""
    out += np.bincount(classes * out.shape[1] + rows, minlength=out.size).reshape(out.shape)


def summed(encoded: DataFrame, shape: tuple[int, int], add, n_tokens: int) -> np.ndarray:
    """The sum over tasks of arrays that add(columns of ids, array) fills from training documents. Blocks are summed by a shuffle; the driver gets the sum."""
    size = shape[0] * shape[1]
    step = BLOCK_BYTES // 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(shape, np.float64)
        for batch in batches:
            for piece in pieces(batch, "ids"):
                add(piece.column("ids").to_pylist(), own)
        flat = own.ravel()
        for a in range(0, size, 64 * step):
            at = [i for i in range(a, min(a + 64 * step, size), step) if flat[i : i + step].any()]
            yield pa.RecordBatch.from_pydict({"block": pa.array([i // step for i in at], pa.int32()), "part": pa.array([flat[i : i + step].astype(np.float32).tobytes() for i in at], pa.binary())})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, x in zip(batch.column("block").to_pylist(), batch.column("part").to_pylist()):
                x = np.frombuffer(x, np.float32)
                own[k] = own[k] + x if k in own else x.astype(np.float64)
        yield pa.RecordBatch.from_pydict({"block": pa.array(own, pa.int32()), "part": pa.array([x.astype(np.float32).tobytes() for x in own.values()], pa.binary())})

    tasks = max(16, int(SENT * 4 * n_tokens / (4 * size)))
    n = min(int(encoded.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // step))
    parts = encoded.filter("not held_out").select("ids").coalesce(tasks).mapInArrow(run, "block int, part binary")
    got = parts.repartition(n, "block").mapInArrow(merge, "block int, part binary").toArrow()
    out = np.zeros(size)
    for k, x in zip(got["block"].to_pylist(), got["part"].to_pylist()):
        x = np.frombuffer(x, np.float32)
        out[k * step : k * step + len(x)] = x
    return out.reshape(shape)


def word_classes(contexts: np.ndarray, classes: int = CLASSES, rounds: int = 15) -> np.ndarray:
    """A class for each code, by k-means on the square roots of its context shares; codes without contexts go to class 0."""
    mass = contexts.sum(1)
    seen = np.flatnonzero(mass > 0)
    out = np.zeros(len(contexts), np.int64)
    if not len(seen):
        return out
    x = np.sqrt(contexts[seen] / mass[seen, None])
    weight = mass[seen]
    centres = x[[int(np.argmax(weight))]]
    near = ((x - centres[0]) ** 2).sum(1)
    while len(centres) < min(classes, len(seen)):
        pick = int(np.argmax(near * np.sqrt(weight)))
        centres = np.vstack([centres, x[pick]])
        near = np.minimum(near, ((x - x[pick]) ** 2).sum(1))
    for _ in range(rounds):
        own = np.argmin((centres**2).sum(1)[None] - 2 * x @ centres.T, axis=1)
        total = np.zeros((len(centres), x.shape[1]))
        np.add.at(total, own, x * weight[:, None])
        size = np.bincount(own, weight, len(centres))
        centres = np.where(size[:, None] > 0, total / np.maximum(size, 1e-9)[:, None], centres)
    out[seen] = own
    return out


def class_parts(classes: np.ndarray, mass: np.ndarray, frequent: int) -> np.ndarray:
    """A part of its class for each code: the class's most frequent words have one each, all other codes share the last."""
    out = np.full(len(classes), PARTS - 1)
    for c in range(CLASSES):
        own = np.flatnonzero((classes[:frequent] == c) & (mass[:frequent] > 0))
        own = own[np.lexsort((own, -mass[own]))][: PARTS - 1]
        out[own] = np.arange(len(own))
    return out


def train(encoded: DataFrame, tokens: list[bytes], heavy_counts: np.ndarray, rest: DataFrame, n_tokens: int, rounds: int = ROUNDS) -> dict:
    """The model: code table, classes and parts of codes, statistics of parts, and weights. rest: counts of the words that are not heavy."""
    spark = encoded.sparkSession
    rows = table_rows(n_tokens)
    frequent = rows // 4
    codes = code_table(tokens, frequent)
    n_codes = frequent + SUFFIXES
    share = spark.sparkContext.broadcast(codes)

    def contexts(columns: list[bytes], out: np.ndarray) -> None:
        for _, own, one, _, _, _ in histories(columns, share.value):
            ok = one < CONTEXTS
            add_counts(own[ok], one[ok], out)

    classes = word_classes(summed(encoded, (CONTEXTS, n_codes), contexts, n_tokens).T)
    # tokens, words and words seen once of each code, then of each part
    of_code = np.zeros((n_codes, 3))
    code = codes[: len(tokens)]
    for k, w in enumerate((heavy_counts, np.ones(len(tokens)), heavy_counts == 1)):
        of_code[:, k] = np.bincount(code, w, n_codes)
    tail = rest.groupBy((F.crc32(F.expr("substring(token, -2, 2)")) % SUFFIXES).alias("s")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n"), F.sum((F.col("c") == 1).cast("long")).alias("once"))
    for r in tail.collect():
        of_code[frequent + r.s] += (r.c, r.n, r.once)
    parts = class_parts(classes, of_code[:, 0], frequent)
    leaf = classes * PARTS + parts
    stats = np.zeros((CLASSES * PARTS, 4))
    for k in range(3):
        stats[:, k] = np.bincount(leaf, of_code[:, k], CLASSES * PARTS)
    stats[:, 3] = np.bincount(leaf[frequent:], minlength=CLASSES * PARTS)  # codes that an unknown word may have
    there = (stats[:, 0] > 0) | (stats[:, 3] > 0)
    mass = (stats[:, 0] + KAPPA * there).reshape(CLASSES, PARTS) + 1e-9
    prior = [mass.sum(1) / mass.sum(), mass / mass.sum(1, keepdims=True)]
    model = {"codes": codes, "classes": classes, "parts": parts, "leaf": leaf, "stats": stats, "rows": rows, "bias": [np.log(p).astype(np.float32) for p in prior]}
    held = spark.sparkContext.broadcast(model)

    def observed(columns: list[bytes], out: np.ndarray) -> None:
        m = held.value
        for _, own, one, two, three, _ in histories(columns, m["codes"]):
            for at, outcome, _, f in factors(m, own, one, two, three):
                for r in at:
                    add_counts(r, outcome, out[f * CLASSES : f * CLASSES + CLASSES])

    seen = summed(encoded, (CLASSES + PARTS, rows), observed, n_tokens)
    seen = [np.ascontiguousarray(seen[:CLASSES].T), np.ascontiguousarray(seen[CLASSES:].T)]
    # a feature's rows are shared by classes in the second factor, so that their mean prior stands behind it
    behind = [KAPPA * prior[0], KAPPA * (prior[0] @ prior[1]) + 1e-9]
    # the first weights: how far each feature's counts are from the prior, shared among the features of a history
    weights = [(np.log((s + b) / (s.sum(1, keepdims=True) + KAPPA) / (b / KAPPA)) / FEATURES).astype(np.float32) for s, b in zip(seen, behind)]
    weights = [np.clip(w, -MOST_WEIGHT, MOST_WEIGHT) for w in weights]
    for _ in range(rounds):
        now = spark.sparkContext.broadcast(weights)

        def expect(columns: list[bytes], out: np.ndarray, now=now) -> None:
            m = held.value
            for _, own, one, two, three, _ in histories(columns, m["codes"]):
                for at, _, bias, f in factors(m, own, one, two, three):
                    p = np.empty((CLASSES, len(own)))
                    for a in range(0, len(own), _SCORED):
                        k = slice(a, a + _SCORED)
                        _, e, total = softmax_scores([r[k] for r in at], bias if len(bias) == 1 else bias[k], now.value[f])
                        p[:, k] = (e / total[:, None]).T
                    for r in at:
                        add_by_row(r, p, out[f * CLASSES : f * CLASSES + CLASSES])

        # a round goes over all training documents, as the observed counts do
        expected = summed(encoded, (CLASSES + PARTS, rows), expect, n_tokens)
        for f, (s, b) in enumerate(zip(seen, behind)):
            e = expected[f * CLASSES : f * CLASSES + CLASSES].T
            step = np.clip(STEP * (s - e - DECAY * weights[f]) / (e + DECAY + b), -MOST_STEP, MOST_STEP)
            weights[f] = np.ascontiguousarray(np.clip(weights[f] + step, -MOST_WEIGHT, MOST_WEIGHT), np.float32)
        now.unpersist()
    return model | {"weights": weights}


def word_factors(stats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per part: the discount of a known word's count, log10 of the part's tokens, log10 of the unknown word's share. A part that no unknown word can have discounts nothing."""
    mass, words, once, open_ = stats.T
    discount = np.where((words > 0) & (open_ > 0), np.clip((once + 0.5) / np.maximum(words, 1), 0.01, 0.9), 0.0)
    total = np.log10(np.maximum(mass, 1.0))
    unknown = np.where(mass > 0, np.log10(np.maximum(discount * words, 1e-12)) - total, 0.0)
    return discount, total, unknown


def score(docs: DataFrame, heavy: int = HEAVY, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row."""
    spark = docs.sparkSession
    docs = id_text(docs)
    counts = cut(count_tokens(docs), "counts")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    # counts fall into a few hundred levels; as many whole levels count as heavy as hold no more than `heavy` words
    short = F.octet_length("token") <= LONG
    levels, above, least = counts.filter(short).groupBy(F.floor(F.log2("c") * 8).alias("level")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("c")).collect(), 0, None
    for r in sorted(levels, key=lambda r: -r.level):
        if above + r.n > heavy:
            break
        above, least = above + r.n, r.c
    chosen = short & (F.col("c") >= least) if least is not None else F.lit(False)
    top = counts.filter(chosen).toArrow().sort_by([("c", "descending"), ("token", "ascending")])
    tokens, heavy_counts = top["token"].to_pylist(), np.array(top["c"].to_pylist(), np.float64)
    rest = counts.filter(~chosen)
    encoded = cut(encode(docs, spark.sparkContext.broadcast(tokens)).withColumn("rid", F.monotonically_increasing_id()), "encoded")
    model = train(encoded, tokens, heavy_counts, rest, int(n), rounds)
    discount, total, unknown = word_factors(model["stats"])
    leaf, codes = model["leaf"], model["codes"]
    of_word = leaf[codes[: len(tokens)]]
    own = np.zeros(HEAVY + SUFFIXES)  # log10 P(word | part) of heavy words; others get theirs by the join
    own[: len(tokens)] = np.log10(np.maximum(heavy_counts - discount[of_word], 1e-12)) - total[of_word]
    base = np.zeros(HEAVY + SUFFIXES)
    base[: len(tokens)] = np.log10(heavy_counts + 1)
    held = spark.sparkContext.broadcast(model | {"own": own, "base": base})
    schema = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            for piece in pieces(batch, "ids"):
                columns, k = piece.column("ids").to_pylist(), piece.num_rows
                sums = np.zeros((4, k))
                for ids, code, one, two, three, doc in histories(columns, m["codes"]):
                    z = log_factors(m, code, one, two, three) / np.log(10) + m["own"][ids]
                    for j, w in enumerate((None, ids < HEAVY, m["base"][ids], z)):
                        sums[j] += np.bincount(doc, w, k)
                yield pa.RecordBatch.from_arrays([piece.column("rid"), piece.column("doc_id"), piece.column("held_out"), pa.array(sums[0].astype(np.int64)), pa.array(sums[1].astype(np.int64)), pa.array(sums[2]), pa.array(sums[3])], schema=schema)

    near = encoded.select("rid", "doc_id", "held_out", "ids").mapInArrow(run, "rid long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double")
    tails = leaf[-SUFFIXES:]
    per = F.broadcast(spark.createDataFrame([(i, float(discount[x]), float(total[x]), float(unknown[x])) for i, x in enumerate(tails.tolist())], "s int, d double, t double, u double"))  # a row for each suffix
    far = encoded.select("rid", F.explode(F.arrays_zip("words", "times")).alias("x")).select("rid", F.col("x.words").alias("token"), F.col("x.times").alias("times"))
    far = far.join(rest, "token", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    far = far.withColumn("s", (F.crc32(F.expr("substring(token, -2, 2)")) % SUFFIXES).cast("int")).join(per, "s")
    word = F.when(F.col("c") > 0, F.log10(F.greatest(F.col("c") - F.col("d"), F.lit(1e-12))) - F.col("t")).otherwise(F.col("u"))
    far = far.groupBy("rid").agg(F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("known2"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("base2"), F.sum(F.col("times") * word).alias("score2"))
    scale = float(np.log10(n + v + 1))
    return near.join(far, "rid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("known2", F.lit(0))).cast("long").alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base2", F.lit(0.0)) - F.col("n_tokens") * F.lit(scale)).alias("base_score"),
        (F.col("score") + F.coalesce("score2", F.lit(0.0))).alias("score"),
    )


def op8_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(load(spark, sf_dir, "documents"))
