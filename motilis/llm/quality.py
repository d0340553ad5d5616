"""Quality classifier by co-training.

Two views of a document have a logistic classifier each. The content view reads the text: hashed character 4-grams of its words,
and its shares of repeated words, capitals, digits, marks and non-ASCII bytes. The metadata view never looks at words: it holds
what the page's record says, source, language and number of characters, and how the page is laid out, its lines, their lengths
and the blank ones. Both are trained on labelled rows; then, in rounds, each scores all unlabelled documents of the table, and
some of those it is surest of become labelled rows of the other view. Each view is calibrated on labelled rows kept apart (Platt
scaling), and the score is the logistic of the sum of the calibrated log-odds, weighted by how well each view does there.

The features of all documents are written once, about a kilobyte each; every round and the final scores read them on the
executors. A view hands over `PSEUDO` documents a round, as co-training has it: of all that it is sure of, those whose hash
of the text comes first, equal texts once. Fitting takes at most `MOST_LABELLED` labelled rows, those with the smallest hash of
doc_id. Only these bounded sets reach the driver.

Defined results: null text counts as empty; an empty text has only its metadata; null source, language or n_chars is a value of
its own; without labelled rows of both kinds nothing can be learnt and every score is 1, so that nothing is rejected; labels
that contradict each other for a doc_id count once each; of rows that repeat a labelled doc_id one, with the least hash of its
text, is learnt from; an empty table gives an empty result; a table without n_chars has null there; other columns play no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import utf8
from .common import cut, load, pieces, sized
from .shingles import _SPACE, word_hashes

#: Most labelled rows to fit on.
MOST_LABELLED = 4000
#: Documents that each view labels for the other in a round.
PSEUDO = 400
GRAMS, SHARES = 1024, 16
SOURCES, LANGS, LAYOUT = 64, 32, 16
META = LAYOUT + SOURCES + LANGS
ROUNDS = 3
SURE = 0.9
#: One labelled row in so many is kept apart for calibration.
HELD = 5
#: Bytes of text whose features are computed at a time.
PIECE = 1 << 19
#: A document is rejected if its chance of good quality is below this.
REJECT = 0.5
#: A view's calibrated log-odds are held within these bounds: beyond the labelled rows no view is certain.
SUREST = 6.0
#: Standard deviation, by view, below which a feature is not scaled up further: grams keep their scale.
LEAST_SPREAD = (1.0, 0.1)
#: Features are kept as bytes: so many steps to the unit.
GRAM_STEPS, STEPS = 1020, 60

_MARK = np.zeros(256, bool)
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_PLAIN_MARK = np.zeros(256, bool)
_PLAIN_MARK[[33, 44, 46, 58, 59, 63]] = True


def gram_places(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed places of the 4-grams of bytes within words, and the number before each text."""
    if len(raw) < 4:
        return np.zeros(0, np.int64), np.zeros(len(ends) + 1, np.int64)
    space = _SPACE[raw]
    word = np.where(space, np.uint8(32), raw).astype(np.uint32)
    grams = word[:-3] | (word[1:-2] << np.uint32(8)) | (word[2:-1] << np.uint32(16)) | (word[3:] << np.uint32(24))
    ok = np.ones(len(grams), bool)
    for back in range(3):  # a 4-gram lies within one text
        edge = ends[:-1] - 1 - back
        edge = edge[(edge >= 0) & (edge < len(ok))]
        ok[edge] = False
    ok &= ~(space[:-3] & space[3:])
    at = np.flatnonzero(ok)
    places = ((grams[at] * np.uint32(0x9E3779B1)) >> np.uint32(32 - (GRAMS.bit_length() - 1))).astype(np.int64)
    return places, np.searchsorted(at, np.concatenate([[0], ends]))


def stepped(x: np.ndarray, steps: int) -> np.ndarray:
    return np.clip(np.rint(x * steps), 0, 255).astype(np.uint8)


def content_view(raw: np.ndarray, ends: np.ndarray, words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of each text, in steps: square roots of its grams' shares (long and short texts have the same norm), then the shares of kinds of bytes and words."""
    places, bounds = gram_places(raw, ends)
    begins = np.concatenate([[0], ends[:-1]])
    n = ends - begins
    out = np.zeros((len(ends), GRAMS + SHARES), np.uint8)
    shares = np.zeros((len(ends), SHARES))
    kinds = [(65 <= raw) & (raw <= 90), (48 <= raw) & (raw <= 57), _MARK[raw], raw >= 128, (97 <= raw) & (raw <= 122), _PLAIN_MARK[raw]]
    for j, k in enumerate(kinds):
        s = np.concatenate([[0], np.cumsum(k)])
        shares[:, j] = (s[ends] - s[begins]) / np.maximum(n, 1) * (20 if j == 5 else 4)
    count = np.diff(at)
    for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        if b > a:
            out[i, :GRAMS] = stepped(np.sqrt(np.bincount(places[a:b], minlength=GRAMS) / (b - a)), GRAM_STEPS)
        own = words[at[i] : at[i + 1]]
        if len(own):
            distinct = len(np.unique(own))
            shares[i, 6] = 1 - distinct / len(own)
            shares[i, 7] = np.mean(own[1:] == own[:-1]) * 4 if len(own) > 1 else 0.0
            shares[i, 8] = shares[i, 6] * np.log1p(n[i]) / 10
    shares[:, 9] = n / np.maximum(count, 1) / 10
    shares[:, 10] = n > 0
    out[:, GRAMS:] = stepped(shares, STEPS)
    return out


def metadata_view(raw: np.ndarray, ends: np.ndarray, piece: pa.RecordBatch) -> np.ndarray:
    """Of each page, in steps: its layout, then its source and language."""
    begins = np.concatenate([[0], ends[:-1]])
    out = np.zeros((len(ends), META))
    breaks = np.flatnonzero(raw == 10)
    first = np.searchsorted(breaks, begins), np.searchsorted(breaks, ends)
    chars = piece.column("n_chars").to_pylist()
    for i, (a, b, x, y) in enumerate(zip(begins.tolist(), ends.tolist(), first[0].tolist(), first[1].tolist())):
        lines = np.diff(np.concatenate([[a - 1], breaks[x:y], [b]])) - 1
        full = lines[lines > 0]
        out[i, :4] = np.log1p(b - a) / 5, np.log1p(len(lines)) / 3, np.mean(lines == 0), b == a
        if len(full):
            out[i, 4:8] = np.log1p(full.mean()) / 3, np.log1p(full.max()) / 4, np.log1p(full.min()) / 4, full.std() / (full.mean() + 1)
            out[i, 8] = np.mean(full[1:] == full[:-1]) if len(full) > 1 else 0.0
            out[i, 9] = np.mean(full < 30)
        out[i, 10] = 0.0 if chars[i] is None else np.log1p(max(chars[i], 0)) / 5
        out[i, 11] = chars[i] is None
    out[:, 12] = 1
    for i, (s, g) in enumerate(zip(piece.column("source").to_pylist(), piece.column("lang").to_pylist())):
        out[i, LAYOUT + zlib.crc32(repr(s).encode()) % SOURCES] = 0.5
        out[i, LAYOUT + SOURCES + zlib.crc32(repr(g).encode()) % LANGS] = 0.5
    return stepped(out, STEPS)


def views(piece: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Both views, in steps, of a batch with text, source, lang and n_chars."""
    column = piece.column("text")
    raw, ends = utf8(column)
    words, at = word_hashes(column)
    return content_view(raw, ends, words, at), metadata_view(raw, ends, piece)


def real(x: np.ndarray) -> np.ndarray:
    """Features of either view as numbers."""
    x = x.astype(np.float32)
    if x.shape[1] == META:
        return x / np.float32(STEPS)
    x[:, :GRAMS] /= GRAM_STEPS
    x[:, GRAMS:] /= STEPS
    return x


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-3, steps: int = 300) -> np.ndarray:
    """Weights and bias by accelerated gradient descent; deterministic. No copy of x is made."""
    d = x.shape[1]
    w, v, b, vb = np.zeros(d), np.zeros(d), 0.0, 0.0
    weight = weight / weight.sum()
    size = 4.0 / (float(weight @ np.einsum("ij,ij->i", x, x)) + 1.0 + penalty)
    for k in range(steps):
        m = k / (k + 3)
        aw, ab = w + m * v, b + m * vb
        g = weight * (sigmoid(x @ aw.astype(x.dtype) + ab) - y)
        nw, nb = aw - size * (g.astype(x.dtype) @ x + penalty * aw), ab - size * g.sum()
        v, vb, w, b = nw - w, nb - b, nw, nb
    return np.append(w, b)


def fit_view(x: np.ndarray, y: np.ndarray, least_spread: float) -> np.ndarray:
    """Weights and bias of a view, whose features are centred and scaled for the fit."""
    centre, spread = x.mean(0), np.maximum(x.std(0), np.float32(least_spread))
    w = fit_logistic((x - centre) / spread, y, balanced(y))
    out = w[:-1] / spread
    return np.append(out, w[-1] - out @ centre)


def odds(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1].astype(x.dtype) + w[-1]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def balanced(y: np.ndarray) -> np.ndarray:
    """Weights that give both kinds the same total."""
    good = max(float(y.sum()), 1.0)
    bad = max(float(len(y) - y.sum()), 1.0)
    return np.where(y > 0, 1 / good, 1 / bad)


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift that calibrate log-odds of unit size. Few rows don't make certain: the targets are (good + 1) / (good + 2) and 1 / (bad + 2)."""
    good, bad = float((y > 0).sum()), float((y == 0).sum())
    w = fit_logistic(z[:, None], np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2)), np.ones(len(y)), 1e-4, 500)
    return float(w[0]), float(w[1])


def calibrated(x: np.ndarray, w: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Scale and shift of a view's log-odds, and by how much its log-loss is below that of a coin, both kinds counted alike."""
    z = odds(x, w).astype(np.float64)
    norm = float(np.abs(z).mean() + 1e-9)
    a, b = platt(z / norm, y)
    said = a * z / norm + b - np.log(y.mean() / (1 - y.mean()))
    loss = np.logaddexp(0, np.where(y > 0, -said, said))
    return a / norm, b, max(float(np.log(2) - (loss[y > 0].mean() + loss[y == 0].mean()) / 2), 1e-3)


def cotrain(labelled: tuple[np.ndarray, np.ndarray], y: np.ndarray, keep: np.ndarray, exchange, rounds: int = ROUNDS) -> dict:
    """The two classifiers and their calibration. labelled: both views of labelled rows; keep: those kept apart for calibration.

    exchange(models, scale) names what each view is sure of among the unlabelled documents: for each view, both views of some
    documents and their pseudo-labels, each document once in all rounds."""
    fit = ~keep if keep.any() and 0 < y[~keep].sum() < (~keep).sum() and 0 < y[keep].sum() < keep.sum() else np.ones(len(y), bool)
    held = keep if fit.sum() < len(y) else fit
    xs, ts = [labelled[v][fit] for v in (0, 1)], [y[fit], y[fit]]
    for k in range(rounds + 1):
        models = [fit_view(xs[v], ts[v], LEAST_SPREAD[v]) for v in (0, 1)]
        scale = [calibrated(labelled[v][held], models[v], y[held]) for v in (0, 1)]
        if k == rounds:
            break
        given = exchange(models, scale)
        for v in (0, 1):  # each view labels for the other
            both, t = given[v]
            if len(t):
                xs[1 - v], ts[1 - v] = np.vstack([xs[1 - v], both[1 - v]]), np.concatenate([ts[1 - v], t])
    total = scale[0][2] + scale[1][2]
    return {"models": models, "scale": [(a, b, 2 * w / total) for a, b, w in scale]}


def combine(model: dict, content_odds: np.ndarray, meta_odds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Calibrated chances of good quality by content, by metadata, and by both."""
    (a0, b0, w0), (a1, b1, w1) = model["scale"]
    z0, z1 = np.clip(a0 * content_odds + b0, -SUREST, SUREST), np.clip(a1 * meta_odds + b1, -SUREST, SUREST)
    return sigmoid(z0), sigmoid(z1), sigmoid((w0 * z0 + w1 * z1) / 2)


def prepared(docs: DataFrame) -> DataFrame:
    chars = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), chars.alias("n_chars"))


def features(docs: DataFrame) -> DataFrame:
    """doc_id, tk (hash of the text), content, meta (bytes) of each row, written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", PIECE):
                both = (pa.array([x.tobytes() for x in v], pa.binary()) for v in views(piece))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("tk"), *both], ["doc_id", "tk", "content", "meta"])

    return cut(prepared(docs).withColumn("tk", F.xxhash64("text")).mapInArrow(run, "doc_id long, tk long, content binary, meta binary"), "features")


def matrices(content: list[bytes], meta: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return tuple(real(np.frombuffer(b"".join(x), np.uint8).reshape(len(x), d)) for x, d in ((content, GRAMS + SHARES), (meta, META)))


def gathered(rows: DataFrame, by: list[str]) -> pa.Table:
    """One row for each value of `by`, of a bounded number of values, in order."""
    one = rows.groupBy(*by).agg(F.min(F.struct(F.col("tk").alias("k"), "meta", "content")).alias("x"))
    return one.select(*by, "x.content", "x.meta").toArrow().sort_by([(c, "ascending") for c in by])


def learn_from(table: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED, pseudo: int = PSEUDO, rounds: int = ROUNDS) -> dict | None:
    """Fit on a table of features()."""
    spark = table.sparkSession
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).filter("doc_id is not null and y is not null")
    some = labels.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(most_labelled)
    got = gathered(table.join(F.broadcast(some), "doc_id"), ["doc_id", "y"])
    y = np.array(got["y"].to_pylist(), np.int64)
    if not (y == 1).any() or not (y == 0).any():
        return None
    keep = np.array([zlib.crc32(str(i).encode()) % HELD == 0 for i in got["doc_id"].to_pylist()])
    labelled = matrices(got["content"].to_pylist(), got["meta"].to_pylist())
    del got
    known = sized(cut(labels.select("doc_id").distinct(), "labelled"))
    taken: set[int] = set()

    def exchange(models: list[np.ndarray], scale: list) -> list:
        held = spark.sparkContext.broadcast((models, scale))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            models, scale = held.value
            for batch in batches:
                xs = matrices(batch.column("content").to_pylist(), batch.column("meta").to_pylist()) if batch.num_rows else ()
                for v, x in enumerate(xs):
                    p = sigmoid(scale[v][0] * odds(x, models[v]) + scale[v][1])
                    for good, at in ((1, np.flatnonzero(p >= SURE)), (0, np.flatnonzero(p <= 1 - SURE))):
                        part = batch.select(["doc_id", "tk"]).take(pa.array(at))
                        yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(len(at), v), pa.int32()), pa.array(np.full(len(at), good), pa.int32())], ["doc_id", "tk", "v", "good"])

        sure = table.mapInArrow(run, "doc_id long, tk long, v int, good int")
        sure = cut(sure.join(known, "doc_id", "left_anti").select("tk", "v", "good").distinct(), "sure")
        share = float(y.mean())
        asked = [(v, good, max(1, round(pseudo * (share if good else 1 - share)))) for v in (0, 1) for good in (1, 0)]
        picks = [sure.filter((F.col("v") == v) & (F.col("good") == good)).orderBy("tk").limit(k + len(taken)) for v, good, k in asked]
        rows = picks[0].unionByName(picks[1]).unionByName(picks[2]).unionByName(picks[3]).collect()  # a bounded number
        chosen: dict[int, tuple[int, int]] = {}
        for v in (0, 1):  # both kinds in the labelled rows' proportion, as many as the scarcer one allows: a view sure of one kind only would teach that all is of it
            free = {good: sorted(r.tk for r in rows if (r.v, r.good) == (v, good) and r.tk not in taken and r.tk not in chosen) for good in (1, 0)}
            part = min(1.0, *(len(free[good]) / k for w, good, k in asked if w == v))
            for w, good, k in asked:
                if w == v:
                    chosen |= dict.fromkeys(free[good][: int(part * k)], (v, good))
        taken.update(chosen)
        held.unpersist()
        none = np.zeros(0)
        if not chosen:
            return [((none, none), none)] * 2
        few = spark.createDataFrame([(k,) for k in chosen], "tk long")
        got = gathered(table.join(F.broadcast(few), "tk"), ["tk"])
        both = matrices(got["content"].to_pylist(), got["meta"].to_pylist())
        of = [chosen[k] for k in got["tk"].to_pylist()]
        out = []
        for v in (0, 1):
            at = [i for i, (w, _) in enumerate(of) if w == v]
            out.append(((both[0][at], both[1][at]), np.array([of[i][1] for i in at], np.float64)))
        return out

    return cotrain(labelled, y.astype(np.float64), keep, exchange, rounds)


def learn(docs: DataFrame, labels: DataFrame, **how) -> dict | None:
    return learn_from(features(docs), labels, **how)


def scores(docs: DataFrame, labels: DataFrame, reject: float = REJECT, **how) -> DataFrame:
    """doc_id, p_content, p_meta, score, accepted of each row of docs, by a model learnt from docs and labels."""
    table = features(docs)
    model = learn_from(table, labels, **how)
    if model is None:
        return table.select("doc_id", *(F.lit(1.0).alias(c) for c in ("p_content", "p_meta", "score")), F.lit(True).alias("accepted"))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            if batch.num_rows:
                x = matrices(batch.column("content").to_pylist(), batch.column("meta").to_pylist())
                out = [np.asarray(p, np.float64) for p in combine(m, odds(x[0], m["models"][0]), odds(x[1], m["models"][1]))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, out), pa.array(out[2] >= reject)], ["doc_id", "p_content", "p_meta", "score", "accepted"])

    return table.mapInArrow(run, "doc_id long, p_content double, p_meta double, score double, accepted boolean")


def keep_good(docs: DataFrame, labels: DataFrame, reject: float = REJECT, **how) -> DataFrame:
    """The rows of docs that the classifier accepts, with all their columns, in one more pass over them."""
    model = learn(docs, labels, **how)
    if model is None:
        return docs
    held = docs.sparkSession.sparkContext.broadcast(model)
    names, schema = docs.columns, docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            for piece in pieces(batch, "text", PIECE):
                chars = piece.column("n_chars").cast(pa.int64()) if "n_chars" in names else pa.nulls(piece.num_rows, pa.int64())
                part = pa.RecordBatch.from_arrays([piece.column("text").fill_null(""), piece.column("source").cast(pa.string()), piece.column("lang").cast(pa.string()), chars], ["text", "source", "lang", "n_chars"])
                content, meta = map(real, views(part))
                *_, c = combine(m, odds(content, m["models"][0]), odds(meta, m["models"][1]))
                yield piece.filter(pa.array(np.asarray(c, np.float64) >= reject)).select(names)

    return docs.mapInArrow(run, schema)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
