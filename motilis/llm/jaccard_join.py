"""Self-join of documents on the Jaccard similarity of their five-word shingles, 0.8 or more.

1. Documents with equal shingle sets fall together by a digest of the set; one representative of each goes on.
2. Candidates: MinHash bands. A pair at the threshold shares a band but for (1 - 0.8**ROWS)**BANDS, under 1e-6. Buckets with
   the same members are one bucket.
3. Bayesian pruning: within a bucket the MinHash values of a pair are compared a few at a time, and the pair is dropped once
   the posterior probability (uniform prior) that its similarity reaches the threshold falls below `TOLERANCE`. What a bucket
   sends on is a spanning forest of the surviving pairs, never the pairs themselves.
4. Surviving pairs connect candidate components (large-star / small-star rounds on a table of edges). A component's texts meet
   once, in blocks of bounded size, and every pair of a block pair is verified exactly from the whole sets by sparse counting.
   Only link counts and a spanning forest leave a task.

A bucket or component beyond one block is dealt out as pairs of blocks, so no task holds an unbounded group and none is
capped. Nothing per document reaches the driver.

Defined results: null text counts as empty; a text of one to four words has the one shingle of its words; a text without words
has no links and a class of its own; rows that repeat a text, or a doc_id, are rows of their own and are linked with each
other; class_id is the smallest doc_id of the class (null if all are null); an empty table gives an empty result; other columns
play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, id_text, load, pieces, sized
from .shingles import mix, shingle_hashes

THRESHOLD = 0.8
ROWS, BANDS = 5, 36
#: MinHash values that pruning compares, in steps.
COMPARED, STEP = 128, 16
TOLERANCE = 1e-6
#: Representatives in a block of a bucket, and of a component.
BUCKET_BLOCK = 1024
BLOCK = 512

_rng = np.random.default_rng(5)
_A = (_rng.integers(0, 1 << 31, ROWS * BANDS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, ROWS * BANDS, dtype=np.uint32)
_SIZE = 1 << 20


def minhashes(hashes: np.ndarray) -> np.ndarray:
    """MinHash values of a set of 64-bit hashes."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(_A), np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(x), 1024):
        np.minimum(out, (_A[:, None] * x[None, i : i + 1024] + _B[:, None]).min(axis=1), out=out)
    return out


def fewest_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE, compared: int = COMPARED, step: int = STEP) -> list[int]:
    """For each step, the least matches m of n at which P(similarity >= threshold | m of n) still reaches the tolerance.

    Under a uniform prior that probability is the chance of at most m successes in n + 1 trials at the threshold."""
    out = []
    for n in range(step, compared + 1, step):
        below, m = 0.0, -1
        while below < tolerance:
            m += 1
            below += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def survivors(a: np.ndarray, b: np.ndarray, least: list[int], step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of a and b that pruning keeps."""
    matches = np.zeros((len(a), len(b)), np.uint8)
    for k in range(step):
        matches += a[:, k, None] == b[None, :, k]
    i, j = np.nonzero(matches >= least[0])
    m = matches[i, j].astype(np.int32)
    for s in range(1, len(least)):
        if not len(i):
            break
        part = slice(s * step, (s + 1) * step)
        m = m + (a[i, part] == b[j, part]).sum(1)
        keep = m >= least[s]
        i, j, m = i[keep], j[keep], m[keep]
    return i, j


def forest(n: int, pairs: Iterator[tuple[int, int]] | list[tuple[int, int]]) -> list[int]:
    """The smallest connected index of each of n nodes."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def set_digest(hashes: np.ndarray) -> bytes:
    """128 bits of a set, whatever its order."""
    with np.errstate(over="ignore"):
        return np.array([mix(hashes).sum(dtype=np.uint64), mix(hashes ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)], np.uint64).tobytes()


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (SHA-256 of the text), n (distinct shingles), digest, sig (MinHash values, 16 bits each), bands (a key for each band)."""
    own_columns = ["doc_id", "text_key"]
    docs = docs.withColumn("text_key", text_key(F.col("text")))
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.binary()), ("n", pa.int32()), ("digest", pa.binary()), ("sig", pa.binary()), ("bands", pa.list_(pa.int64()))])
    salt = mix(np.arange(1, BANDS + 1, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[bytes, tuple[bytes, list[int]]] = {}
        for batch in batches:
            for piece in pieces(batch, "text", _SIZE):
                hashes, at = shingle_hashes(piece.column("text"))
                n, digest, sig, bands = [], [], [], []
                for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                    own = np.unique(hashes[a:b])
                    n.append(len(own))
                    d = set_digest(own)
                    digest.append(d)
                    if not len(own):
                        sig.append(b"")
                        bands.append([])
                        continue
                    if d not in last:
                        if len(last) > 2000:
                            last.clear()
                        x = minhashes(own)
                        key = salt.copy()
                        for r in range(ROWS):
                            key = mix(key * np.uint64(31) + x[r::ROWS][:BANDS].astype(np.uint64))
                        last[d] = (x[:COMPARED].astype(np.uint16).tobytes(), key.view(np.int64).tolist())
                    sig.append(last[d][0])
                    bands.append(last[d][1])
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in own_columns), pa.array(n, pa.int32()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], schema=schema)

    return docs.mapInArrow(run, "doc_id long, text_key binary, n int, digest binary, sig binary, bands array<long>")


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[dict[str, list]]:
    """Rows of sorted batches, a group of equal keys at a time, as columns."""
    held: dict[str, list] | None = None
    at = None
    for batch in batches:
        cols = {name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names)}
        own = list(zip(*(cols[k] for k in keys)))
        i = 0
        while i < len(own):
            j = i + 1
            while j < len(own) and own[j] == own[i]:
                j += 1
            if held is not None and own[i] == at:
                for name in cols:
                    held[name].extend(cols[name][i:j])
            else:
                if held is not None:
                    yield held
                held, at = {name: cols[name][i:j] for name in cols}, own[i]
            i = j
    if held is not None:
        yield held


def in_block_pairs(df: DataFrame, group: str, size: str, block: int) -> DataFrame:
    """Deal each group's rows out as pairs of blocks: columns lo and hi name the pair, and own the row's block. Groups of one block stay whole."""
    blocks = F.ceil(F.col(size) / block).cast("int")
    own = F.pmod(F.xxhash64("cid"), F.greatest(blocks, F.lit(1))).cast("int")
    df = df.withColumn("blocks", blocks).withColumn("own", own)
    df = df.withColumn("other", F.explode(F.when(F.col("blocks") > 1, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.lit(0)))))
    return df.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other")).drop("other", "blocks")


def candidate_edges(reps: DataFrame) -> DataFrame:
    """Edges (u, v) that connect representatives whose pairs survive pruning."""
    spark = reps.sparkSession
    least = fewest_matches()
    rows = reps.filter("n > 0").select("cid", F.explode("bands").alias("key"))
    counted = rows.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.sum(F.xxhash64("cid").cast("decimal(20,0)")).alias("mark")).filter("m > 1")
    # buckets of the same members are one; written on its own, so that a hot key's rows can be split where they meet it
    first = cut(counted.groupBy("m", "mark").agg(F.min("key").alias("key")).select("key", "m"), "buckets")
    rows = cut(rows.join(sized(first), "key").select("key", "cid", "m"), "bucketed")
    rows = in_block_pairs(rows, "key", "m", BUCKET_BLOCK).join(reps.select("cid", "sig"), "cid")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "cid").select("key", "lo", "hi", "own", "cid", "sig")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, v = [], []
        for g in groups(batches, ["key", "lo", "hi"]):
            cids, own = g["cid"], np.array(g["own"])
            sigs = np.frombuffer(b"".join(g["sig"]), np.uint16).reshape(len(cids), COMPARED)
            if g["lo"][0] == g["hi"][0]:
                left = right = np.arange(len(cids))
            else:
                left, right = np.flatnonzero(own == g["lo"][0]), np.flatnonzero(own == g["hi"][0])
            i, j = survivors(sigs[left], sigs[right], least)
            for x, r in enumerate(forest(len(cids), zip(left[i].tolist(), right[j].tolist()))):
                if r != x:
                    u.append(cids[r])
                    v.append(cids[x])
            if len(u) > 10_000:
                yield pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})
                u, v = [], []
        yield pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return rows.mapInArrow(run, "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Node and component (its smallest node) of each node of an edge table, by alternating large-star and small-star rounds."""
    edges = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct(), "edges")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        # large star: larger neighbours of u point to the smallest of u and its neighbours
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        # small star: u and its smaller neighbours point to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").unionByName(low.withColumnRenamed("m", "v")).distinct()
        edges = cut(small, "stars")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == seen:
            break
        seen = now
    out = edges.select(F.col("u").alias("cid"), F.col("v").alias("comp"))
    return out.unionByName(out.select(F.col("comp").alias("cid"), "comp").distinct())


def exact_links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (of left x right) whose Jaccard similarity reaches the threshold, from the whole sets."""
    sizes = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.empty(len(flat), bool)
    new[0] = True
    new[1:] = flat[1:] != flat[:-1]
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1  # only shingles of two sets or more count
    owner, column = owner[shared], column[shared]
    where_left, where_right = np.full(len(sets), -1), np.full(len(sets), -1)
    where_left[left], where_right[right] = np.arange(len(left)), np.arange(len(right))
    both = np.zeros((len(left), len(right)), np.float32)
    width = 4096
    if len(column):
        _, column = np.unique(column, return_inverse=True)
        bounds = np.searchsorted(column, np.arange(0, column[-1] + width + 1, width))
        for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
            x, y = np.zeros((len(left), width), np.float32), np.zeros((len(right), width), np.float32)
            o, c = owner[a:b], column[a:b] - k * width
            x[where_left[o][where_left[o] >= 0], c[where_left[o] >= 0]] = 1
            y[where_right[o][where_right[o] >= 0], c[where_right[o] >= 0]] = 1
            both += x @ y.T
    union = sizes[left][:, None] + sizes[right][None, :] - both
    return np.nonzero(both >= threshold * union - 1e-6)


def verified(docs: DataFrame, reps: DataFrame, comps: DataFrame) -> DataFrame:
    """For each representative of a candidate component and pair of blocks: cid, root (smallest connected cid there), links (rows linked with it there), texts (representatives linked), whole (the component has one block)."""
    spark = docs.sparkSession
    size = comps.groupBy("comp").agg(F.count(F.lit(1)).alias("size"))
    members = cut(comps.join(size, "comp").join(reps.select("cid", "rep", "rep_key", "copies"), "cid"), "members")
    docs = docs.withColumn("text_key", text_key(F.col("text")))
    met = docs.join(members.hint("merge"), docs.doc_id.eqNullSafe(F.col("rep")) & (docs.text_key == F.col("rep_key")))
    # rows that repeat doc_id and text are one from here on, before anything is dealt out
    met = met.groupBy("cid").agg(F.first("text").alias("text"), *(F.first(c).alias(c) for c in ("comp", "size", "copies")))
    met = in_block_pairs(met, "comp", "size", BLOCK)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = met.repartition(n, "comp", "lo", "hi").sortWithinPartitions("comp", "lo", "hi", "cid")
    met = met.select("comp", "lo", "hi", "own", "size", "cid", "copies", "text")
    schema = pa.schema([("cid", pa.int64()), ("root", pa.int64()), ("links", pa.int64()), ("texts", pa.int64()), ("whole", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def sets_first() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for piece in pieces(batch, "text", _SIZE):
                    hashes, at = shingle_hashes(piece.column("text"))
                    own = [np.unique(hashes[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                    names = [x for x in piece.schema.names if x != "text"]
                    yield pa.RecordBatch.from_arrays([*(piece.column(x) for x in names), pa.array([x.tobytes() for x in own], pa.binary())], [*names, "set"])

        for g in groups(sets_first(), ["comp", "lo", "hi"]):
            cids, sets = g["cid"], [np.frombuffer(x, np.uint64) for x in g["set"]]
            copies, own = np.array(g["copies"]), np.array(g["own"])
            same = g["lo"][0] == g["hi"][0]
            left = np.arange(len(cids)) if same else np.flatnonzero(own == g["lo"][0])
            right = left if same else np.flatnonzero(own == g["hi"][0])
            links, texts = np.zeros(len(cids), np.int64), np.zeros(len(cids), np.int64)
            pairs: list[tuple[int, int]] = []
            if len(left) and len(right):
                i, j = exact_links(sets, left, right)
                i, j = left[i], right[j]
                once = i < j if same else np.ones(len(i), bool)
                i, j = i[once], j[once]
                np.add.at(links, i, copies[j])
                np.add.at(links, j, copies[i])
                np.add.at(texts, i, 1)
                np.add.at(texts, j, 1)
                pairs = list(zip(i.tolist(), j.tolist()))
            whole = g["size"][0] <= BLOCK
            out.extend((cids[x], cids[r], int(links[x]), int(texts[x]), whole) for x, r in enumerate(forest(len(cids), pairs)))
            if len(out) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out.clear()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return met.mapInArrow(run, "cid long, root long, links long, texts long, whole boolean")


def text_key(text: Column) -> Column:
    """Binary SHA-256 of the text; null text counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def jaccard_classes(docs: DataFrame, keyed: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, class_id (smallest doc_id of those connected by links), n_links (other rows with a similarity of 0.8 or more), n_linked_texts (other shingle sets linked), class_size, kept (the one row of its class that stays); if keyed, its text_key besides."""
    docs = id_text(docs)
    rows = cut(signatures(docs).withColumn("rid", F.monotonically_increasing_id()), "signatures")
    order = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "rid", "text_key")
    some = rows.filter("n > 0").groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.min(order).alias("first"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    reps = cut(some.withColumn("cid", F.monotonically_increasing_id()).withColumn("rep", F.col("first.doc_id")).withColumn("rep_key", F.col("first.text_key")), "representatives")
    comps = components(candidate_edges(reps))
    found = cut(verified(docs, reps, comps), "verified")
    links = found.groupBy("cid").agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"), F.min("root").alias("root"))
    wide = found.filter("not whole and root != cid").select(F.col("cid").alias("u"), F.col("root").alias("v"))
    if wide.limit(1).count():  # components of several blocks are connected across them
        across = components(wide).select("cid", F.col("comp").alias("across"))
        links = links.join(across, "cid", "left").withColumn("root", F.coalesce("across", "root")).drop("across")
    classes = reps.select("cid", "digest", "copies", "first").join(links, "cid", "left")
    classes = classes.select("digest", "copies", "first", F.coalesce("root", "cid").alias("root"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("texts", F.lit(0)).alias("texts"))
    tops = classes.groupBy("root").agg(F.min("first").alias("top"), F.sum("copies").alias("class_size"))
    classes = classes.join(tops, "root").select("digest", "copies", "links", "texts", "top", "class_size")
    names = ["doc_id", "text_key"] if keyed else ["doc_id"]
    out = rows.select(*names, "rid", "digest").join(classes, "digest", "left")
    return out.select(
        *names,
        F.when(F.col("top").isNull(), F.col("doc_id")).otherwise(F.col("top.doc_id")).alias("class_id"),
        F.coalesce(F.col("copies") - 1 + F.col("links"), F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("texts", F.lit(0)).cast("long").alias("n_linked_texts"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        (F.col("top").isNull() | (F.col("top.rid") == F.col("rid"))).alias("kept"),
    )


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, one of each class, with all their columns. Of rows that repeat both doc_id and text any one can be the one that stays."""
    out = cut(jaccard_classes(docs, keyed=True).select("doc_id", "text_key", "kept"), "classes")
    # rows of one doc_id and text have one set: all stay (it is empty), all go, or one stays
    pairs = out.groupBy(F.col("doc_id").alias("__id"), F.col("text_key").alias("__gone")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("kept").cast("long")).alias("k"))
    pairs = cut(pairs.filter("k < n"), "pairs")
    met = lambda df, of, how: df.join(of.hint("merge"), F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__gone")), how)
    left = docs.withColumn("__key", text_key(F.col("text")))
    left_alone = met(left, pairs.select("__id", "__gone"), "left_anti")
    some = pairs.filter("k > 0").select("__id", "__gone")
    if some.limit(1).count():
        left_alone = left_alone.unionByName(met(left, some, "left_semi").dropDuplicates(["doc_id", "__key"]))
    return left_alone.drop("__key")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(load(spark, sf_dir, "documents"))
