"""Mixing sources to target weights by the cube method.

Each source's target in words gives its documents one inclusion rate between 0 and 2: the whole part is taken for certain and
the fraction is an inclusion probability. Flight moves these probabilities along the null space of two balancing constraints,
the number of documents and the number of words, until they are 0 or 1. A source is cut into hashed blocks of bounded size
that fly apart from each other; each block leaves at most two undecided documents, and these fly again, level by level, in
blocks of the next level. Once a source has few left, one last flight leaves at most `LANDING` documents, and landing rounds
those to whichever ends keep the words nearest their total.

Draws are seeded by source, level and block, and documents are dealt out and ordered by a hash of doc_id, text and, among rows
that repeat these, a number of their own; so reruns agree, and no doc_id that many rows share, null included, fills a block.

Defined results: null text has size 0; a null source is a source of its own, after all others; documents of size 0 take no
words; an empty table gives an empty result; rows that repeat a doc_id are mixed as rows of their own; other columns play no
part. Sources are a configured set: one row for each is brought to the driver, and nothing per document is.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, cut, load

WEIGHTS = (5.0, 2.0, 1.0)
#: Words to take in all, as a share of all words, and at most from a source, as a multiple of its words.
SHARE = 1.5
MOST = 2.0
BLOCK = 4096
#: Undecided documents of a source that landing rounds together.
LANDING = 14
SEED = 20240611
EPS = 1e-9


def targets(sizes: list[int], weights: list[float], total: float, most: float = MOST) -> list[float]:
    """Share total by weight; what a source's cap cuts off is shared again among the others."""
    caps = [most * s for s in sizes]
    capped, out = [False] * len(sizes), [0.0] * len(sizes)
    while True:
        left = total - sum(c for c, full in zip(caps, capped) if full)
        scale = sum(w for w, full in zip(weights, capped) if not full)
        out = [c if full else (left * w / scale if scale else 0.0) for c, w, full in zip(caps, weights, capped)]
        over = [i for i, full in enumerate(capped) if not full and out[i] > caps[i]]
        if not over:
            return out
        for i in over:
            capped[i] = True


def flight(sizes: list[float], p: list[float], draw, keep: int = 2) -> list[float]:
    """Move probabilities along the null space of (count, size) until at most `keep`, 2 or more, are strictly between 0 and 1."""
    p = list(p)
    todo = [i for i in range(len(p) - 1, -1, -1) if EPS < p[i] < 1 - EPS]
    held: list[int] = []
    while True:
        while len(held) < 3 and todo:
            held.append(todo.pop())
        if len(held) < 3 or len(held) + len(todo) <= keep:
            return p
        i, j, k = held
        a, b, c = sizes[i], sizes[j], sizes[k]
        u = (c - b, a - c, b - a)
        if u == (0, 0, 0):
            u = (1.0, -1.0, 0.0)
        up = down = float("inf")
        for x, v in zip(held, u):
            q = p[x]
            if v > 0:
                up, down = min(up, (1 - q) / v), min(down, q / v)
            elif v < 0:
                up, down = min(up, q / -v), min(down, (1 - q) / -v)
        step = up if draw() * (up + down) < down else -down
        left = []
        for x, v in zip(held, u):
            q = p[x] + step * v
            if q <= EPS:
                q = 0.0
            elif q >= 1 - EPS:
                q = 1.0
            else:
                left.append(x)
            p[x] = q
        held = left


def landing(sizes: list[float], p: list[float]) -> list[float]:
    """Round the last open probabilities so that the words come nearest their total, then the count."""
    rest = [i for i, q in enumerate(p) if EPS < q < 1 - EPS]
    if not rest:
        return list(p)
    ends = (np.arange(1 << len(rest))[:, None] >> np.arange(len(rest))) & 1
    off = ends - np.array([p[i] for i in rest])
    words, count = np.abs(off @ np.array([float(sizes[i]) for i in rest])), np.abs(off.sum(1))
    best = ends[np.lexsort((count, np.round(words, 6)))[0]]
    out = list(p)
    for i, v in zip(rest, best):
        out[i] = float(v)
    return out


def _fly(level: int, land: bool, seed: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "doc_id", "size"], kind="stable")
        key = f"{seed}|{level}|{pdf.source.iloc[0]!r}|{pdf.block.iloc[0]}"
        rng = np.random.default_rng(zlib.crc32(key.encode()))
        draws = iter(rng.random(2 * len(pdf) + 8))
        sizes = pdf["size"].astype(float).tolist()
        p = flight(sizes, pdf.p.tolist(), draws.__next__, LANDING if land else 2)
        pdf["p"] = landing(sizes, p) if land else p
        return pdf

    return run


def mix_decisions(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken, copies, source."""
    spark = docs.sparkSession
    size = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), F.xxhash64("text").alias("t"))
    # rows alike in all of these are counted, and told apart by a number of their own, so that no hash is that of many rows
    rows = rows.groupBy("doc_id", "source", "size", "t").agg(F.count(F.lit(1)).alias("n"))
    rows = cut(rows.withColumn("again", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).drop("n"), "sizes")
    found = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")).collect()
    found.sort(key=lambda r: (r.source is None, r.source or ""))
    sizes = [r.source_size for r in found]
    want = targets(sizes, [weights[i % len(weights)] for i in range(len(found))], share * sum(sizes), most)
    table = [(r.source, r.source_size, t, float(t / r.source_size) if r.source_size else 0.0, -(-r.n // block)) for r, t in zip(found, want)]
    plan = spark.createDataFrame(table, "source string, source_size long, target double, rate double, blocks long")
    h = F.xxhash64(F.lit(seed), "doc_id", "t", "again")
    rows = rows.join(F.broadcast(plan).withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rows = rows.withColumn("base", F.floor(F.col("rate") + EPS)).withColumn("h", h)
    rows = rows.withColumn("p", F.greatest(F.lit(0.0), F.col("rate") - F.col("base"))).withColumn("block", F.pmod(F.shiftright("h", 7), F.col("blocks")))
    shape = "doc_id long, source string, size long, source_size long, target double, base long, h long, p double, block long"
    rows = rows.select(*(c.split()[0] for c in shape.split(", ")))
    done, level = [], 0
    while True:
        land = rows.select("source", "block").distinct().groupBy("source").count().filter("count > 1").limit(1).count() == 0
        flown = cut(rows.groupBy("source", "block").applyInPandas(_fly(level, land, seed), shape), f"level{level}")
        still = (F.col("p") > EPS) & (F.col("p") < 1 - EPS)
        done.append(flown.filter(~still))
        if land:
            break
        # at most two rows a block are left, so a block of the next level holds at most 1024 of them
        level, rows = level + 1, flown.filter(still).withColumn("block", F.expr("block div 512"))
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    copies = F.col("base") + F.round("p").cast("long")
    return out.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).cast("long").alias("taken"), copies.alias("copies"), "source")


def mix(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs that the mix takes, as often as it takes them, with all their columns."""
    key = ["__id", "__source", "__size"]
    taken = mix_decisions(docs, **how).select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__size"), "copies")
    # rows alike in all three are interchangeable: they are numbered on either side
    taken = cut(taken.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy("copies"))), "taken")
    size = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long")
    left = docs.withColumn("__id", F.col("doc_id").cast("long")).withColumn("__source", F.col("source").cast("string")).withColumn("__size", size)
    if taken.filter("__n > 1").limit(1).count():
        key = [*key, "__n"]
        left = left.withColumn("__n", F.row_number().over(Window.partitionBy("__id", "__source", "__size").orderBy("text")))
    right = cut(taken.filter("copies > 0").select(*(F.col(c).alias(f"{c}_r") for c in key), F.col("copies").alias("__copies")), "chosen")
    both = left.join(right.hint("merge"), [F.col(c).eqNullSafe(F.col(f"{c}_r")) for c in key])
    return both.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(*docs.columns)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_decisions(load(spark, sf_dir, "documents"))
