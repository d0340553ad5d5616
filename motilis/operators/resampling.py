"""Bootstrap replicates dealt out over tasks.

Clusters are drawn from one seeded stream, replicate after replicate, as a single task would draw them. The stream is cut into chunks
of replicates whose generator states are handed to tasks, and clusters into parts in their lexicographic order; a task takes the
draws of its chunk that fall into its part. The numbers are those of one task, whatever the number of tasks.

Clips are drawn as independent: values are counted, dealt out into parts, and each replicate first draws how many of its draws
fall to each part (multinomial), then the part's draws: counts of its values where each is drawn many times on average, single draws
where values hardly repeat. Each replicate has a stream of its own, so nothing depends on how replicates are dealt out; the work
follows the number of distinct values once clips repeat them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranks import numbered, written

#: Clusters, and distinct values, that a task holds; chunks of replicates for each part.
PART, VALUES, CHUNKS = 1 << 20, 1 << 16, 24
#: Draws for each distinct value from which on they are drawn as counts.
REPEATED = 16
#: Draws made at a time; they stay in the processor's cache.
_STEP = 1 << 14
#: Numbers of the stream that a task looks through for the ones that are not used.
SEGMENT = 1 << 26


def chunks_of(b: int, chunks: int = CHUNKS) -> list[tuple[int, int]]:
    """First and last (exclusive) replicate of each chunk."""
    ends = [b * i // chunks for i in range(chunks + 1)]
    return [(x, y) for x, y in zip(ends, ends[1:]) if y > x]


def _pick(rng: np.random.Generator, n: int, k: int):
    """k draws below n, some at a time, each with its place; a step's size does not change the stream."""
    for a in range(0, k, _STEP):
        yield a, rng.integers(0, n, min(_STEP, k - a))


def stream_states(n: int, b: int, seed: int, chunks: int = CHUNKS) -> list[dict]:
    """The generator's state in front of each chunk. The stream is run through once; nothing of it is kept."""
    rng, states = np.random.default_rng(seed), []
    cuts = chunks_of(b, chunks)
    for i, (x, y) in enumerate(cuts):
        states.append(rng.bit_generator.state)
        if i + 1 < len(cuts):
            for _ in _pick(rng, n, (y - x) * n):
                pass
    return states


def _used(n: int, seed: int, first: int, count: int):
    """Of `count` numbers of 32 bits from place `first` (even) of the stream, some at a time: the place, and whether each becomes a draw below n."""
    bits = np.random.PCG64(seed).advance(first // 2)
    reject = np.uint32((1 << 32) % n)
    for a in range(first, first + count, 2 * _STEP):
        x = bits.random_raw(min(_STEP, (first + count - a + 1) // 2)).astype("<u8").view("<u4")
        yield a, x * np.uint32(n) >= reject


def states_over_tasks(spark: SparkSession, n: int, b: int, seed: int, chunks: int = CHUNKS, segment: int | None = None) -> list[dict]:
    """stream_states(), found by tasks: a draw takes one number of 32 bits unless its product with n falls into the remainder, so the numbers
    used up to a chunk are counted in segments of the stream, and only the segment in which a chunk begins is looked at again."""
    segment = segment or SEGMENT
    starts = [x * n for x, _ in chunks_of(b, chunks)]
    if n >= 1 << 32 or starts[-1] < segment:
        return stream_states(n, b, seed, chunks)
    length = int(starts[-1] / (1 - (1 << 32) % n / (1 << 32)) + 12 * starts[-1] ** 0.5) + segment
    parts = -(-length // segment)

    def count(batches):
        for pdf in batches:
            yield pd.DataFrame({"id": pdf.id, "used": [sum(int(np.count_nonzero(u)) for _, u in _used(n, seed, int(i) * segment, segment)) for i in pdf.id]})

    # a row for each segment
    used = sorted(tuple(r) for r in spark.range(0, parts, 1, parts).mapInPandas(count, "id long, used long").collect())
    before = np.concatenate([[0], np.cumsum([u for _, u in used])])
    states = []
    for want in starts:
        at = int(np.searchsorted(before, want, "right")) - 1
        seen, place = int(before[at]), at * segment
        for a, u in _used(n, seed, place, segment) if seen < want else ():
            if seen + (k := int(np.count_nonzero(u))) >= want:
                place = a + int(np.flatnonzero(u)[want - seen - 1]) + 1
                break
            seen += k
        bits = np.random.PCG64(seed).advance(place // 2)
        if place % 2:  # the second half of a number of 64 bits waits
            np.random.Generator(bits).integers(0, 1 << 32, dtype=np.uint32)
        states.append(bits.state)
    return states


def _dealt(rows: DataFrame, groups: int) -> DataFrame:
    """rows by part and chunk, hardly two of these groups in one task; a few groups with little data would be put together otherwise."""
    return rows.repartition(min(8 * groups, max(groups, 2000)), "part", "chunk").groupBy("part", "chunk")


def cluster_replicates(sums: DataFrame, b: int, seed: int, part: int | None = None, chunks: int = CHUNKS) -> DataFrame:
    """replicate, mean of b resamples of clusters with replacement. sums: cluster, s, n. A single cluster is an error."""
    part = part or PART
    rows = numbered(sums.select("cluster", F.col("s").cast("double").alias("s"), F.col("n").cast("double").alias("n")), "cluster")
    rows = written(rows.select("rank", "s", "n"))  # names have served: a task holds numbers
    n = rows.count()
    if n < 2:
        raise ValueError("a cluster bootstrap needs two clusters")
    states, cuts = states_over_tasks(sums.sparkSession, n, b, seed, chunks), chunks_of(b, chunks)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        low, own = int(key[0]) * part, len(pdf)
        # sum and count in one cell are one access to memory; what lies before and after this part counts nothing here
        cells = np.zeros(own + 2, complex)
        cells[pdf["rank"].to_numpy() - (low - 1)] = pdf.s.to_numpy() + 1j * pdf.n.to_numpy()
        del pdf
        rng = np.random.default_rng()
        rng.bit_generator.state = states[int(key[1])]
        first, last = cuts[int(key[1])]
        out = np.zeros(last - first, complex)
        # all draws of a replicate are summed at once, as a single task would, where one part holds all clusters
        drawn = np.empty(n if own == n else 0, complex)
        for r in range(last - first):
            for a, at in _pick(rng, n, n):
                at -= low - 1
                if own == n:
                    np.take(cells, at, out=drawn[a : a + len(at)], mode="clip")
                else:
                    out[r] += np.take(cells, at, mode="clip").sum()
            if own == n:
                out[r] = complex(drawn.real.sum(), drawn.imag.sum())
        return pd.DataFrame({"replicate": np.arange(first, last), "s": out.real, "c": out.imag})

    dealt = rows.withColumn("part", F.floor(F.col("rank") / part).cast("long")).withColumn("chunk", F.explode(F.array(*(F.lit(i) for i in range(len(cuts))))))
    drawn = _dealt(dealt, -(-n // part) * len(cuts)).applyInPandas(run, "replicate long, s double, c double")
    return drawn.groupBy("replicate").agg((F.sum("s") / F.sum("c")).alias("mean"))


def drawer(x: np.ndarray, counts: np.ndarray):
    """A function of k and a generator: the sum of k values drawn with replacement from x, each of which stands counts times."""
    n = int(counts.sum())
    shares, ends = counts / n, np.cumsum(counts)
    each = x if n == len(x) else np.repeat(x, counts) if n <= 4 * REPEATED * len(x) else None

    def draw(k: int, rng: np.random.Generator) -> float:
        if k > REPEATED * len(x):
            return float(rng.multinomial(k, shares) @ x)
        if each is None:
            return float(sum(x[np.searchsorted(ends, at, "right")].sum() for _, at in _pick(rng, n, k)))
        return float(sum(each.take(at).sum() for _, at in _pick(rng, n, k)))

    return draw


def value_replicates(observations: DataFrame, value: str, b: int, seed: int, most: int = VALUES, chunks: int = CHUNKS) -> DataFrame:
    """replicate, mean of b resamples of all rows as if independent, with replacement. Null values are left out; no value at all is an error."""
    counted = observations.select(F.col(value).cast("double").alias("x")).filter("x is not null").groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    counted = written(counted)
    parts = max(1, -(-counted.count() // most))
    counted = counted.withColumn("part", F.pmod(F.xxhash64("x"), F.lit(parts)))
    # a row for each part
    sizes = {r.part: r.n for r in counted.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    if not sizes:
        raise ValueError("a bootstrap needs a value")
    order, total = sorted(sizes), sum(sizes.values())
    shares = np.array([sizes[p] for p in order]) / total
    cuts = chunks_of(b, max(1, min(chunks, -(-4 * chunks // parts))))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("x")
        x, counts, own = pdf.x.to_numpy(float), pdf.n.to_numpy(np.int64), int(key[0])
        first, last = cuts[int(key[1])]
        out, draw = np.empty(last - first), drawer(x, counts)
        for r in range(first, last):
            k = total if len(order) == 1 else int(np.random.default_rng([seed, r]).multinomial(total, shares)[order.index(own)])
            out[r - first] = draw(k, np.random.default_rng([seed, r, own + 1]))
        return pd.DataFrame({"replicate": np.arange(first, last), "s": out})

    dealt = counted.withColumn("chunk", F.explode(F.array(*(F.lit(i) for i in range(len(cuts))))))
    drawn = _dealt(dealt, parts * len(cuts)).applyInPandas(run, "replicate long, s double")
    return drawn.groupBy("replicate").agg((F.sum("s") / total).alias("mean"))
