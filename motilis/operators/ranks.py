"""Ranks and exact quantiles of whole tables, without a task that holds them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stores import scratch_folder


def written(df: DataFrame) -> DataFrame:
    """df, written in the shared folder and read back."""
    path = scratch_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, *order: str | Column, name: str = "rank") -> DataFrame:
    """df with each row's place, from 0, in the order of all rows: one range shuffle, rows numbered within their partition and moved on
    by the sizes of the partitions before it. A row for each partition is all that reaches the driver."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = written(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()))
    part, place = F.shiftright("__id", 33), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted(tuple(r) for r in rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    starts, total = [], 0
    for p, size in sizes:
        starts.append((p, total))
        total += size
    before = spark.createDataFrame(starts, "__part long, __before long")
    rows = rows.withColumn("__part", part).join(F.broadcast(before), "__part")
    return rows.withColumn(name, F.col("__before") + place).drop("__id", "__part", "__before")


#: Bins of a round, and distinct values of a bin that one task orders.
BINS, MOST = 4096, 1 << 16


def _bin(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """The bin of x in [lo, hi], lo < hi, ascending with x; lo and hi are never in one.

    A range around or at zero falls into what is below, at and above it; one of a single sign is cut into equal ratios, which takes a
    handful of rounds at most, whatever the values; where logarithms no longer tell its ends apart, into equal widths."""
    a, b, v = (F.ln(F.abs(c)) for c in (lo, hi, x))
    ratio = (v - a) / (b - a)  # of two negative ends the first is the larger, and the ratio rises with x all the same
    width = (x - lo) / (hi - lo)
    share = F.when((a != b), ratio).otherwise(width)
    return F.when((lo <= 0) & (hi >= 0), F.signum(x).cast("long") + 1).otherwise(F.least(F.floor(share * bins), F.lit(bins - 1)))


def exact_quantiles(rows: DataFrame, value: str, shares: list[float], by: list[str] | None = None, bins: int = BINS, most: int = MOST) -> DataFrame:
    """by, and q0, q1, ... of the values that are finite: linear between the two order statistics around (n - 1) * share.

    Equal values are counted, then the place of each order statistic is narrowed down in rounds: the range it lies in is cut into
    `bins` bins of equal ratio, whose counts are summed before the shuffle, and the bin it falls into is the next range, until no range holds more
    than `most` distinct values; these are ordered. So no task ever holds more than that, however large a group is. A group
    without a finite value has no row, or nulls where there are no groups at all."""
    by = by or []
    x = F.col(value).cast("double")
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    counted = written(rows.filter(finite).groupBy(*by, x.alias("x")).agg(F.count(F.lit(1)).alias("c")))
    # groups are compared null-safely, under names of their own
    keys = [f"__g{i}" for i in range(len(by))]
    counted = counted.select(*(F.col(c).alias(k) for c, k in zip(by, keys)), "x", "c")
    groups = counted.groupBy(*keys).agg(F.sum("c").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("d"))
    asked = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(float(s)).alias("share")) for i, s in enumerate(shares)))).alias("a")
    at = groups.filter("n > 0").select(*keys, "n", "lo", "hi", "d", asked).select("*", ((F.col("n") - 1) * F.col("a.share")).alias("pos"))
    at = at.select(*keys, F.col("a.i").alias("i"), "n", "lo", "hi", "d", F.floor("pos").alias("below"), (F.col("pos") - F.floor("pos")).alias("part"))
    asked = written(at)
    # an order statistic that several shares ask for is looked up once
    places = asked.select(*keys, "lo", "hi", "d", "n", F.explode(F.array("below", F.least(F.col("below") + 1, F.col("n") - 1))).alias("k")).drop("n").distinct().withColumn("before", F.lit(0).cast("long"))

    def meeting(ranges: DataFrame) -> DataFrame:
        """Counted values within each range that is looked for."""
        r = ranges.select(*(F.col(k).alias(f"{k}_r") for k in keys), "k", "lo", "hi", "before")
        same = [F.col(k).eqNullSafe(F.col(f"{k}_r")) for k in keys] or [F.lit(True)]
        # without groups the other side is at most two rows a share
        r = r if keys else F.broadcast(r)
        met = same[0]
        for s in same[1:]:
            met = met & s
        return counted.join(r, met & F.col("x").between(F.col("lo"), F.col("hi"))).drop(*(f"{k}_r" for k in keys))

    found = []
    while True:
        places = written(places)
        large = places.filter(F.col("d") > most)
        found.append(places.filter(F.col("d") <= most).drop("d"))
        if not large.limit(1).count():
            break
        sums = meeting(large).groupBy(*keys, "k", "before", _bin(F.col("x"), F.col("lo"), F.col("hi"), bins).alias("bin")).agg(F.sum("c").alias("m"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("d"))
        w = Window.partitionBy(*keys, "k").orderBy("bin")  # at most `bins` rows
        sums = sums.withColumn("upto", F.col("before") + F.sum("m").over(w))
        places = sums.filter((F.col("k") >= F.col("upto") - F.col("m")) & (F.col("k") < F.col("upto"))).select(*keys, "lo", "hi", "d", "k", (F.col("upto") - F.col("m")).alias("before"))
    last = found[0]
    for f in found[1:]:
        last = last.unionByName(f)
    w = Window.partitionBy(*keys, "k").orderBy("x")  # at most `most` rows
    values = meeting(last).withColumn("upto", F.col("before") + F.sum("c").over(w))
    values = written(values.filter((F.col("k") >= F.col("upto") - F.col("c")) & (F.col("k") < F.col("upto"))).select(*keys, "k", "x"))

    def with_value(df: DataFrame, k: Column, name: str) -> DataFrame:
        v = values.select(*(F.col(c).alias(f"{c}_v") for c in keys), F.col("k").alias("k_v"), F.col("x").alias(name))
        met = F.col("k_v") == k
        for c in keys:
            met = met & F.col(c).eqNullSafe(F.col(f"{c}_v"))
        return df.join(v, met).drop("k_v", *(f"{c}_v" for c in keys))

    both = with_value(with_value(asked, F.col("below"), "x0"), F.least(F.col("below") + 1, F.col("n") - 1), "x1")
    both = both.withColumn("q", F.when(F.col("part") == 0, F.col("x0")).otherwise(F.col("x0") + (F.col("x1") - F.col("x0")) * F.col("part")))
    out = both.groupBy(*keys).agg(*(F.max(F.when(F.col("i") == i, F.col("q"))).alias(f"q{i}") for i in range(len(shares))))
    return out.select(*(F.col(k).alias(c) for c, k in zip(by, keys)), *(f"q{i}" for i in range(len(shares))))
