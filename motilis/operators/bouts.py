"""Runs of labels, debouncing and bouts. A clip's rows are dealt out once; runs replace instants as early as they can.

Debouncing absorbs short runs into longer neighbours until nothing changes. Labels between two unreadable instants alternate,
so the outcome has a closed form: of the runs of such an island in order, one is an anchor if it is long enough itself, or if
it is the one that carries the running length past the minimum; a run takes the value of the last anchor up to it, or of the
island's first anchor, or, where there is none, of the island's last run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K


def runs(samples: DataFrame) -> DataFrame:
    """Maximal runs of equal labels, unreadable included: clip_id, start, stop (exclusive), v."""
    w = Window.partitionBy("clip_id").orderBy("i")
    new = F.when(F.lag("i").over(w).isNull() | ~F.col("v").eqNullSafe(F.lag("v").over(w)), 1).otherwise(0)
    rows = samples.select("clip_id", "i", "v").withColumn("new", new).withColumn("run", F.sum("new").over(w))
    return rows.groupBy("clip_id", "run").agg(F.min("i").alias("start"), (F.max("i") + 1).alias("stop"), F.first("v").alias("v")).drop("run")


def joined_runs(runs_: DataFrame) -> DataFrame:
    """Neighbouring runs of equal labels made one."""
    w = Window.partitionBy("clip_id").orderBy("start")
    new = F.when(F.lag("start").over(w).isNull() | ~F.col("v").eqNullSafe(F.lag("v").over(w)), 1).otherwise(0)
    return runs_.withColumn("new", new).withColumn("run", F.sum("new").over(w)).groupBy("clip_id", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.first("v").alias("v")).drop("run")


def debounce(runs_: DataFrame, fps: float = K.ANALYSIS_HZ, min_s: float = K.DEBOUNCE_S) -> DataFrame:
    """Runs after debouncing, as runs() of the settled labels."""
    w = Window.partitionBy("clip_id").orderBy("start")
    rows = runs_.withColumn("island", F.sum(F.when(F.col("v").isNull(), 1).otherwise(0)).over(w)).withColumn("blank", F.col("v").isNull())
    own = Window.partitionBy("clip_id", "island", "blank").orderBy("start")
    whole = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("len", F.col("stop") - F.col("start")).withColumn("cum", F.sum("len").over(own))
    anchor = (F.col("len") / fps >= min_s) | (((F.col("cum") - F.col("len")) / fps < min_s) & (F.col("cum") / fps >= min_s))
    rows = rows.withColumn("held", F.when(anchor, F.col("v")))
    settled = F.coalesce(F.last("held", True).over(own), F.first("held", True).over(whole), F.last("v").over(whole))
    return joined_runs(rows.withColumn("settled", settled).select("clip_id", "start", "stop", F.when(~F.col("blank"), F.col("settled")).alias("v")))


def exertion_segments(settled: DataFrame, fps: float = K.ANALYSIS_HZ, min_s: float = K.DEBOUNCE_S) -> DataFrame:
    """True runs that last long enough: clip_id, start_s, end_s, null_bounded (next to an unreadable instant)."""
    w = Window.partitionBy("clip_id").orderBy("start")
    before = F.lag("start").over(w).isNotNull() & F.lag("v").over(w).isNull()
    after = F.lead("start").over(w).isNotNull() & F.lead("v").over(w).isNull()
    rows = settled.withColumn("null_bounded", before | after).filter(F.col("v") & ((F.col("stop") - F.col("start")) / fps >= min_s))
    return rows.select("clip_id", (F.col("start") / fps).alias("start_s"), (F.col("stop") / fps).alias("end_s"), "null_bounded")


def scored_seconds(samples: DataFrame, fps: float = K.ANALYSIS_HZ) -> DataFrame:
    return samples.groupBy("clip_id").agg((F.count("v") / fps).alias("scored_s"))


def transition_frequency(samples: DataFrame, fps: float = K.ANALYSIS_HZ, min_s: float = K.DEBOUNCE_S) -> DataFrame:
    """Bouts a scored second: clip_id, n_segments, n_null_bounded, scored_s, hz, status."""
    first = runs(samples)
    scored = first.groupBy("clip_id").agg((F.sum(F.when(F.col("v").isNotNull(), F.col("stop") - F.col("start")).otherwise(0)) / fps).alias("scored_s"))
    seg = exertion_segments(debounce(first, fps, min_s), fps, min_s).groupBy("clip_id").agg(F.count(F.lit(1)).alias("n_segments"), F.count_if("null_bounded").alias("n_null_bounded"))
    rows = scored.join(seg, "clip_id", "left").na.fill(0, ["n_segments", "n_null_bounded"])
    hz = F.when((F.col("n_segments") > 0) & (F.col("scored_s") > 0), F.try_divide("n_segments", "scored_s"))
    status = F.when(hz.isNull(), "no_peak").when(hz >= fps / 2, "aliased").otherwise("ok")
    return rows.select("clip_id", "n_segments", "n_null_bounded", "scored_s", F.when(status == "ok", hz).alias("hz"), status.alias("status"))
