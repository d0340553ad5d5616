"""Sample plans: instants, frame pairs, native frames, rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import columns as C


def sample_times(clips: DataFrame, hz: float = K.ANALYSIS_HZ) -> DataFrame:
    """One row per planned instant of each clip: the clip's columns, i, t_s."""
    n = C.n_samples(F.col("duration_s"), F.lit(hz))
    rows = clips.withColumn("n_planned", n).filter("n_planned > 0")
    return rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n_planned") - 1))).withColumn("t_s", F.col("i") * (1.0 / hz)).drop("n_planned")


def plan_pairs(clips: DataFrame, hz: float = K.ANALYSIS_HZ) -> DataFrame:
    """Frame pairs a clip's own frame period apart; clips that are too short plan none."""
    return sample_times(clips.filter(F.col("duration_s") >= K.MIN_CLIP_S), hz).withColumn("t2_s", F.col("t_s") + 1 / F.col("fps"))


def is_too_short(duration: Column) -> Column:
    return duration < K.MIN_CLIP_S


def pilot_factory(clips: DataFrame) -> DataFrame:
    return clips.agg(F.min("factory_id").alias("pilot_factory"))


def native_frames(instants: DataFrame) -> DataFrame:
    """For each native frame index the first instant that asks for it, and whether the frame before was asked for too.

    Hardly two instants share an index, so they are not grouped: in order, the first of an index differs from the one before it."""
    rows = instants.select("clip_id", C.native_index(F.col("t_s"), F.col("fps")).alias("idx"), "i")
    w = Window.partitionBy("clip_id").orderBy("idx", F.col("i").asc_nulls_last())
    rows = rows.withColumn("nth", F.row_number().over(w)).withColumn("before", F.lag("idx").over(w))
    first = rows.filter((F.col("nth") == 1) | ~F.col("before").eqNullSafe(F.col("idx")))
    return first.select("clip_id", "idx", "i", F.coalesce(F.col("before") == F.col("idx") - 1, F.lit(False)).alias("after_previous"))


def rate_of(instants: DataFrame) -> DataFrame:
    """The sampling rate of the first clip, from the commonest gap between its distinct instants; null if there is none. The earliest of equally common gaps counts."""
    first = instants.agg(F.min("clip_id").alias("first_clip"))
    own = instants.join(F.broadcast(first), F.col("clip_id") == F.col("first_clip")).select("t_s").distinct()
    gaps = own.withColumn("gap", F.col("t_s") - F.lag("t_s").over(Window.partitionBy(F.lit(0)).orderBy("t_s"))).filter("gap > 0")
    by = gaps.groupBy(F.round("gap", 6).alias("g")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("t_s", "gap")).alias("one"))
    return by.agg((1 / F.max(F.struct("n", (-F.col("one.t_s")).alias("early"), F.col("one.gap").alias("gap"))).getField("gap")).alias("hz"))


def decode_outcome(planned: Column, frames: Column) -> Column:
    """Pairs decoded and pairs that failed."""
    pairs = F.greatest(frames - 1, F.lit(0))
    return F.struct(pairs.alias("pairs_decoded"), F.greatest(planned - pairs, F.lit(0)).alias("failures"))
