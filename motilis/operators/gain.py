"""Flow-gain curves: knee, collapse, floor and verdicts, for any number of curves at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K


def curve_from_rows(rows: DataFrame, ratio: float, by: list[str] | None = None) -> DataFrame:
    """Per curve: collapse_px (first displacement with a gain under 0.50), knee_px (last one of 0.90 before it), floor_gain (median of collapsed gains that still track something), least_px, most_px. rows: by, hand_displacement_px, gain."""
    by = by or []
    d, g = F.col("hand_displacement_px"), F.col("gain")
    first = rows.groupBy(*by).agg(F.min(F.when(g < K.COLLAPSE_GAIN, d)).alias("collapse_px"), F.min(d).alias("least_px"), F.max(d).alias("most_px"), F.median(F.when((g < K.COLLAPSE_GAIN) & (g >= K.FLOOR_RATIO * ratio), g)).alias("floor_gain"))
    both = rows.join(first.select(*by, "collapse_px"), by) if by else rows.crossJoin(first.select("collapse_px"))
    knee = both.groupBy(*by).agg(F.max(F.when((g >= K.KNEE_GAIN) & (F.col("collapse_px").isNull() | (d < F.col("collapse_px"))), d)).alias("knee_px"))
    out = first.join(knee, by) if by else first.crossJoin(knee)
    return out.withColumn("tracks_background", F.coalesce(F.abs(F.col("floor_gain") - ratio) <= K.TRACK_BAND * ratio, F.lit(False)))


def verdict(x: Column) -> Column:
    """PASS, FAIL or UNTESTED at a working displacement, over the columns of a curve."""
    return F.when((x < F.col("least_px")) | (x > F.col("most_px")), "UNTESTED").when(F.col("knee_px").isNull(), "FAIL").when(x <= F.col("knee_px"), "PASS").otherwise("FAIL")
