"""Duty cycle, agreement and the 0-10 activity score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import columns as C


def duty_cycle_estimate(samples: DataFrame, clips: DataFrame) -> DataFrame:
    """One row per clip: duty_cycle, counts, status."""
    rows = clips.select("clip_id", "duration_s").join(samples, "clip_id", "left")
    failed = F.col("decode_reason").isNotNull() if "decode_reason" in samples.columns else F.lit(False)
    rows = rows.groupBy("clip_id", "duration_s").agg(F.count("i").alias("n"), F.count("v").alias("n_frames_scored"), F.count_if("v").alias("n_frames_exerting"), F.count_if(F.col("i").isNotNull() & failed).alias("n_failed"))
    excluded = F.col("n") - F.col("n_frames_scored")
    status = F.when(F.col("duration_s") < K.MIN_CLIP_S, "too_short").when((F.col("n") > 0) & (F.col("n_failed") == F.col("n")), "decode_failed").when((F.col("n_frames_scored") == 0) | (F.try_divide(excluded, F.col("n")) > K.UNREADABLE_CEILING), "no_labels").otherwise("ok")
    return rows.select("clip_id", F.when(status == "ok", F.try_divide("n_frames_exerting", "n_frames_scored")).alias("duty_cycle"), "n_frames_scored", "n_frames_exerting", excluded.alias("n_frames_excluded"), status.alias("status"))


def paired_duty_cycles(left: DataFrame, right: DataFrame) -> DataFrame:
    a = left.filter("status = 'ok'").select("clip_id", F.col("duty_cycle").alias("a"))
    b = right.filter("status = 'ok'").select("clip_id", F.col("duty_cycle").alias("b"))
    return a.join(b, "clip_id")


def agreement(pairs: DataFrame, most: float = K.H1A_MAX) -> DataFrame:
    """Pairs, mean and largest difference, and whether the mean holds; null over none."""
    d = F.abs(F.col("a") - F.col("b"))
    return pairs.agg(F.count(F.lit(1)).alias("n_clips"), F.avg(d).alias("mean_abs"), F.max(d).alias("max_abs"), (F.avg(d) <= most).alias("holds"))


def _score(duty, x, usable, raw, inside):
    status = F.when((F.col("duty_status") != "ok") | x.isNull() | ~usable, "no_input").when(duty == 0, "zero_duty_cycle").otherwise("ok")
    return status, F.when(status == "ok", C.clamp_hal(raw)), F.when(status == "ok", ~inside)


def score_speed_path(duty: DataFrame, speed: DataFrame) -> DataFrame:
    """Activity score from speed; clips without a speed record are skipped."""
    rows = duty.select("clip_id", "duty_cycle", F.col("status").alias("duty_status")).join(speed.select("clip_id", "rms_speed_mm_s", F.col("status").alias("x_status")), "clip_id")
    pct = F.col("duty_cycle") * 100
    status, hal, out = _score(F.col("duty_cycle"), F.col("rms_speed_mm_s"), F.col("x_status") == "ok", C.hal_akkas(F.col("rms_speed_mm_s"), pct), C.akkas_in_range(F.col("rms_speed_mm_s"), pct))
    return rows.select("clip_id", hal.alias("hal"), F.lit("akkas_2015").alias("mapping"), "duty_cycle", "rms_speed_mm_s", out.alias("out_of_range"), F.lit(False).alias("tlv_evaluable"), status.alias("status"))


def score_spectral_path(duty: DataFrame, frequency: DataFrame) -> DataFrame:
    """Activity score from frequency."""
    rows = duty.select("clip_id", "duty_cycle", F.col("status").alias("duty_status")).join(frequency.select("clip_id", "hz", F.col("status").alias("x_status")), "clip_id")
    status, hal, out = _score(F.col("duty_cycle"), F.col("hz"), F.col("x_status") == "ok", C.hal_radwin(F.col("hz"), F.col("duty_cycle") * 100), C.radwin_in_range(F.col("hz")))
    return rows.select("clip_id", hal.alias("hal"), F.lit("radwin_2015").alias("mapping"), "duty_cycle", "hz", out.alias("out_of_range"), F.lit(False).alias("tlv_evaluable"), status.alias("status"))
