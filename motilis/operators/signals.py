"""Planned instants met by labels and detections; conflicts; the per-clip signal record. What is missing stays null with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import columns as C

NO_LABEL = "instant has no label row"
NO_DETECTION = "instant has no detection row"
NO_HANDS_READ = "labeller could not read the frame"
HANDS_ZERO = "labeller saw no hand"


def last_written(rows: DataFrame, order: str = "seq") -> DataFrame:
    """Of rows of one clip and time key the last written counts."""
    rows = rows.withColumn("key", C.time_key(F.col("t_s")))
    names = [c for c in rows.columns if c not in ("clip_id", "key")]
    return rows.groupBy("clip_id", "key").agg(F.max(F.struct(order, *[c for c in names if c != order])).alias("r")).select("clip_id", "key", *(F.col(f"r.{c}").alias(c) for c in names))


def join_labels(plan: DataFrame, labels: DataFrame) -> DataFrame:
    """Left join on quantised time: manipulation and hands stay null, with a reason, where no row was written."""
    found = last_written(labels).select("clip_id", "key", "manipulation", "hands_visible", "unreadable_reason", F.lit(True).alias("written"))
    rows = plan.withColumn("key", C.time_key(F.col("t_s"))).join(found, ["clip_id", "key"], "left")
    return rows.withColumn("unreadable_reason", F.when(F.col("written").isNull(), NO_LABEL).otherwise(F.col("unreadable_reason"))).drop("key", "written")


def join_detections(plan: DataFrame, detections: DataFrame) -> DataFrame:
    """Left join on quantised time: no boxes, with a reason, where no row was written."""
    found = last_written(detections).select("clip_id", "key", "boxes", "failed_reason", F.lit(True).alias("written"))
    rows = plan.withColumn("key", C.time_key(F.col("t_s"))).join(found, ["clip_id", "key"], "left")
    return rows.withColumn("failed_reason", F.when(F.col("written").isNull(), NO_DETECTION).otherwise(F.col("failed_reason"))).drop("key", "written")


def contradiction(width: Column, hands: Column) -> Column:
    """Why a box is not usable, or null."""
    return F.when(width.isNotNull() & hands.isNull(), NO_HANDS_READ).when(width.isNotNull() & (hands == 0), HANDS_ZERO)


def resolve_conflicts(samples: DataFrame) -> DataFrame:
    """Contradicted widths become null; the reason is kept beside them."""
    why = contradiction(F.col("width"), F.col("hands"))
    return samples.withColumn("conflict", why).withColumn("width", F.when(why.isNull(), F.col("width")))


def conflict_counts(samples: DataFrame) -> DataFrame:
    """Per clip: unread (hands not read), no_hand, total of contradicted boxes among n instants."""
    why = contradiction(F.col("width"), F.col("hands"))
    return samples.groupBy("clip_id").agg(F.count_if(why == NO_HANDS_READ).alias("unread"), F.count_if(why == HANDS_ZERO).alias("no_hand"), F.count_if(why.isNotNull()).alias("total"), F.count(F.lit(1)).alias("n"))


def head_conflicts(labels: DataFrame) -> DataFrame:
    """Rows where the two label heads contradict each other become unreadable, with a reason."""
    clash = F.coalesce(F.col("manipulation") & (F.col("hands_visible") == 0), F.lit(False))
    return (
        labels.withColumn("clash", clash)
        .withColumn("manipulation", F.when(~clash, F.col("manipulation")))
        .withColumn("hands_visible", F.when(~clash, F.col("hands_visible")))
        .withColumn("unreadable_reason", F.when(clash, "heads contradict").otherwise(F.col("unreadable_reason")))
    )


def tail_rows(plan: DataFrame, decoded: DataFrame) -> DataFrame:
    """Planned instants a decoder never delivered, as unreadable rows."""
    return plan.join(decoded.select("clip_id", "i"), ["clip_id", "i"], "left_anti").select("clip_id", "i", "t_s", F.lit(None).cast("boolean").alias("manipulation"), F.lit(None).cast("int").alias("hands_visible"), F.lit("frame was not decoded").alias("unreadable_reason"))


def frame_signal(samples: DataFrame, clips: DataFrame, arrays: bool = True) -> DataFrame:
    """One row per clip: n_frames, n_unreadable, status, and the aligned series. A width on an instant without a hand is an error: resolve conflicts first."""
    rows = clips.select("clip_id", "duration_s").join(samples, "clip_id", "left")
    failed = F.col("decode_reason").isNotNull() if "decode_reason" in samples.columns else F.lit(False)
    aggs = [F.count("i").alias("n_frames"), F.count_if(F.col("i").isNotNull() & F.col("v").isNull()).alias("n_unreadable"), F.count_if(F.col("i").isNotNull() & failed).alias("n_failed"), F.count_if(contradiction(F.col("width"), F.col("hands")).isNotNull()).alias("n_conflicts")]
    if arrays:
        aggs.append(F.array_sort(F.collect_list(F.when(F.col("i").isNotNull(), F.struct("i", "v", "hands", "width")))).alias("s"))
    out = rows.groupBy("clip_id", "duration_s").agg(*aggs)
    bad = F.raise_error(F.format_string("unresolved conflicts in %s", F.col("clip_id"))).cast("string")
    status = F.when(F.col("n_conflicts") > 0, bad).when(F.col("duration_s") < K.MIN_CLIP_S, "too_short").when((F.col("n_frames") > 0) & (F.col("n_failed") == F.col("n_frames")), "decode_failed")
    status = status.when((F.col("n_frames") == 0) | (F.try_divide(F.col("n_unreadable"), F.col("n_frames")) > K.UNREADABLE_CEILING), "no_labels").otherwise("ok")
    out = out.withColumn("status", status)
    if arrays:
        out = out.withColumns({"manipulation": F.transform("s", lambda x: x.v), "hands_visible": F.transform("s", lambda x: x.hands), "hand_box_width_px": F.transform("s", lambda x: x.width)}).drop("s")
    return out.drop("n_failed", "n_conflicts", "duration_s")


def not_attempted(clips: DataFrame, hz: float = K.ANALYSIS_HZ) -> DataFrame:
    """Placeholder signals of a stage that never ran: every instant null."""
    n = C.n_samples(F.col("duration_s"), F.lit(hz))
    return clips.select("clip_id", n.alias("n_frames"), F.array_repeat(F.lit(None).cast("boolean"), n).alias("manipulation"), n.alias("n_unreadable"), F.lit("not_attempted").alias("status"))
