"""Corpus reconciliation, completeness and decision gates. An empty denominator is never a pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K


def reconcile(clips: DataFrame, published: DataFrame) -> DataFrame:
    """Observed totals against published ones (claim, value, tolerance, relative): one row per claim; a null value is skipped. Observed: clips, workers, factories, duration_s."""
    totals = clips.groupBy("factory_id", "worker_id").agg(F.count(F.lit(1)).alias("c"), F.sum("duration_s").alias("d"))
    totals = totals.groupBy("factory_id").agg(F.count(F.lit(1)).alias("w"), F.sum("c").alias("c"), F.sum("d").alias("d"))
    totals = totals.agg(F.sum("c").cast("double").alias("clips"), F.sum("w").cast("double").alias("workers"), F.count(F.lit(1)).cast("double").alias("factories"), F.sum("d").alias("duration_s"))
    seen = totals.unpivot([], ["clips", "workers", "factories", "duration_s"], "claim", "observed")
    off = F.abs(F.col("observed") - F.col("value"))
    limit = F.when(F.col("relative"), F.col("tolerance") * F.abs(F.col("value"))).otherwise(F.col("tolerance"))
    rows = published.filter(F.col("value").isNotNull()).join(seen, "claim")
    return rows.select("claim", "value", "observed", (off <= limit).alias("ok"), F.when(off > limit, F.concat_ws(" ", "claim", F.lit("differs"))).alias("mismatch"))


def manifest_gates(clips: DataFrame) -> DataFrame:
    """Booleans over a manifest: not_empty, is_unique, positive, several_factories, long_enough (some clip)."""
    keys = clips.groupBy("factory_id", "worker_id", "clip_index").agg(F.count(F.lit(1)).alias("n"), F.min(F.least("duration_s", "fps")).alias("low"), F.max("duration_s").alias("long"))
    return keys.agg(
        (F.count(F.lit(1)) > 0).alias("not_empty"),
        F.coalesce(F.max("n") == 1, F.lit(False)).alias("is_unique"),
        F.coalesce(F.min("low") > 0, F.lit(False)).alias("positive"),
        F.coalesce(F.min("factory_id") < F.max("factory_id"), F.lit(False)).alias("several_factories"),
        F.coalesce(F.max("long") >= K.MIN_CLIP_S, F.lit(False)).alias("long_enough"),
    )


def decode_gate(probes: DataFrame) -> DataFrame:
    """Open failures and truncation over probes (planned, frames, ok, reason): rates, reasons, status."""
    failed = F.greatest(F.col("planned") - F.greatest(F.col("frames") - 1, F.lit(0)), F.lit(0))
    rows = probes.agg(F.count(F.lit(1)).alias("clips"), F.sum("planned").alias("planned"), F.count_if(~F.col("ok")).alias("unopened"), F.sum(F.when(F.col("ok"), failed)).alias("truncated"), F.array_join(F.array_sort(F.collect_set(F.when(~F.col("ok"), F.col("reason")))), "; ").alias("reasons"))
    opened, cut = F.try_divide("unopened", "clips"), F.try_divide("truncated", "planned")
    status = F.when(opened.isNull() | cut.isNull(), "NOT EVALUABLE").when((opened < K.DECODE_FAILURE_CEILING) & (cut < K.DECODE_FAILURE_CEILING), "HOLDS").otherwise("FAILED")
    return rows.select("clips", "planned", "unopened", "truncated", opened.alias("open_rate"), cut.alias("truncation_rate"), "reasons", status.alias("status"))


def shortfall_gate(plan: DataFrame, written: DataFrame) -> DataFrame:
    """Planned instants without a row, against one in a hundred."""
    a = plan.groupBy("clip_id").agg(F.count(F.lit(1)).alias("p"))
    b = written.groupBy("clip_id").agg(F.count(F.lit(1)).alias("w"))
    rows = a.join(b, "clip_id", "left").agg(F.coalesce(F.sum("p"), F.lit(0)).alias("planned"), F.coalesce(F.sum(F.greatest(F.col("p") - F.coalesce("w", F.lit(0)), F.lit(0))), F.lit(0)).alias("missing"))
    rate = F.try_divide("missing", "planned")
    return rows.select("planned", "missing", rate.alias("rate"), F.when(rate.isNull(), "NOT EVALUABLE").when(rate <= K.LABEL_SHORTFALL_CEILING, "HOLDS").otherwise("FAILED").alias("status"))


def completeness(plan: DataFrame, written: DataFrame) -> DataFrame:
    """Full outer count of rows per clip: planned, have, state (complete, short, over, missing, unknown)."""
    a = plan.groupBy("clip_id").agg(F.count(F.lit(1)).alias("planned"))
    b = written.groupBy("clip_id").agg(F.count(F.lit(1)).alias("have"))
    p, h = F.coalesce("planned", F.lit(0)), F.coalesce("have", F.lit(0))
    state = F.when(F.col("planned").isNull(), "unknown").when(F.col("have").isNull(), "missing").when(h < p, "short").when(h > p, "over").otherwise("complete")
    return a.join(b, "clip_id", "full_outer").select("clip_id", p.alias("planned"), h.alias("have"), state.alias("state"))


def drop_partial_clips(plan: DataFrame, written: DataFrame) -> DataFrame:
    """Rows to keep on resuming: partial rows of planned clips go, rows of clips that are not planned stay."""
    partial = completeness(plan, written).filter("state in ('short', 'over')").select("clip_id")
    return written.join(partial, "clip_id", "left_anti")


def resume_set(plan: DataFrame, written: DataFrame) -> DataFrame:
    """Planned clips that are complete already."""
    return completeness(plan, written).filter("state = 'complete'").select("clip_id")


def verify_labels(plan: DataFrame, written: DataFrame, detections: bool = False) -> DataFrame:
    """Clips by state, number of revisions, and whether the set passes. A missing revision fails unless these are detections."""
    states = completeness(plan, written).agg(*(F.count_if(F.col("state") == s).alias(f"n_{s}") for s in ("complete", "short", "over", "missing", "unknown")))
    revs = written.agg(F.countDistinct("corpus_rev").alias("n_revisions"), F.count_if(F.col("corpus_rev").isNull()).alias("unrevised"))
    ok = (F.col("n_short") + F.col("n_over") + F.col("n_missing") + F.col("n_unknown") == 0) & (F.col("n_revisions") <= 1) & (F.lit(detections) | (F.col("unrevised") == 0))
    return states.crossJoin(revs).withColumn("ok", ok)


def conflict_tally(detections: DataFrame, labels: DataFrame) -> DataFrame:
    """Left join of detections and labels on time rounded to a millisecond: every category, zero or not, and rates to six places."""
    a = detections.select("clip_id", F.round("t_s", 3).alias("t"), F.col("n_boxes"), "failed")
    b = labels.select("clip_id", F.round("t_s", 3).alias("t"), "hands", F.lit(True).alias("labelled"))
    rows = a.join(b, ["clip_id", "t"], "left")
    box, lab = F.col("n_boxes") > 0, F.col("labelled").isNotNull()
    kinds = {
        "failed": F.col("failed"),
        "no_label_row": ~F.col("failed") & ~lab,
        "box_hands_unread": ~F.col("failed") & lab & box & F.col("hands").isNull(),
        "box_no_hand": ~F.col("failed") & lab & box & (F.col("hands") == 0),
        "box_agrees": ~F.col("failed") & lab & box & (F.col("hands") > 0),
        "no_box": ~F.col("failed") & lab & ~box,
    }
    rows = rows.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in kinds.items()))
    return rows.withColumn("conflict_rate", F.round(F.try_divide(F.col("box_hands_unread") + F.col("box_no_hand"), F.col("n")), 6)).withColumn("no_hand_rate", F.round(F.try_divide("box_no_hand", "n"), 6)).withColumn("covers_the_plan", F.col("no_label_row") == 0)


def compare_rates(incomplete: DataFrame, agreement: DataFrame) -> DataFrame:
    """UNTESTED while any clip is incomplete at either rate, else by agreement."""
    n = incomplete.agg(F.count(F.lit(1)).alias("n_incomplete"))
    return n.crossJoin(agreement).withColumn("status", F.when((F.col("n_incomplete") > 0) | (F.col("n_clips") == 0), "UNTESTED").when(F.col("holds"), "HOLDS").otherwise("FAILED"))


def frequency_gates(spectral: DataFrame, transitions: DataFrame) -> DataFrame:
    """Mean relative difference of the two frequencies where both are ok (none fails), share resolvable, clips below 0.05 Hz."""
    both = spectral.select("clip_id", F.col("hz").alias("a"), "resolvable").join(transitions.select("clip_id", F.col("hz").alias("b")), "clip_id")
    d = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.abs(F.col("a") - F.col("b")) / ((F.col("a") + F.col("b")) / 2))
    rows = both.agg(F.count(d).alias("n_both"), F.avg(d).alias("mean_difference"), F.avg(F.col("resolvable").cast("int")).alias("resolvable_fraction"), F.count_if(F.col("b") < 0.05).alias("n_slow"))
    return rows.withColumn("h2a", F.coalesce(F.col("mean_difference") <= K.H2A_MAX, F.lit(False))).withColumn("h2b", F.coalesce(F.col("resolvable_fraction") >= K.H2B_MIN, F.lit(False)))


def roll_up_claims(parts: DataFrame) -> DataFrame:
    """parent, status: FAILED if any part failed, HOLDS if all hold, else UNTESTED; a part without a result is untested."""
    s = F.coalesce("status", F.lit("UNTESTED"))
    return parts.groupBy("parent").agg(F.when(F.bool_or(s == "FAILED"), "FAILED").when(F.bool_and(s == "HOLDS"), "HOLDS").otherwise("UNTESTED").alias("status"))


def read_claims(claims: DataFrame, results: DataFrame) -> DataFrame:
    """Claims with the status in their own result; without one UNTESTED. An unknown status is an error; pilot-gated claims carry no interval."""
    rows = claims.join(results, "claim_id", "left")
    s = F.coalesce("status", F.lit("UNTESTED"))
    known = F.when(s.isin(*K.CLAIM_STATES), s).otherwise(F.raise_error(F.concat(F.lit("unknown status "), s)).cast("string"))
    return rows.select("claim_id", "statement", "pilot_gate", known.alias("status"), F.when(~F.col("pilot_gate"), F.col("lo")).alias("lo"), F.when(~F.col("pilot_gate"), F.col("hi")).alias("hi"))


def build_card(claims: DataFrame, gaps: DataFrame) -> DataFrame:
    """The verdict: VERIFIED only if nothing is untested and there is no gap."""
    a = claims.agg(F.count_if(F.col("status").startswith("UNTESTED")).alias("n_untested"), F.count(F.lit(1)).alias("n_claims"))
    b = gaps.agg(F.count(F.lit(1)).alias("n_gaps"))
    return a.crossJoin(b).withColumn("verdict", F.when((F.col("n_untested") == 0) & (F.col("n_gaps") == 0), "VERIFIED").otherwise("UNVERIFIED"))


def arms_decided(arms: DataFrame) -> DataFrame:
    """A choice between estimators is decided once every arm is measured."""
    return arms.agg(F.coalesce(F.bool_and("measured"), F.lit(False)).alias("decided"), F.count(F.lit(1)).alias("n_arms"))


def known_gaps(lines: DataFrame) -> DataFrame:
    """Names, in order, of table rows whose bold name stands beside a bold Unobservable."""
    name = F.regexp_extract("line", r"^\|\s*\*\*(.+?)\*\*\s*\|", 1)
    return lines.filter((name != "") & F.col("line").rlike(r"\*\*[^*|]*Unobservable[^*|]*\*\*")).select("n", F.trim(name).alias("gap"))


def at_least_one(df: DataFrame, message: str) -> DataFrame:
    """df, or an error at run time if it is empty."""
    n = df.agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.when(F.col("n") == 0, F.raise_error(F.lit(message)).cast("string")).alias("error"))


def share(part: Column, whole: Column) -> Column:
    return F.try_divide(part, whole)
