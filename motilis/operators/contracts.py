"""Record contracts: the rules a row of each record breaks, as an array of names; and the guard against identifiers.

A rule is an expression that is true where the rule is kept; null counts as kept, since absence has its own rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K

#: Rules by record, as SQL expressions over the record's columns.
RULES: dict[str, dict[str, str]] = {
    "clip_ref": {
        "id matches parts": "clip_id = format_string('%s/%s/%06d', factory_id, worker_id, clip_index)",
        "byte range": "byte_end > byte_start and byte_start >= 0",
        "positive duration": "duration_s > 0",
        "positive rate": "fps > 0",
        "positive size": "width > 0 and height > 0",
        "revision": "coalesce(corpus_rev, '') != ''",
    },
    "frame_signal": {
        "lengths": "size(manipulation) = n_frames and size(hands_visible) = n_frames and size(hand_box_width_px) = n_frames",
        "labels null together": "forall(arrays_zip(manipulation, hands_visible), x -> (x.manipulation is null) = (x.hands_visible is null))",
        "manipulation needs a hand": "not exists(arrays_zip(manipulation, hands_visible), x -> coalesce(x.manipulation and x.hands_visible = 0, false))",
        "box needs a hand": "not exists(arrays_zip(hands_visible, hand_box_width_px), x -> x.hand_box_width_px is not null and coalesce(x.hands_visible, 0) = 0)",
        "positive box": "not exists(hand_box_width_px, x -> coalesce(x <= 0, false))",
        "null count": "n_unreadable = size(filter(manipulation, x -> x is null))",
        "provenance": "(status = 'not_attempted') = (label_source is null)",
        "readable": "status != 'ok' or n_unreadable <= 0.10 * n_frames",
        "status": "status in ('ok', 'too_short', 'no_labels', 'decode_failed', 'not_attempted')",
    },
    "exertion_segment": {"order": "end_s > start_s", "debounce": "min_duration_s = 0.5", "length": "end_s - start_s >= 0.5"},
    "duty_cycle": {
        "null unless ok": "(duty_cycle is null) = (status != 'ok')",
        "ratio": "status != 'ok' or abs(duty_cycle - n_frames_exerting / n_frames_scored) <= 1e-9",
        "counts": "n_frames_exerting <= n_frames_scored and n_frames_excluded >= 0",
        "excluded": "status != 'ok' or n_frames_excluded <= 0.10 * (n_frames_scored + n_frames_excluded)",
    },
    "frequency": {
        "null unless ok": "(hz is null) = (status != 'ok')",
        "below nyquist": "hz > 0 and hz < nyquist_hz",
        "ratio with floor": "(peak_power_ratio is null) = (resolvability_floor is null)",
        "ratio reaches floor": "status != 'ok' or method != 'spectral' or coalesce(peak_power_ratio >= resolvability_floor, false)",
        "transitions carry no ratio": "method != 'transitions' or peak_power_ratio is null",
    },
    "hand_speed": {
        "null unless ok": "(rms_speed_mm_s is null) = (status != 'ok')",
        "counts": "n_samples >= n_with_box and n_with_box >= n_flow_null",
        "rate needs a box": "(flow_null_rate is null) = (n_with_box = 0)",
        "coverage": "abs(coverage - n_with_box / n_samples) <= 1e-9",
        "positive": "rms_speed_mm_s > 0",
        "reason": "(status_reason is null) = (status = 'ok')",
    },
    "hal": {
        "null unless ok": "(hal is null) = (status != 'ok')",
        "bounds": "hal between 0 and 10",
        "no force": "force_axis is null and not tlv_evaluable",
        "zero duty": "not coalesce(duty_cycle = 0, false) or status = 'zero_duty_cycle'",
        "duty missing": "duty_cycle is not null or status = 'no_input'",
        "recomputed": "status != 'ok' or mapping != 'akkas_2015' or abs(hal - least(10, greatest(0, 10 / (1 + exp(-(-15.87 + 2 * duty_cycle + 2.25 * ln(rms_speed_mm_s))))))) <= 0.05 + 1e-9",
    },
    "aggregate": {
        "workers": "n_workers >= 50",
        "factories": "n_factories >= 5",
        "shares": "max_factory_share_workers <= 0.40 and max_factory_share_clips <= 0.40",
        "interval": "hal_mean between ci_lo and ci_hi",
        "contrast": "hal_mean between iid_lo and iid_hi",
        "design effect": "abs(design_effect / pow(design_effect_width_ratio, 2) - 1) <= 0.05",
        "b": "bootstrap_b = 10000",
    },
    "claim": {"id": "coalesce(claim_id, '') != ''", "status": "status in ('UNTESTED', 'HOLDS', 'FAILED', 'UNTESTED_ARM_B')", "pilot interval": "not pilot_gate or (lo is null and hi is null)", "interval": "lo <= hi"},
    "card": {"verified": "verdict != 'VERIFIED' or (n_untested = 0 and n_gaps = 0)", "verdict": "verdict in ('VERIFIED', 'UNVERIFIED')"},
}


def violations(df: DataFrame, record: str) -> DataFrame:
    """df with the names of broken rules in `violations`, in the order they are listed."""
    broken = [F.when(~F.coalesce(F.expr(rule), F.lit(True)), F.lit(name)) for name, rule in RULES[record].items()]
    return df.withColumn("violations", F.array_compact(F.array(*broken)))


def checked(df: DataFrame, record: str) -> DataFrame:
    """df, or an error at run time at the first broken rule; to put before a sink."""
    rows = violations(df, record)
    message = F.concat(F.lit(f"{record}: "), F.array_join("violations", "; "))
    return rows.filter(F.when(F.size("violations") == 0, F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))).drop("violations")


def unique_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their number."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def identifier_leaks(df: DataFrame) -> DataFrame:
    """Rows any of whose values or keys holds an identifier, as JSON."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("row")).filter(F.col("row").rlike(K.IDENTIFIER))
