"""Queries over the driver's tables and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import columns as C
from ..operators import bouts, contracts, estimation, exposure, gates, plan, ranks, signals, spectral, speed
from ..sources import bucketed, scans

from .fixtures import clips, observations, samples, sql, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if oracle is not None:
            ORACLE[name] = oracle
        return f

    return keep


def r6(c: str, name: str | None = None):
    return F.round(c, 6).alias(name or c)


# --- plan -------------------------------------------------------------------------------------------------------------

NS = "CASE WHEN {d} * {f} - 1 <= 0 THEN 0 WHEN abs(({d} * {f} - 1) - round({d} * {f} - 1)) <= 1e-9 THEN round({d} * {f} - 1) ELSE ceil({d} * {f} - 1) END"


@query("p1_n_samples", sql(f"SELECT clip_id, CAST({NS.format(d='duration_s', f='4.0')} AS INTEGER) AS n4, CAST({NS.format(d='duration_s', f='7.3')} AS INTEGER) AS n7, fps / 2 AS nyquist_hz, duration_s < 60 AS too_short FROM clips"))
def p1(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("duration_s")
    return clips(spark, d).select("clip_id", C.n_samples(c, F.lit(4.0)).alias("n4"), C.n_samples(c, F.lit(7.3)).alias("n7"), C.nyquist_hz(F.col("fps")).alias("nyquist_hz"), plan.is_too_short(c).alias("too_short"))


@query("p2_sample_times", sql(f"s AS (SELECT clip_id, unnest(range(CAST({NS.format(d='duration_s', f='4.0')} AS BIGINT))) AS i FROM clips) SELECT clip_id, CAST(i AS INTEGER) AS i, CAST(i AS DOUBLE) / 4 AS t_s FROM s"))
def p2(spark: SparkSession, d: str) -> DataFrame:
    return plan.sample_times(clips(spark, d)).select("clip_id", "i", "t_s")


@query("p3_plan_pairs", sql(f"s AS (SELECT clip_id, fps, unnest(range(CAST({NS.format(d='duration_s', f='4.0')} AS BIGINT))) AS i FROM clips WHERE duration_s >= 60) SELECT clip_id, CAST(i AS INTEGER) AS i, round(i * 0.25 + 1 / fps, 6) AS t2_s FROM s"))
def p3(spark: SparkSession, d: str) -> DataFrame:
    return plan.plan_pairs(clips(spark, d)).select("clip_id", "i", r6("t2_s"))


@query("p5_pilot_factory", sql("SELECT min(factory_id) AS pilot_factory FROM clips"))
def p5(spark: SparkSession, d: str) -> DataFrame:
    return plan.pilot_factory(clips(spark, d))


@query("p6_native_frames", sql("s AS (SELECT clip_id, CAST(floor(i * CAST(0.11 AS DOUBLE) * 30 + 0.5) AS BIGINT) AS idx, min(i) AS i FROM samples GROUP BY 1, 2) SELECT clip_id, idx, CAST(i AS INTEGER) AS i, coalesce(lag(idx) OVER (PARTITION BY clip_id ORDER BY idx) = idx - 1, false) AS after_previous FROM s"))
def p6(spark: SparkSession, d: str) -> DataFrame:
    return plan.native_frames(samples(spark, d).select("clip_id", "i", (F.col("i") * 0.11).alias("t_s"), F.lit(30).alias("fps")))


@query("p7_rate_of", sql("f AS (SELECT DISTINCT t_s FROM samples WHERE clip_id = (SELECT min(clip_id) FROM samples)), g AS (SELECT t_s, t_s - lag(t_s) OVER (ORDER BY t_s) AS gap FROM f), h AS (SELECT round(gap, 6) AS r, count(*) AS n, min(t_s) AS first_t, arg_min(gap, t_s) AS gap FROM g WHERE gap > 0 GROUP BY 1) SELECT (SELECT 1 / gap FROM h ORDER BY n DESC, first_t LIMIT 1) AS hz"))
def p7(spark: SparkSession, d: str) -> DataFrame:
    return plan.rate_of(samples(spark, d))


# --- ids and joins ----------------------------------------------------------------------------------------------------


@query("s4_clip_ids", sql("SELECT clip_id, split_part(clip_id, '/', 1) AS factory_id, split_part(clip_id, '/', 2) AS worker_id, CAST(split_part(clip_id, '/', 3) AS INTEGER) AS clip_index FROM clips"))
def s4(spark: SparkSession, d: str) -> DataFrame:
    return clips(spark, d).select("clip_id", C.parse_clip_id(F.col("clip_id")).alias("p")).select("clip_id", "p.*")


@query("s9_decode_outcome", sql("SELECT clip_id, greatest(n - 3 - 1, 0) AS pairs_decoded, greatest(n - greatest(n - 4, 0), 0) AS failures FROM clips"))
def s9(spark: SparkSession, d: str) -> DataFrame:
    return clips(spark, d).select("clip_id", plan.decode_outcome(F.col("n"), F.col("n") - 3).alias("o")).select("clip_id", "o.*")


def label_rows(spark: SparkSession, d: str) -> DataFrame:
    """Written labels with gaps and rows written twice: every seventh instant is missing, every fifth was written before with other values."""
    rows = samples(spark, d).filter("i % 7 != 3")
    now = rows.select("clip_id", "t_s", F.lit(1).alias("seq"), F.col("v").alias("manipulation"), F.col("hands").alias("hands_visible"), F.when(F.col("v").isNull(), "unreadable").alias("unreadable_reason"))
    old = rows.filter("i % 5 = 0").select("clip_id", "t_s", F.lit(0).alias("seq"), F.lit(True).alias("manipulation"), F.lit(2).alias("hands_visible"), F.lit(None).cast("string").alias("unreadable_reason"))
    return now.unionByName(old)


@query("j1_plan_labels", sql("SELECT clip_id, CAST(i AS INTEGER) AS i, CASE WHEN i % 7 != 3 THEN v END AS manipulation, CASE WHEN i % 7 = 3 THEN 'instant has no label row' WHEN v IS NULL THEN 'unreadable' END AS reason FROM samples"))
def j1(spark: SparkSession, d: str) -> DataFrame:
    return signals.join_labels(plan.sample_times(clips(spark, d)).select("clip_id", "i", "t_s"), label_rows(spark, d)).select("clip_id", "i", "manipulation", F.col("unreadable_reason").alias("reason"))


def box_rows(spark: SparkSession, d: str) -> DataFrame:
    box = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.col("width"), F.lit(10.0).alias("height"), F.lit(0.9).alias("score"))
    small = F.struct(F.lit(1.0).alias("x"), F.lit(0.0).alias("y"), (F.col("width") / 2).alias("width"), F.lit(20.0).alias("height"), F.lit(0.8).alias("score"))
    return samples(spark, d).filter("i % 11 != 5").select("clip_id", "t_s", F.lit(0).alias("seq"), F.when(F.col("width").isNotNull(), F.array(small, box)).otherwise(F.array().cast("array<struct<x:double,y:double,width:double,height:double,score:double>>")).alias("boxes"), F.lit(None).cast("string").alias("failed_reason"))


@query("j1_bucketed", sql("SELECT clip_id, CAST(i AS INTEGER) AS i, CASE WHEN i % 7 != 3 THEN v END AS manipulation, CASE WHEN i % 7 = 3 THEN 'instant has no label row' WHEN v IS NULL THEN 'unreadable' END AS reason FROM samples"))
def j1_bucketed(spark: SparkSession, d: str) -> DataFrame:
    """j1 over tables written once in buckets of clip_id: nothing is shuffled below the join."""
    planned, labels = bucketed.bucketed(plan.sample_times(clips(spark, d)).select("clip_id", "i", "t_s"), "clip_id"), bucketed.bucketed(label_rows(spark, d), "clip_id")
    with bucketed.without_shuffle(spark):
        rows = signals.join_labels(planned, labels).select("clip_id", "i", "manipulation", F.col("unreadable_reason").alias("reason"))
        return ranks.written(rows)  # planned and run here


@query("j2_plan_detections", sql("SELECT clip_id, CAST(i AS INTEGER) AS i, CASE WHEN i % 11 = 5 THEN 'instant has no detection row' END AS failed_reason, CASE WHEN i % 11 != 5 THEN width / 2 END AS largest_width, CASE WHEN i % 11 != 5 THEN width END AS scaled_width FROM samples"))
def j2(spark: SparkSession, d: str) -> DataFrame:
    rows = signals.join_detections(plan.sample_times(clips(spark, d)).select("clip_id", "i", "t_s"), box_rows(spark, d))
    # of two boxes of one area the first counts; doubling both axes leaves that so
    return rows.select("clip_id", "i", "failed_reason", C.largest_box(F.col("boxes"))["width"].alias("largest_width"), C.largest_box(C.scale_boxes(F.col("boxes"), F.lit(2.0), F.lit(2.0)))["width"].alias("scaled_width"))


@query("f8_box_mask", sql("b AS (SELECT width AS w, i % 5 AS a, k % 3 AS c, count(*) AS instants FROM samples WHERE width IS NOT NULL GROUP BY 1, 2, 3), r AS (SELECT *, 9.5 * a - 3 AS bx, 11.25 * c - 2 AS by_, w / 10 AS bw, (w - 140) / 7 AS bh FROM b), p AS (SELECT unnest(range(40)) AS x), q AS (SELECT unnest(range(30)) AS y) SELECT w, a, c, instants, count(x) AS n, CAST(sum(x) AS BIGINT) AS sx, CAST(sum(y) AS BIGINT) AS sy FROM r LEFT JOIN (p CROSS JOIN q) ON x >= greatest(floor(bx), 0) AND x < least(ceil(bx + bw), 40) AND y >= greatest(floor(by_), 0) AND y < least(ceil(by_ + bh), 30) GROUP BY 1, 2, 3, 4"))
def f8(spark: SparkSession, d: str) -> DataFrame:
    boxes = samples(spark, d).filter("width is not null").groupBy(F.col("width").alias("w"), (F.col("i") % 5).alias("a"), (F.col("k") % 3).alias("c")).agg(F.count(F.lit(1)).alias("instants"))
    box = F.struct((9.5 * F.col("a") - 3).alias("x"), (11.25 * F.col("c") - 2).alias("y"), (F.col("w") / 10).alias("width"), ((F.col("w") - 140) / 7).alias("height"))
    pixels = boxes.withColumn("box", box).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(39)))).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(29))))
    inside = C.in_box(F.col("x"), F.col("y"), F.col("box"), F.lit(40), F.lit(30))
    return pixels.groupBy("w", "a", "c", "instants").agg(F.count_if(inside).alias("n"), F.sum(F.when(inside, F.col("x"))).alias("sx"), F.sum(F.when(inside, F.col("y"))).alias("sy"))


CONFLICT = "CASE WHEN width IS NOT NULL AND hands IS NULL THEN 'labeller could not read the frame' WHEN width IS NOT NULL AND hands = 0 THEN 'labeller saw no hand' END"


@query("f1_resolve_conflicts", sql(f"SELECT clip_id, CAST(i AS INTEGER) AS i, {CONFLICT} AS conflict, CASE WHEN {CONFLICT} IS NULL THEN width END AS width FROM samples"))
def f1(spark: SparkSession, d: str) -> DataFrame:
    return signals.resolve_conflicts(samples(spark, d)).select("clip_id", "i", "conflict", "width")


@query("f2_conflict_counts", sql(f"SELECT clip_id, count(*) FILTER ({CONFLICT} LIKE '%read%') AS unread, count(*) FILTER ({CONFLICT} LIKE '%saw%') AS no_hand, count({CONFLICT}) AS total, count(*) AS n FROM samples GROUP BY 1"))
def f2(spark: SparkSession, d: str) -> DataFrame:
    return signals.conflict_counts(samples(spark, d))


@query("v8_conflict_gate", sql(f"SELECT count({CONFLICT}) AS conflicts, count(*) AS samples, count({CONFLICT}) / count(*) AS rate, count({CONFLICT}) / count(*) < 0.10 AS ok FROM samples"))
def v8(spark: SparkSession, d: str) -> DataFrame:
    return speed.conflict_gate(signals.conflict_counts(samples(spark, d)))


@query("f3_frame_signal", sql("SELECT clip_id, n AS n_frames, u AS n_unreadable, CASE WHEN duration_s < 60 THEN 'too_short' WHEN n = 0 OR u / n > 0.10 THEN 'no_labels' ELSE 'ok' END AS status, labels, widths FROM (SELECT clip_id, duration_s, count(*) AS n, count(*) - count(v) AS u, string_agg(coalesce(CAST(v AS VARCHAR), '-'), '' ORDER BY i) AS labels, count(CASE WHEN hands > 0 THEN width END) AS widths FROM samples JOIN clips USING (clip_id) GROUP BY 1, 2)"))
def f3(spark: SparkSession, d: str) -> DataFrame:
    rows = signals.frame_signal(signals.resolve_conflicts(samples(spark, d)), clips(spark, d))
    return rows.select("clip_id", "n_frames", "n_unreadable", "status", F.array_join(F.transform("manipulation", lambda x: F.coalesce(x.cast("string"), F.lit("-"))), "").alias("labels"), F.size(F.filter("hand_box_width_px", lambda x: x.isNotNull())).cast("long").alias("widths"))


@query("f4_head_conflicts", sql("SELECT clip_id, count(*) AS n, count(*) FILTER (coalesce(m AND hands = 0, false)) AS clashes, count(CASE WHEN NOT coalesce(m AND hands = 0, false) THEN m END) AS readable FROM (SELECT *, CASE WHEN v IS NOT NULL THEN v OR i % 9 = 0 END AS m FROM samples) GROUP BY 1"))
def f4(spark: SparkSession, d: str) -> DataFrame:
    rows = samples(spark, d).select("clip_id", "i", F.when(F.col("v").isNotNull(), F.col("v") | (F.col("i") % 9 == 0)).alias("manipulation"), F.col("hands").alias("hands_visible"), F.lit(None).cast("string").alias("unreadable_reason"))
    return signals.head_conflicts(rows).groupBy("clip_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("clash").alias("clashes"), F.count("manipulation").alias("readable"))


@query("f5_tail_rows", sql("SELECT clip_id, count(*) AS n, CAST(min(i) AS INTEGER) AS first_i FROM samples WHERE i >= 150 GROUP BY 1"))
def f5(spark: SparkSession, d: str) -> DataFrame:
    rows = signals.tail_rows(plan.sample_times(clips(spark, d)), samples(spark, d).filter("i < 150"))
    return rows.groupBy("clip_id").agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("first_i"))


@query("v9_not_attempted", sql("SELECT clip_id, CAST(n AS INTEGER) AS n_frames, CAST(n AS INTEGER) AS n_unreadable, CAST(0 AS BIGINT) AS readable, 'not_attempted' AS status FROM clips"))
def v9(spark: SparkSession, d: str) -> DataFrame:
    return signals.not_attempted(clips(spark, d)).select("clip_id", "n_frames", "n_unreadable", F.size(F.filter("manipulation", lambda x: x.isNotNull())).cast("long").alias("readable"), "status")


# --- bouts ------------------------------------------------------------------------------------------------------------

RUNS = """
r0 AS (SELECT clip_id, i, v, CASE WHEN lag(i) OVER w IS NULL OR v IS DISTINCT FROM lag(v) OVER w THEN 1 ELSE 0 END AS new FROM samples WINDOW w AS (PARTITION BY clip_id ORDER BY i)),
r1 AS (SELECT *, sum(new) OVER (PARTITION BY clip_id ORDER BY i) AS run FROM r0),
runs AS (SELECT clip_id, min(i) AS start, max(i) + 1 AS stop, any_value(v) AS v FROM r1 GROUP BY clip_id, run)
"""
SETTLED = (
    RUNS.strip()
    + """,
d0 AS (SELECT *, stop - start AS len, v IS NULL AS blank, sum(CASE WHEN v IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id ORDER BY start) AS island FROM runs),
d1 AS (SELECT *, sum(len) OVER (PARTITION BY clip_id, island, blank ORDER BY start) AS cum FROM d0),
d2 AS (SELECT *, CASE WHEN len / 4.0 >= 0.5 OR ((cum - len) / 4.0 < 0.5 AND cum / 4.0 >= 0.5) THEN v END AS held FROM d1),
d3 AS (SELECT clip_id, start, stop, CASE WHEN NOT blank THEN coalesce(last_value(held IGNORE NULLS) OVER (PARTITION BY clip_id, island, blank ORDER BY start),
         first_value(held IGNORE NULLS) OVER (PARTITION BY clip_id, island, blank ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING),
         last_value(v) OVER (PARTITION BY clip_id, island, blank ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) END AS v FROM d2),
d4 AS (SELECT *, CASE WHEN lag(start) OVER w IS NULL OR v IS DISTINCT FROM lag(v) OVER w THEN 1 ELSE 0 END AS new FROM d3 WINDOW w AS (PARTITION BY clip_id ORDER BY start)),
d5 AS (SELECT *, sum(new) OVER (PARTITION BY clip_id ORDER BY start) AS run FROM d4),
settled AS (SELECT clip_id, min(start) AS start, max(stop) AS stop, any_value(v) AS v FROM d5 GROUP BY clip_id, run),
s1 AS (SELECT *, (lag(start) OVER w IS NOT NULL AND lag(v) OVER w IS NULL) OR (lead(start) OVER w IS NOT NULL AND lead(v) OVER w IS NULL) AS null_bounded FROM settled WINDOW w AS (PARTITION BY clip_id ORDER BY start)),
segments AS (SELECT clip_id, start / 4.0 AS start_s, stop / 4.0 AS end_s, null_bounded FROM s1 WHERE v AND (stop - start) / 4.0 >= 0.5)
"""
)
TRANSITIONS = (
    SETTLED
    + """,
sc AS (SELECT clip_id, count(v) / 4.0 AS scored_s FROM samples GROUP BY 1),
sg AS (SELECT clip_id, count(*) AS n, count(*) FILTER (null_bounded) AS nb FROM segments GROUP BY 1),
t0 AS (SELECT clip_id, coalesce(n, 0) AS n_segments, coalesce(nb, 0) AS n_null_bounded, scored_s, CASE WHEN n > 0 AND scored_s > 0 THEN n / scored_s END AS raw FROM sc LEFT JOIN sg USING (clip_id)),
transitions AS (SELECT clip_id, n_segments, n_null_bounded, scored_s, CASE WHEN raw < 2 THEN raw END AS hz, CASE WHEN raw IS NULL THEN 'no_peak' WHEN raw >= 2 THEN 'aliased' ELSE 'ok' END AS status FROM t0)
"""
)


@query("r1_runs", sql(RUNS + "SELECT clip_id, CAST(start AS INTEGER) AS start, CAST(stop AS INTEGER) AS stop, v FROM runs"))
def r1(spark: SparkSession, d: str) -> DataFrame:
    return bouts.runs(samples(spark, d))


@query("r2_debounce", sql(SETTLED + "SELECT clip_id, CAST(start AS INTEGER) AS start, CAST(stop AS INTEGER) AS stop, v FROM settled"))
def r2(spark: SparkSession, d: str) -> DataFrame:
    return bouts.debounce(bouts.runs(samples(spark, d)))


@query("r3_scored_seconds", sql("SELECT clip_id, count(v) / 4.0 AS scored_s FROM samples GROUP BY 1"))
def r3(spark: SparkSession, d: str) -> DataFrame:
    return bouts.scored_seconds(samples(spark, d))


@query("r4_exertion_segments", sql(SETTLED + "SELECT * FROM segments"))
def r4(spark: SparkSession, d: str) -> DataFrame:
    return bouts.exertion_segments(bouts.debounce(bouts.runs(samples(spark, d))))


@query("r5_null_bounded", sql(SETTLED + "SELECT clip_id, count(*) AS n FROM segments WHERE null_bounded GROUP BY 1"))
def r5(spark: SparkSession, d: str) -> DataFrame:
    return bouts.exertion_segments(bouts.debounce(bouts.runs(samples(spark, d)))).filter("null_bounded").groupBy("clip_id").agg(F.count(F.lit(1)).alias("n"))


@query("r6_transition_frequency", sql(TRANSITIONS + "SELECT clip_id, n_segments, n_null_bounded, scored_s, round(hz, 6) AS hz, status FROM transitions"))
def r6_(spark: SparkSession, d: str) -> DataFrame:
    return bouts.transition_frequency(samples(spark, d)).withColumn("hz", F.round("hz", 6))


@query("r8_resolvability_floor", sql("SELECT clip_id, n, CASE WHEN n >= 2 THEN round(-ln(1 - pow(0.95, 1.0 / n)) / ln(2), 6) END AS floor FROM clips"))
def r8(spark: SparkSession, d: str) -> DataFrame:
    return clips(spark, d).select("clip_id", "n", F.round(C.resolvability_floor(F.col("n")), 6).alias("floor"))


# --- spectral ---------------------------------------------------------------------------------------------------------

SPECTRAL = """
e AS (SELECT clip_id, i, v, duration_s FROM samples JOIN clips USING (clip_id)),
g AS (SELECT clip_id, duration_s, count(*) AS n, count(v) AS scored, (max(i) FILTER (v IS NOT NULL) - min(i) FILTER (v IS NOT NULL)) / 4.0 AS span, avg(CAST(v AS INTEGER)) AS mean FROM e GROUP BY 1, 2),
h AS (SELECT *, CASE WHEN duration_s < 60 THEN 'too_short' WHEN n = 0 OR (n - scored) / n > 0.10 OR scored < 8 OR span <= 0 THEN 'no_labels' END AS early, CAST(floor(span * 2) AS BIGINT) AS bins FROM g),
y AS (SELECT e.clip_id, i / 4.0 AS t, CAST(v AS INTEGER) - mean AS y, span, bins FROM e JOIN h USING (clip_id) WHERE early IS NULL AND v IS NOT NULL AND bins >= 2),
f AS (SELECT clip_id, unnest(range(1, bins + 1)) AS b, span FROM h WHERE early IS NULL AND bins >= 2),
tau AS (SELECT f.clip_id, b, 2 * pi() * b / f.span AS w, atan2(sum(sin(4 * pi() * b / f.span * t)), sum(cos(4 * pi() * b / f.span * t))) / (4 * pi() * b / f.span) AS tau FROM f JOIN y ON f.clip_id = y.clip_id GROUP BY f.clip_id, b, f.span),
pw0 AS (SELECT tau.clip_id, b, any_value(span) AS span, count(*) AS n, sum(y * cos(w * (t - tau))) AS cy, sum(pow(cos(w * (t - tau)), 2)) AS cc, sum(y * sin(w * (t - tau))) AS sy, sum(pow(sin(w * (t - tau)), 2)) AS ss, sum(y * y) AS yy FROM tau JOIN y ON tau.clip_id = y.clip_id GROUP BY tau.clip_id, b),
pw AS (SELECT clip_id, b, b / span AS f, (CASE WHEN cc > 1e-9 * n THEN pow(cy, 2) / cc ELSE 0 END + CASE WHEN ss > 1e-9 * n THEN pow(sy, 2) / ss ELSE 0 END) / yy AS p FROM pw0),
rk AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY p DESC, b) AS r FROM pw),
pk AS (SELECT clip_id, max(p) FILTER (r = 1) AS peak, max(f) FILTER (r = 1) AS hz, median(p) FILTER (r > 1) AS rest FROM rk GROUP BY 1),
q AS (SELECT h.clip_id, early, bins, peak / rest AS ratio, -ln(1 - pow(0.95, 1.0 / bins)) / ln(2) AS floor, hz FROM h LEFT JOIN pk USING (clip_id)),
spectrum AS (SELECT clip_id, CASE WHEN early IS NULL THEN CAST(bins AS INTEGER) END AS n_bins, CASE WHEN early IS NULL AND ratio >= floor AND hz < 2 THEN hz END AS hz, CASE WHEN early IS NULL THEN ratio END AS ratio, CASE WHEN early IS NULL THEN floor END AS floor,
  CASE WHEN early IS NOT NULL THEN early WHEN bins < 2 OR ratio < floor THEN 'no_peak' WHEN hz >= 2 THEN 'aliased' ELSE 'ok' END AS status FROM q)
"""


def spectral_rows(spark: SparkSession, d: str) -> DataFrame:
    """All instants; where the top bin falls on the Nyquist rate its sine has no power, there as here."""
    return spectral.spectral_frequency(samples(spark, d).select("clip_id", "i", "v"), clips(spark, d))


@query("r10_spectral_frequency", sql(SPECTRAL + "SELECT clip_id, n_bins, round(hz, 6) AS hz, round(ratio, 4) AS peak_power_ratio, round(floor, 6) AS resolvability_floor, status, status = 'ok' AS resolvable FROM spectrum"))
def r10(spark: SparkSession, d: str) -> DataFrame:
    return spectral_rows(spark, d).select("clip_id", "n_bins", r6("hz"), F.round("peak_power_ratio", 4).alias("peak_power_ratio"), r6("resolvability_floor"), "status", "resolvable")


@query("r11_resolvable_fraction", sql(SPECTRAL + "SELECT avg(CAST(status = 'ok' AS INTEGER)) AS resolvable_fraction FROM spectrum"))
def r11(spark: SparkSession, d: str) -> DataFrame:
    return spectral.resolvable_fraction(spectral_rows(spark, d))


@query("a21_frequency_gates", sql(SPECTRAL.rstrip() + "," + TRANSITIONS + """, b AS (SELECT abs(s.hz - t.hz) / ((s.hz + t.hz) / 2) AS d, s.status = 'ok' AS res, t.hz AS thz FROM spectrum s JOIN transitions t USING (clip_id))
SELECT count(d) AS n_both, round(avg(d), 6) AS mean_difference, avg(CAST(res AS INTEGER)) AS resolvable_fraction, count(*) FILTER (thz < 0.05) AS n_slow, coalesce(avg(d) <= 0.20, false) AS h2a, coalesce(avg(CAST(res AS INTEGER)) >= 0.70, false) AS h2b FROM b"""))
def a21(spark: SparkSession, d: str) -> DataFrame:
    return gates.frequency_gates(spectral_rows(spark, d), bouts.transition_frequency(samples(spark, d))).withColumn("mean_difference", F.round("mean_difference", 6))


# --- speed ------------------------------------------------------------------------------------------------------------

SPEED = """
sp0 AS (SELECT clip_id, duration_s, count(*) AS n_samples, count(width) AS n_with_box, count(*) FILTER (width IS NOT NULL AND px IS NULL) AS n_flow_null, median(width) AS mw, avg(CASE WHEN width IS NOT NULL THEN px * px END) AS sq FROM samples JOIN clips USING (clip_id) GROUP BY 1, 2),
sp1 AS (SELECT *, n_with_box / n_samples AS coverage, n_flow_null / nullif(n_with_box, 0) AS rate FROM sp0),
speeds AS (SELECT *, CASE WHEN duration_s < 60 THEN 'too_short' WHEN coverage < 0.60 THEN 'low_coverage' WHEN rate > 0.10 THEN 'flow_failed' WHEN coalesce(sqrt(sq), 0) <= 0 THEN 'flow_failed' ELSE 'ok' END AS status FROM sp1),
speed AS (SELECT clip_id, CASE WHEN status = 'ok' THEN sqrt(sq) * 85 / mw END AS rms, n_samples, n_with_box, n_flow_null, coverage, rate, mw, status FROM speeds)
"""
REASON = "CASE status WHEN 'too_short' THEN 'clip shorter than the pre-registered 60 s floor' WHEN 'low_coverage' THEN format('detector coverage {:.2f} below the 0.60 floor', coverage) WHEN 'flow_failed' THEN format('flow-null rate {:.2f} above the 0.10 ceiling', rate) END"


@query("v4_hand_speed", sql(SPEED + f"SELECT clip_id, round(rms, 6) AS rms_speed_mm_s, n_samples, n_with_box, n_flow_null, round(coverage, 6) AS coverage, round(rate, 6) AS flow_null_rate, mw AS median_box_width_px, status, {REASON} AS status_reason FROM speed"))
def v4(spark: SparkSession, d: str) -> DataFrame:
    return speed.hand_speed_estimate(samples(spark, d), clips(spark, d)).withColumns({c: F.round(c, 6) for c in ("rms_speed_mm_s", "coverage", "flow_null_rate")})


@query("v7_coverage_gate", sql(SPEED + "SELECT CAST(sum(n_samples) AS BIGINT) AS samples, CAST(sum(n_with_box) AS BIGINT) AS boxed, CAST(sum(n_flow_null) AS BIGINT) AS nulls, 0 AS missing, round(sum(n_with_box) / sum(n_samples), 6) AS coverage, round(sum(n_flow_null) / sum(n_with_box), 6) AS flow_null_rate, CASE WHEN sum(n_with_box) / sum(n_samples) >= 0.60 AND sum(n_flow_null) / sum(n_with_box) <= 0.10 THEN 'HOLDS' ELSE 'FAILED' END AS status FROM speed WHERE clip_id IN (SELECT clip_id FROM clips WHERE k % 2 = 0)"))
def v7(spark: SparkSession, d: str) -> DataFrame:
    c = clips(spark, d)
    return speed.coverage_gate(speed.hand_speed_estimate(samples(spark, d), c), c.filter("k % 2 = 0")).withColumns({x: F.round(x, 6) for x in ("coverage", "flow_null_rate")})


@query("v3_speed_samples", sql("SELECT clip_id, CAST(i AS INTEGER) AS i, CASE WHEN width IS NOT NULL AND q2 AND px IS NOT NULL AND i % 13 != 0 THEN round(px / 0.25, 6) END AS px_per_s, CASE WHEN width IS NULL THEN 'instant without a hand box' WHEN NOT q2 THEN 'no flow between the two frames' WHEN px IS NULL THEN 'ego-motion unavailable' WHEN i % 13 = 0 THEN 'no motion left inside the box: estimate refused' END AS null_reason FROM (SELECT *, i % 10 != 0 AS q2 FROM samples)"))
def v3(spark: SparkSession, d: str) -> DataFrame:
    box = F.when(F.col("width").isNotNull(), F.struct("width"))
    residual = F.when(F.col("i") % 13 == 0, F.col("px") * 0).otherwise(F.col("px"))
    s = speed.speed_sample(box, F.col("i") % 10 != 0, residual, F.lit(0.25), F.lit(None).cast("string"), F.lit(None).cast("string"))
    return samples(spark, d).select("clip_id", "i", s.alias("s")).select("clip_id", "i", F.round("s.px_per_s", 6).alias("px_per_s"), "s.null_reason")


@query("v1_v2_residuals", """WITH p AS (SELECT l_suppkey % 7 AS pair, l_orderkey % 30 AS x, l_partkey % 20 AS y, CASE WHEN l_tax < 0.005 THEN NULL ELSE l_quantity / 10 END AS u, l_discount * 100 AS v FROM lineitem),
z AS (SELECT *, x >= 3 AND x < least(ceil(3 + 10.5 + pair), 30) AND y >= 4 AND y < 12 AS inside FROM p WHERE u IS NOT NULL),
e AS (SELECT pair, CAST(median(u) FILTER (NOT inside) AS FLOAT) AS eu, CAST(median(v) FILTER (NOT inside) AS FLOAT) AS ev FROM z GROUP BY 1)
SELECT pair, round(any_value(eu), 4) AS ego_u, round(any_value(ev), 4) AS ego_v, round(sqrt(avg(pow(u - eu, 2) + pow(v - ev, 2))), 4) AS residual FROM z JOIN e USING (pair) WHERE inside GROUP BY pair""")
def v1(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select((F.col("l_suppkey") % 7).alias("pair"), (F.col("l_orderkey") % 30).alias("x"), (F.col("l_partkey") % 20).alias("y"), F.when(F.col("l_tax") >= 0.005, F.col("l_quantity") / 10).alias("u"), (F.col("l_discount") * 100).alias("v"), F.lit(30).alias("width"), F.lit(20).alias("height"))
    boxes = spark.range(7).select(F.col("id").alias("pair"), F.struct(F.lit(3.0).alias("x"), F.lit(4.0).alias("y"), (10.5 + F.col("id")).alias("width"), F.lit(8.0).alias("height")).alias("box"))
    return speed.residuals(rows, boxes).select("pair", F.round(F.col("ego_u").cast("float"), 4).alias("ego_u"), F.round(F.col("ego_v").cast("float"), 4).alias("ego_v"), F.round("residual", 4).alias("residual"))


@query("v6_identical_frames", "SELECT doc_id, CASE WHEN source IN ('src1', 'src3') THEN 'frames are identical' END AS flow_reason FROM documents")
def v6(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.col("text").cast("binary").alias("first"), F.when(F.col("source").isin("src1", "src3"), F.col("text")).otherwise(F.concat("text", F.lit("."))).cast("binary").alias("second"))
    return speed.identical_frames(rows).select("doc_id", "flow_reason")


# --- exposure ---------------------------------------------------------------------------------------------------------

DUTY = """
du0 AS (SELECT clip_id, duration_s, count(*) AS n, count(v) AS sc, count(*) FILTER (v) AS ex FROM samples JOIN clips USING (clip_id) GROUP BY 1, 2),
du1 AS (SELECT *, CASE WHEN duration_s < 60 THEN 'too_short' WHEN sc = 0 OR (n - sc) / n > 0.10 THEN 'no_labels' ELSE 'ok' END AS status FROM du0),
duty AS (SELECT clip_id, CASE WHEN status = 'ok' THEN ex / sc END AS duty_cycle, sc AS n_frames_scored, ex AS n_frames_exerting, n - sc AS n_frames_excluded, status FROM du1)
"""
SCORE = (
    SPEED.rstrip()
    + ","
    + DUTY.rstrip()
    + """,
j AS (SELECT duty.clip_id, duty_cycle, rms, duty.status AS ds, speed.status AS ss FROM duty JOIN speed USING (clip_id)),
j2 AS (SELECT *, CASE WHEN ds != 'ok' OR rms IS NULL OR ss != 'ok' THEN 'no_input' WHEN duty_cycle = 0 THEN 'zero_duty_cycle' ELSE 'ok' END AS status FROM j),
hal AS (SELECT clip_id, duty_cycle, rms, status, CASE WHEN status = 'ok' THEN round_even(least(10, greatest(0, 10 / (1 + exp(-(-15.87 + 0.02 * duty_cycle * 100 + 2.25 * ln(rms)))))), 1) END AS hal,
  CASE WHEN status = 'ok' THEN NOT (rms BETWEEN 255.3 AND 1288 AND duty_cycle * 100 BETWEEN 11 AND 100) END AS out_of_range FROM j2)
"""
)


@query("e1_duty_cycle", sql(DUTY + "SELECT clip_id, round(duty_cycle, 6) AS duty_cycle, n_frames_scored, n_frames_exerting, n_frames_excluded, status FROM duty"))
def e1(spark: SparkSession, d: str) -> DataFrame:
    return exposure.duty_cycle_estimate(samples(spark, d), clips(spark, d)).withColumn("duty_cycle", F.round("duty_cycle", 6))


@query("e6_hal_speed", sql(SCORE + "SELECT clip_id, hal, round(duty_cycle, 6) AS duty_cycle, round(rms, 6) AS rms_speed_mm_s, out_of_range, status FROM hal"))
def e6(spark: SparkSession, d: str) -> DataFrame:
    c, s = clips(spark, d), samples(spark, d)
    rows = exposure.score_speed_path(exposure.duty_cycle_estimate(s, c), speed.hand_speed_estimate(s, c))
    return rows.select("clip_id", "hal", r6("duty_cycle"), r6("rms_speed_mm_s"), "out_of_range", "status")


@query("e6_hal_spectral", sql(TRANSITIONS.rstrip() + "," + DUTY + """, j AS (SELECT duty.clip_id, duty_cycle, hz, duty.status AS ds, t.status AS ts FROM duty JOIN transitions t USING (clip_id)),
j2 AS (SELECT *, CASE WHEN ds != 'ok' OR hz IS NULL OR ts != 'ok' THEN 'no_input' WHEN duty_cycle = 0 THEN 'zero_duty_cycle' ELSE 'ok' END AS status FROM j)
SELECT clip_id, status, CASE WHEN status = 'ok' THEN round_even(least(10, greatest(0, 6.56 * ln(duty_cycle * 100) * pow(hz, 1.31) / (1 + 3.18 * pow(hz, 1.31)))), 1) END AS hal, CASE WHEN status = 'ok' THEN NOT hz BETWEEN 0.125 AND 1.67 END AS out_of_range FROM j2"""))
def e6b(spark: SparkSession, d: str) -> DataFrame:
    c, s = clips(spark, d), samples(spark, d)
    return exposure.score_spectral_path(exposure.duty_cycle_estimate(s, c), bouts.transition_frequency(s)).select("clip_id", "status", "hal", "out_of_range")


@query("e3_e5_mappings", sql("u AS (SELECT clip_id, 100.0 * count(*) FILTER (v) / count(*) AS i FROM samples GROUP BY 1) SELECT clip_id, round(CASE WHEN i > 0 THEN 6.56 * ln(i) * pow(i / 50.0, 1.31) / (1 + 3.18 * pow(i / 50.0, 1.31)) END, 6) AS radwin, round(CASE WHEN i > 0 THEN 10 / (1 + exp(-(-15.87 + 0.02 * i + 2.25 * ln(i * 15.0)))) END, 6) AS akkas, i / 50.0 BETWEEN 0.125 AND 1.67 AS in_f, i * 15.0 BETWEEN 255.3 AND 1288 AND i BETWEEN 11 AND 100 AS in_s FROM u"))
def e3(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("duty_pct")
    rows = samples(spark, d).groupBy("clip_id").agg((100.0 * F.count_if("v") / F.count(F.lit(1))).alias("duty_pct"))
    return rows.select("clip_id", F.round(C.hal_radwin(i / 50.0, i), 6).alias("radwin"), F.round(C.hal_akkas(i * 15.0, i), 6).alias("akkas"), C.radwin_in_range(i / 50.0).alias("in_f"), C.akkas_in_range(i * 15.0, i).alias("in_s"))


AGREE = """
a0 AS (SELECT clip_id, duration_s, count(*) AS n, count(v) AS sc, count(*) FILTER (v) AS x, count(*) FILTER (i % 2 = 0) AS n2, count(CASE WHEN i % 2 = 0 THEN v END) AS sc2, count(*) FILTER (v AND i % 2 = 0) AS x2 FROM samples JOIN clips USING (clip_id) GROUP BY 1, 2),
pairs AS (SELECT clip_id, x / sc AS a, x2 / sc2 AS b FROM a0 WHERE duration_s >= 60 AND sc > 0 AND sc2 > 0 AND (n - sc) / n <= 0.10 AND (n2 - sc2) / n2 <= 0.10)
"""


def rate_pairs(spark: SparkSession, d: str) -> DataFrame:
    c, s = clips(spark, d), samples(spark, d)
    return exposure.paired_duty_cycles(exposure.duty_cycle_estimate(s, c), exposure.duty_cycle_estimate(s.filter("i % 2 = 0"), c))


@query("e2_agreement", sql(AGREE + "SELECT count(*) AS n_clips, round(avg(abs(a - b)), 6) AS mean_abs, round(max(abs(a - b)), 6) AS max_abs, avg(abs(a - b)) <= 0.02 AS holds FROM pairs"))
def e2(spark: SparkSession, d: str) -> DataFrame:
    return exposure.agreement(rate_pairs(spark, d), K.H1B_MAX).withColumns({c: F.round(c, 6) for c in ("mean_abs", "max_abs")})


@query("a20_compare_rates", sql(AGREE + "SELECT 0 AS n_incomplete, count(*) AS n_clips, round(avg(abs(a - b)), 6) AS mean_abs, CASE WHEN count(*) = 0 THEN 'UNTESTED' WHEN avg(abs(a - b)) <= 0.02 THEN 'HOLDS' ELSE 'FAILED' END AS status FROM pairs"))
def a20(spark: SparkSession, d: str) -> DataFrame:
    c, s = clips(spark, d), samples(spark, d)
    short = gates.completeness(plan.sample_times(c).select("clip_id", "i"), s).filter("state != 'complete'")
    return gates.compare_rates(short, exposure.agreement(rate_pairs(spark, d), K.H1B_MAX)).select("n_incomplete", "n_clips", r6("mean_abs"), "status")


# --- estimation -------------------------------------------------------------------------------------------------------


@query("a1_cluster_sums", sql("SELECT factory_id || '/' || worker_id AS cluster, round(sum(hal), 6) AS s, count(*) AS n FROM observations GROUP BY 1"))
def a1(spark: SparkSession, d: str) -> DataFrame:
    return estimation.cluster_sums(observations(spark, d)).withColumn("s", F.round("s", 6))


@query("a2_cluster_bootstrap")
def a2(spark: SparkSession, d: str) -> DataFrame:
    return estimation.cluster_bootstrap_means(observations(spark, d))


@query("a3_cluster_interval")
def a3(spark: SparkSession, d: str) -> DataFrame:
    return estimation.interval(estimation.cluster_bootstrap_means(observations(spark, d)))


@query("a4_iid_interval")
def a4(spark: SparkSession, d: str) -> DataFrame:
    return estimation.interval(estimation.iid_bootstrap_means(observations(spark, d)))


@query("a5_design_effect")
def a5(spark: SparkSession, d: str) -> DataFrame:
    o = observations(spark, d)
    return estimation.design_effect(estimation.interval(estimation.cluster_bootstrap_means(o)), estimation.interval(estimation.iid_bootstrap_means(o)))


@query("a5_effect_of_intervals", sql("w AS (SELECT factory_id, worker_id, avg(hal) AS m FROM observations GROUP BY 1, 2), c AS (SELECT factory_id, quantile_cont(m, 0.975) - quantile_cont(m, 0.025) AS wc FROM w GROUP BY 1), o AS (SELECT factory_id, quantile_cont(hal, 0.975) - quantile_cont(hal, 0.025) AS wi FROM observations GROUP BY 1) SELECT factory_id, round(pow(wc / wi, 2), 6) AS variance_ratio, round(wc / wi, 6) AS width_ratio FROM c JOIN o USING (factory_id)"))
def a5b(spark: SparkSession, d: str) -> DataFrame:
    o = observations(spark, d)
    spread = lambda rows, value: ranks.exact_quantiles(rows, value, [0.025, 0.975], ["factory_id"]).select("factory_id", F.col("q0").alias("lo"), F.col("q1").alias("hi"))
    workers = o.groupBy("factory_id", "worker_id").agg(F.avg("hal").alias("m"))
    return estimation.design_effect(spread(workers, "m"), spread(o, "hal"), ["factory_id"]).select("factory_id", r6("variance_ratio"), r6("width_ratio"))


@query("a6_kish", sql("SELECT factory_id || '/' || worker_id AS cluster, count(*) AS m, round(1 + (count(*) - 1) * 0.3, 6) AS deff FROM observations GROUP BY 1"))
def a6(spark: SparkSession, d: str) -> DataFrame:
    return estimation.cluster_sums(observations(spark, d)).select("cluster", F.col("n").alias("m"), F.round(C.kish(F.col("n"), F.lit(0.3)), 6).alias("deff"))


@query("a7_variance_components", sql("""w AS (SELECT factory_id, worker_id, avg(hal) AS m FROM observations GROUP BY 1, 2), f AS (SELECT factory_id, avg(m) AS m, var_samp(m) AS wi, count(*) AS n FROM w GROUP BY 1)
SELECT round(var_samp(m), 6) AS between_factory, round(avg(wi) FILTER (n > 1), 6) AS within, round(var_samp(m) / avg(wi) FILTER (n > 1), 6) AS ratio, count(*) AS n_factories, CAST(sum(n) AS BIGINT) AS n_workers, count(*) FILTER (n > 1) AS n2, true AS evaluable, var_samp(m) / avg(wi) FILTER (n > 1) > 1 AS holds FROM f"""))
def a7(spark: SparkSession, d: str) -> DataFrame:
    rows = estimation.variance_components(observations(spark, d))
    return rows.select(r6("between_factory"), r6("between_worker_within_factory", "within"), r6("ratio"), "n_factories", "n_workers", F.col("n_factories_with_two_workers").alias("n2"), "evaluable", "holds")


FLOOR = """
fl0 AS (SELECT factory_id, count(*) AS c, count(DISTINCT worker_id) AS w FROM observations {where} GROUP BY 1),
fl AS (SELECT CAST(sum(c) AS BIGINT) AS n_clips, count(*) AS n_factories, CAST(sum(w) AS BIGINT) AS n_workers, max(w) / sum(w) AS sw, max(c) / sum(c) AS sc FROM fl0)
SELECT n_clips, n_factories, n_workers, round(sw, 6) AS max_factory_share_workers, round(sc, 6) AS max_factory_share_clips,
  concat_ws('; ', CASE WHEN n_factories < 5 THEN n_factories || ' factories, floor is 5' END, CASE WHEN n_workers < 50 THEN n_workers || ' workers, floor is 50' END,
    CASE WHEN sw > 0.4 THEN 'one factory holds ' || CAST(round_even(sw * 100, 0) AS INTEGER) || '% of workers' END, CASE WHEN sc > 0.4 THEN 'one factory holds ' || CAST(round_even(sc * 100, 0) AS INTEGER) || '% of clips' END) AS failures FROM fl
"""


def floor(spark: SparkSession, d: str, where: str) -> DataFrame:
    return estimation.floor_check(observations(spark, d).filter(where)).select("n_clips", "n_factories", "n_workers", r6("max_factory_share_workers"), r6("max_factory_share_clips"), "failures")


@query("a8_floor_check", sql(FLOOR.format(where="")))
def a8(spark: SparkSession, d: str) -> DataFrame:
    return floor(spark, d, "true")


@query("a8_floor_suppressed", sql(FLOOR.format(where="WHERE factory_id < 'factory_004'")))
def a8b(spark: SparkSession, d: str) -> DataFrame:
    return floor(spark, d, "factory_id < 'factory_004'")


@query("a9_aggregate")
def a9(spark: SparkSession, d: str) -> DataFrame:
    return estimation.build_aggregate(observations(spark, d), "corpus")


@query("a10_quantiles", sql("SELECT factory_id, round(quantile_cont(hal, 0.1), 6) AS p10, round(quantile_cont(hal, 0.5), 6) AS p50, round(quantile_cont(hal, 0.9), 6) AS p90 FROM observations GROUP BY 1"))
def a10(spark: SparkSession, d: str) -> DataFrame:
    return estimation.quantiles(observations(spark, d), ["factory_id"]).select("factory_id", r6("p10"), r6("p50"), r6("p90"))


@query("a11_size_terciles", sql("f AS (SELECT factory_id, count(DISTINCT worker_id) AS n_workers FROM observations GROUP BY 1), g AS (SELECT *, row_number() OVER (ORDER BY n_workers, factory_id) - 1 AS r, greatest(count(*) OVER () // 3, 1) AS third FROM f) SELECT factory_id, n_workers, CASE WHEN r < third THEN 'size_tercile_1' WHEN r < 2 * third THEN 'size_tercile_2' ELSE 'size_tercile_3' END AS stratum FROM g"))
def a11(spark: SparkSession, d: str) -> DataFrame:
    return estimation.size_terciles(observations(spark, d))


@query("a9_strata", sql("f AS (SELECT factory_id, count(DISTINCT worker_id) AS n_workers FROM observations GROUP BY 1), g AS (SELECT *, row_number() OVER (ORDER BY n_workers, factory_id) - 1 AS r, greatest(count(*) OVER () // 3, 1) AS third FROM f), t AS (SELECT factory_id, CASE WHEN r < third THEN 'size_tercile_1' WHEN r < 2 * third THEN 'size_tercile_2' ELSE 'size_tercile_3' END AS stratum FROM g) SELECT stratum, count(*) AS n_clips, count(DISTINCT factory_id) AS n_factories, count(DISTINCT factory_id || '/' || worker_id) AS n_workers, round(avg(hal), 6) AS hal_mean FROM observations JOIN t USING (factory_id) GROUP BY 1"))
def a9b(spark: SparkSession, d: str) -> DataFrame:
    o = observations(spark, d)
    rows = o.join(estimation.size_terciles(o).select("factory_id", "stratum"), "factory_id")
    means = rows.groupBy("stratum").agg(F.round(F.avg("hal"), 6).alias("hal_mean"))
    return estimation.floor_check(rows, ["stratum"]).join(means, "stratum").select("stratum", "n_clips", "n_factories", "n_workers", "hal_mean")


# --- gates ------------------------------------------------------------------------------------------------------------


@query("a13_reconcile", sql("o AS (SELECT CAST(count(*) AS DOUBLE) AS clips, CAST(count(DISTINCT factory_id || '/' || worker_id) AS DOUBLE) AS workers, CAST(count(DISTINCT factory_id) AS DOUBLE) AS factories, sum(duration_s) AS duration_s FROM clips), u AS (SELECT 'clips' AS claim, clips AS observed FROM o UNION ALL SELECT 'workers', workers FROM o UNION ALL SELECT 'duration_s', duration_s FROM o), p AS (SELECT 'clips' AS claim, 100.0 AS value, 0.0 AS tol, false AS rel UNION ALL SELECT 'workers', 50.0, 3.0, false UNION ALL SELECT 'duration_s', 15000.0, 0.01, true) SELECT claim, value, observed, abs(observed - value) <= CASE WHEN rel THEN tol * abs(value) ELSE tol END AS ok, CASE WHEN abs(observed - value) > CASE WHEN rel THEN tol * abs(value) ELSE tol END THEN claim || ' differs' END AS mismatch FROM u JOIN p USING (claim)"))
def a13(spark: SparkSession, d: str) -> DataFrame:
    published = spark.createDataFrame([("clips", 100.0, 0.0, False), ("workers", 50.0, 3.0, False), ("factories", None, 0.0, False), ("duration_s", 15000.0, 0.01, True)], "claim string, value double, tolerance double, relative boolean")
    return gates.reconcile(clips(spark, d), published)


@query("a14_manifest_gates", sql("SELECT true AS not_empty, true AS is_unique, min(least(duration_s, fps)) > 0 AS positive, min(factory_id) < max(factory_id) AS several_factories, max(duration_s) >= 60 AS long_enough FROM clips"))
def a14(spark: SparkSession, d: str) -> DataFrame:
    return gates.manifest_gates(clips(spark, d))


PROBES = "probes AS (SELECT clip_id, n AS planned, CASE WHEN k % 20 = 7 THEN 0 ELSE n + 1 - k % 3 END AS frames, k % 20 != 7 AS ok, CASE WHEN k % 20 = 7 THEN 'open failed ' || k % 2 END AS reason FROM clips)"


@query("a15_decode_gate", sql(PROBES + " SELECT count(*) AS clips, CAST(sum(planned) AS BIGINT) AS planned, count(*) FILTER (NOT ok) AS unopened, CAST(sum(CASE WHEN ok THEN greatest(planned - greatest(frames - 1, 0), 0) END) AS BIGINT) AS truncated, round(count(*) FILTER (NOT ok) / count(*), 6) AS open_rate, round(sum(CASE WHEN ok THEN greatest(planned - greatest(frames - 1, 0), 0) END) / sum(planned), 6) AS truncation_rate, coalesce((SELECT string_agg(DISTINCT reason, '; ' ORDER BY reason) FROM probes WHERE NOT ok), '') AS reasons, CASE WHEN count(*) FILTER (NOT ok) / count(*) < 0.01 AND sum(CASE WHEN ok THEN greatest(planned - greatest(frames - 1, 0), 0) END) / sum(planned) < 0.01 THEN 'HOLDS' ELSE 'FAILED' END AS status FROM probes"))
def a15(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    rows = clips(spark, d).select(F.col("n").alias("planned"), F.when(k % 20 == 7, 0).otherwise(F.col("n") + 1 - k % 3).alias("frames"), (k % 20 != 7).alias("ok"), F.when(k % 20 == 7, F.concat(F.lit("open failed "), (k % 2).cast("string"))).alias("reason"))
    return gates.decode_gate(rows).withColumns({c: F.round(c, 6) for c in ("open_rate", "truncation_rate")})


@query("a16_shortfall", sql("SELECT count(*) AS planned, count(*) FILTER (i % 97 = 5) AS missing, round(count(*) FILTER (i % 97 = 5) / count(*), 6) AS rate, CASE WHEN count(*) FILTER (i % 97 = 5) / count(*) <= 0.01 THEN 'HOLDS' ELSE 'FAILED' END AS status FROM samples"))
def a16(spark: SparkSession, d: str) -> DataFrame:
    return gates.shortfall_gate(plan.sample_times(clips(spark, d)), samples(spark, d).filter("i % 97 != 5")).withColumn("rate", F.round("rate", 6))


WRITTEN = "written AS (SELECT CASE WHEN k % 10 = 9 THEN 'unknown/' || clip_id ELSE clip_id END AS clip_id, i, k FROM samples WHERE k % 10 != 8 AND NOT (k % 10 = 7 AND i > 100) UNION ALL SELECT clip_id, i, k FROM samples WHERE k % 10 = 6 AND i < 5)"
STATES = WRITTEN + ", a AS (SELECT clip_id, n AS planned FROM clips), b AS (SELECT clip_id, count(*) AS have FROM written GROUP BY 1), st AS (SELECT coalesce(a.clip_id, b.clip_id) AS clip_id, coalesce(planned, 0) AS planned, coalesce(have, 0) AS have, CASE WHEN planned IS NULL THEN 'unknown' WHEN have IS NULL THEN 'missing' WHEN have < planned THEN 'short' WHEN have > planned THEN 'over' ELSE 'complete' END AS state FROM a FULL JOIN b ON a.clip_id = b.clip_id)"


def written(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    rows = samples(spark, d).select("clip_id", "i", "k")
    main = rows.filter((k % 10 != 8) & ~((k % 10 == 7) & (F.col("i") > 100))).withColumn("clip_id", F.when(k % 10 == 9, F.concat(F.lit("unknown/"), "clip_id")).otherwise(F.col("clip_id")))
    return main.unionByName(rows.filter((k % 10 == 6) & (F.col("i") < 5))).withColumn("corpus_rev", F.when(k % 4 == 0, "b").otherwise("a"))


@query("a17_completeness", sql(STATES + " SELECT * FROM st"))
def a17(spark: SparkSession, d: str) -> DataFrame:
    return gates.completeness(plan.sample_times(clips(spark, d)), written(spark, d))


@query("a17_drop_partial", sql(STATES + " SELECT clip_id, count(*) AS n FROM written WHERE clip_id NOT IN (SELECT clip_id FROM st WHERE state IN ('short', 'over')) GROUP BY 1"))
def a17b(spark: SparkSession, d: str) -> DataFrame:
    return gates.drop_partial_clips(plan.sample_times(clips(spark, d)), written(spark, d)).groupBy("clip_id").agg(F.count(F.lit(1)).alias("n"))


@query("a17_resume_set", sql(STATES + " SELECT clip_id FROM st WHERE state = 'complete'"))
def a17c(spark: SparkSession, d: str) -> DataFrame:
    return gates.resume_set(plan.sample_times(clips(spark, d)), written(spark, d))


@query("a18_verify_labels", sql(STATES + " SELECT count(*) FILTER (state = 'complete') AS n_complete, count(*) FILTER (state = 'short') AS n_short, count(*) FILTER (state = 'over') AS n_over, count(*) FILTER (state = 'missing') AS n_missing, count(*) FILTER (state = 'unknown') AS n_unknown, (SELECT count(DISTINCT CASE WHEN k % 4 = 0 THEN 'b' ELSE 'a' END) FROM written) AS n_revisions, 0 AS unrevised, false AS ok FROM st"))
def a18(spark: SparkSession, d: str) -> DataFrame:
    return gates.verify_labels(plan.sample_times(clips(spark, d)), written(spark, d))


@query("a19_conflict_tally", sql("a AS (SELECT clip_id, i, width IS NOT NULL AS box, i % 50 = 1 AS failed, i % 7 != 3 AS lab, hands FROM samples WHERE i % 11 != 5) SELECT count(*) AS n, count(*) FILTER (failed) AS failed, count(*) FILTER (NOT failed AND NOT lab) AS no_label_row, count(*) FILTER (NOT failed AND lab AND box AND hands IS NULL) AS box_hands_unread, count(*) FILTER (NOT failed AND lab AND box AND hands = 0) AS box_no_hand, count(*) FILTER (NOT failed AND lab AND box AND hands > 0) AS box_agrees, count(*) FILTER (NOT failed AND lab AND NOT box) AS no_box, round(count(*) FILTER (NOT failed AND lab AND box AND coalesce(hands, 0) = 0) / count(*), 6) AS conflict_rate, round(count(*) FILTER (NOT failed AND lab AND box AND hands = 0) / count(*), 6) AS no_hand_rate, false AS covers_the_plan FROM a"))
def a19(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d)
    det = s.filter("i % 11 != 5").select("clip_id", "t_s", F.col("width").isNotNull().cast("int").alias("n_boxes"), (F.col("i") % 50 == 1).alias("failed"))
    return gates.conflict_tally(det, s.filter("i % 7 != 3").select("clip_id", "t_s", "hands"))


@query("j6_semi_speeds", sql(SPEED + "SELECT clip_id, status FROM speed WHERE clip_id IN (SELECT clip_id FROM clips WHERE k % 3 = 1)"))
def j6(spark: SparkSession, d: str) -> DataFrame:
    c = clips(spark, d)
    return speed.hand_speed_estimate(samples(spark, d), c).join(c.filter("k % 3 = 1").select("clip_id"), "clip_id", "left_semi").select("clip_id", "status")


@query("s16_resume_shards", "SELECT DISTINCT s_nationkey AS shard FROM supplier WHERE s_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 9 = 0)")
def s16(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("shard"), "s_suppkey")
    return scans.pending(s.select("shard"), s.filter("s_suppkey % 9 = 0"), "shard")


@query("s3_duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def s3(spark: SparkSession, d: str) -> DataFrame:
    return contracts.unique_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("j10_pair_lag", sql("SELECT clip_id, CAST(i AS INTEGER) AS i, lag(t_s) OVER (PARTITION BY clip_id ORDER BY i) AS before_s FROM samples WHERE i % 3 != 1"))
def j10(spark: SparkSession, d: str) -> DataFrame:
    return samples(spark, d).filter("i % 3 != 1").select("clip_id", "i", F.lag("t_s").over(Window.partitionBy("clip_id").orderBy("i")).alias("before_s"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per clip the activity score with its status, and the corpus row or the reason it is suppressed."""
    c, s = clips(spark, sf_dir), samples(spark, sf_dir)
    scores = exposure.score_speed_path(exposure.duty_cycle_estimate(s, c), speed.hand_speed_estimate(s, c)).join(c.select("clip_id", "factory_id", "worker_id"), "clip_id")
    check = estimation.floor_check(scores.filter("status = 'ok'"))
    rows = scores.select(F.lit("clip").alias("level"), F.col("clip_id").alias("id"), "hal", "status")
    return rows.unionByName(check.select(F.lit("corpus").alias("level"), F.lit("corpus").alias("id"), F.lit(None).cast("double").alias("hal"), F.when(F.col("clears"), "published").otherwise(F.col("failures")).alias("status")))


