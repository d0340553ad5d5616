"""Queries of text gates, gain curves, geometry, releases, probes, contracts, claims and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import columns as C
from ..operators import bouts, chains, contracts, exposure, gain, gates, geometry, masks, preprocess, probe, release, speed, textgates
from ..sources import stores, tar_shards
from .catalog import AGREE, DUTY, QUERIES, SCORE, SETTLED, SPEED, query, r6, rate_pairs
from .fixtures import clips, observations, samples, sql, table

__all__ = ["QUERIES"]

# --- text -------------------------------------------------------------------------------------------------------------


@query("f11_identifier_rows", sql("SELECT clip_id, regexp_matches(clip_id, '(?i)(factory|worker)[_-]?\\d{2,}') AS leaks, regexp_matches(shard, '(?i)(factory|worker)[_-]?\\d{2,}') AS shard_leaks FROM (SELECT clip_id, 'FACTORY' || (k % 120) AS shard FROM clips)"))
def f11(spark: SparkSession, d: str) -> DataFrame:
    return clips(spark, d).select("clip_id", C.has_identifier(F.col("clip_id")).alias("leaks"), C.has_identifier(F.concat(F.lit("FACTORY"), (F.col("k") % 120).cast("string"))).alias("shard_leaks"))


@query("f12_placeholders", "WITH d AS (SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN text || chr(10) || 'see TODO here' ELSE text END AS text FROM documents), l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM d) SELECT doc_id, CAST(n AS INTEGER) AS n, line FROM l WHERE regexp_matches(line, '\\b(TBD|TODO|FIXME|XXX)\\b')")
def f12(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 10 == 3, F.concat("text", F.lit("\nsee TODO here"))).otherwise(F.col("text")).alias("text"))
    return textgates.placeholders(docs, "doc_id", "text")


@query("f13_cited_paths", "WITH d AS (SELECT doc_id, 'see `docs/' || doc_id % 7 || '.md` and `other/x` and `src/' || doc_id % 3 || '.py`' AS text FROM documents), p AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '`((?:docs|src)/[^`\\s]+)`', 1)) AS path FROM d) SELECT doc_id, path FROM p WHERE path NOT IN ('docs/3.md', 'src/1.py')")
def f13(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("see `docs/"), (i % 7).cast("string"), F.lit(".md` and `other/x` and `src/"), (i % 3).cast("string"), F.lit(".py`")).alias("text"))
    return textgates.cited_paths(docs, "doc_id", "text", ["docs", "src"], spark.createDataFrame([("docs/3.md",), ("src/1.py",)], "path string"))


@query("f14_frozen_hashes", "SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN doc_id % 5 = 0 THEN 'missing' ELSE 'changed' END AS state FROM documents WHERE doc_id % 5 = 0 OR doc_id % 7 = 0")
def f14(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    files = docs.filter("doc_id % 5 != 0").select(F.col("doc_id").cast("string").alias("path"), F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("content"))
    return textgates.frozen(files, docs.select(F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("sha256")))


@query("f15_amendments", "SELECT doc_id, sentence, change FROM (SELECT doc_id, 'Kept one. Gone' || doc_id || '! Kept two?' AS a, doc_id AS i FROM documents) JOIN (SELECT doc_id, 'removed' AS change, 'Gone' || doc_id || '!' AS sentence FROM documents UNION ALL SELECT doc_id, 'added', 'New.' FROM documents WHERE doc_id % 2 = 0) USING (doc_id)")
def f15(spark: SparkSession, d: str) -> DataFrame:
    docs, i = table(spark, d, "documents"), F.col("doc_id").cast("string")
    old = docs.select("doc_id", F.concat(F.lit("Kept one. Gone"), i, F.lit("! Kept two?")).alias("text"))
    new = docs.select("doc_id", F.concat(F.lit("Kept  one.\nKept two?"), F.when(F.col("doc_id") % 2 == 0, " New.").otherwise("")).alias("text"))
    return textgates.amended(old, new, "doc_id", "text")


UNWRAP = """
d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '# Title' || chr(10) || '- item' || chr(10) || text || chr(10) || '```' || chr(10) || ' code  ' || chr(10) || chr(10) || '```' || chr(10) || '> q' ELSE text END AS text FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM d),
a AS (SELECT *, regexp_matches(line, '^```') AS fence FROM l),
b AS (SELECT *, (sum(CAST(fence AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY n) - CAST(fence AS INTEGER)) % 2 = 1 AS in_fence FROM a),
c AS (SELECT *, CASE WHEN fence OR in_fence THEN 'verbatim' WHEN trim(regexp_replace(line, '\\s', ' ', 'g')) = '' THEN 'blank' WHEN regexp_matches(line, '^#{1,6}\\s') OR regexp_matches(line, '^\\s*\\|') THEN 'single' WHEN regexp_matches(line, '^\\s*(?:[-*+]\\s|\\d+\\.\\s)') OR regexp_matches(line, '^\\s*>') THEN 'item' ELSE 'prose' END AS kind FROM b),
e AS (SELECT *, sum(CASE WHEN kind = 'prose' AND coalesce(lag_kind IN ('prose', 'item'), false) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY n) AS block FROM (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY n) AS lag_kind FROM c)),
f AS (SELECT doc_id, block, string_agg(CASE kind WHEN 'verbatim' THEN line WHEN 'blank' THEN '' WHEN 'single' THEN regexp_replace(line, '\\s+$', '') ELSE regexp_replace(line, '^\\s+|\\s+$', '', 'g') END, ' ' ORDER BY n) AS joined FROM e GROUP BY 1, 2)
SELECT doc_id, md5(regexp_replace(regexp_replace(string_agg(joined, chr(10) ORDER BY block), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') || chr(10)) AS body FROM f GROUP BY 1
"""


def wrapped(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("# Title\n- item\n"), "text", F.lit("\n```\n code  \n\n```\n> q"))).otherwise(F.col("text")).alias("text"))


@query("x6_unwrap", "WITH " + UNWRAP.strip())
def x6(spark: SparkSession, d: str) -> DataFrame:
    return textgates.unwrap(wrapped(spark, d), "doc_id", "text").select("doc_id", F.md5("body").alias("body"))


@query("x6_strip_title", "SELECT doc_id, md5(CASE WHEN doc_id % 3 = 0 THEN '- item' || chr(10) || text || chr(10) || '```' || chr(10) || ' code  ' || chr(10) || chr(10) || '```' || chr(10) || '> q' WHEN starts_with(text, '# ') THEN NULL ELSE text END) AS body FROM documents")
def x6b(spark: SparkSession, d: str) -> DataFrame:
    return textgates.strip_title(wrapped(spark, d), "doc_id", "text").select("doc_id", F.md5("body").alias("body"))


@query("s15_known_gaps", "SELECT CAST(s_suppkey AS INTEGER) AS n, 'Gap ' || s_suppkey AS gap FROM supplier WHERE s_suppkey % 4 IN (0, 1)")
def s15(spark: SparkSession, d: str) -> DataFrame:
    k, name = F.col("s_suppkey"), F.concat(F.lit("Gap "), F.col("s_suppkey").cast("string"))
    line = F.when(k % 4 == 0, F.concat(F.lit("| **"), name, F.lit("** | x | **Unobservable** in video |"))).when(k % 4 == 1, F.concat(F.lit("| **"), name, F.lit("** | w | see | **Partly Unobservable** |")))
    line = line.when(k % 4 == 2, F.concat(F.lit("| **"), name, F.lit("** | y | **Observed** |"))).otherwise(F.lit("| Unobservable | z | **no** |"))
    return gates.known_gaps(table(spark, d, "supplier").select(k.cast("int").alias("n"), line.alias("line")))


# --- gain curves ------------------------------------------------------------------------------------------------------

SWEEP_SQL = "sweep AS (SELECT CAST(480 + l_suppkey AS INTEGER) AS width, CAST(l_quantity AS DOUBLE) * 3 + l_linenumber / 8.0 AS hand_displacement_px, 1.0 - CAST(l_quantity AS DOUBLE) / 60 - CAST(l_tax AS DOUBLE) * 2 AS gain FROM lineitem)"
CURVES = SWEEP_SQL + ", a AS (SELECT width, min(hand_displacement_px) FILTER (gain < 0.50) AS collapse_px, min(hand_displacement_px) AS least_px, max(hand_displacement_px) AS most_px, median(gain) FILTER (gain < 0.50 AND gain >= 0.5 * 0.18) AS floor_gain FROM sweep GROUP BY 1), k AS (SELECT width, max(hand_displacement_px) FILTER (gain >= 0.90 AND (collapse_px IS NULL OR hand_displacement_px < collapse_px)) AS knee_px FROM sweep JOIN a USING (width) GROUP BY 1), curves AS (SELECT a.*, knee_px, coalesce(abs(floor_gain - 0.18) <= 0.25 * 0.18, false) AS tracks_background FROM a JOIN k USING (width))"


def sweep(spark: SparkSession, d: str) -> DataFrame:
    """A curve for each supplier, a point for each of its lines."""
    q = F.col("l_quantity").cast("double")
    return table(spark, d, "lineitem").select((480 + F.col("l_suppkey")).cast("int").alias("width"), (q * 3 + F.col("l_linenumber") / 8.0).alias("hand_displacement_px"), (1.0 - q / 60 - F.col("l_tax").cast("double") * 2).alias("gain"))


@query("g9_gain_curves", "WITH " + CURVES + " SELECT * FROM curves")
def g9(spark: SparkSession, d: str) -> DataFrame:
    return gain.curve_from_rows(sweep(spark, d), geometry.DEPTH_RATIO, ["width"])


@query("g10_verdicts", "WITH " + CURVES + " SELECT width, x, CASE WHEN x < least_px OR x > most_px THEN 'UNTESTED' WHEN knee_px IS NULL THEN 'FAIL' WHEN x <= knee_px THEN 'PASS' ELSE 'FAIL' END AS verdict FROM curves, (SELECT unnest(range(1, 400, 3)) AS x)")
def g10(spark: SparkSession, d: str) -> DataFrame:
    points = spark.range(1, 400, 3).select(F.col("id").alias("x"))
    return gain.curve_from_rows(sweep(spark, d), geometry.DEPTH_RATIO, ["width"]).join(F.broadcast(points)).select("width", "x", gain.verdict(F.col("x")).alias("verdict"))


# --- geometry ---------------------------------------------------------------------------------------------------------

_K = geometry.CORPUS.k
THETA = f"(t * (1 + t*t * ({_K[0]} + t*t * ({_K[1]} + t*t * ({_K[2]} + t*t * ({_K[3]}))))))"


@query("g2_image_circle", f"WITH g AS (SELECT i * pi() / 2 / 20000 AS t FROM (SELECT unnest(range(20001)) AS i)), h AS (SELECT t, CAST({THETA} AS DOUBLE) AS d FROM g) SELECT round(arg_max(t, d), 6) AS max_theta, round(max(d) * CAST(1030.587009 AS DOUBLE), 4) AS image_circle_radius_px FROM h")
def g2(spark: SparkSession, d: str) -> DataFrame:
    return geometry.max_theta_sql(spark, geometry.CORPUS).select(r6("max_theta"), F.round("image_circle_radius_px", 4).alias("image_circle_radius_px"))


@query("g1_project", f"WITH p AS (SELECT l_orderkey AS k, l_linenumber AS i, (l_partkey % 20 - 10) / 10.0 AS x, (l_suppkey % 13 - 6) / 8.0 AS y, 1 + l_linenumber / 2.0 AS z FROM lineitem), r AS (SELECT *, sqrt(pow(x / z, 2) + pow(y / z, 2)) AS r, atan(sqrt(pow(x / z, 2) + pow(y / z, 2))) AS t FROM p), s AS (SELECT *, CASE WHEN r < 1e-12 THEN 1.0 ELSE {THETA} / r END AS s FROM r) SELECT k, i, round(1030.587009 * s * x / z + 966.691189, 4) AS u, round(1032.815725 * s * y / z + 539.687801, 4) AS v FROM s")
def g1(spark: SparkSession, d: str) -> DataFrame:
    """A point for each line."""
    points = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i"), ((F.col("l_partkey") % 20 - 10) / 10.0).alias("px"), ((F.col("l_suppkey") % 13 - 6) / 8.0).alias("py"), (1 + F.col("l_linenumber") / 2.0).alias("pz"))
    return geometry.project(points, geometry.CORPUS).select("k", "i", F.round("pu", 4).alias("u"), F.round("pv", 4).alias("v"))


@query("g5_analytic_flow")
def g5(spark: SparkSession, d: str) -> DataFrame:
    return geometry.analytic_flow(spark, geometry.scaled(geometry.CORPUS, 480), translation=(0.01, 0.0, 0.0))


@query("g7_motion_floor")
def g7(spark: SparkSession, d: str) -> DataFrame:
    small = geometry.scaled(geometry.CORPUS, 480)
    return geometry.floor_mm_s(spark, small, 10.0).unionByName(geometry.floor_mm_s(spark, small, 0.0, 0.1))


@query("g7_speed_budget", "SELECT s, round(s - exp((ln(h / (10 - h)) + 15.87 - 0.02 * 68) / 2.25), 4) AS budget FROM (SELECT s, 10 / (1 + exp(-(-15.87 + 0.02 * 68 + 2.25 * ln(s)))) - 0.25 AS h FROM (VALUES (400.0), (612.4), (800.0)) AS t(s))")
def g7b(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(400.0,), (612.4,), (800.0,)], "s double").select("s", F.round(geometry.speed_budget(F.col("s")), 4).alias("budget"))


# --- releases ---------------------------------------------------------------------------------------------------------


@query("x1_gain_rows", "WITH " + SWEEP_SQL + " SELECT 'farneback' AS estimator, width, width * 9 // 16 AS height, hand_displacement_px, gain, false AS flow_returned_none, round(hand_displacement_px / (width / 10.0), 4) AS displacement_per_box FROM sweep")
def x1(spark: SparkSession, d: str) -> DataFrame:
    rows = sweep(spark, d).groupBy("width").agg(F.collect_list(F.struct("hand_displacement_px", "gain", F.lit(False).alias("flow_returned_none"))).alias("rows"))
    scales = rows.select(F.array("width", (F.col("width") * 9 / 16).cast("int")).alias("frame_size"), (F.col("width") / 10).alias("hand_box_width_px"), "rows")
    return release.gain_rows(scales.select(F.lit("farneback").alias("estimator"), F.array(F.struct("frame_size", "hand_box_width_px", "rows")).alias("scales")))  # a result for each frame size


@query("x2_benchmark_rows", sql("SELECT 'arm' || k % 5 AS arm, count(*) / 60.0 AS pairs_per_s, CASE WHEN k % 5 != 0 THEN round((count(width) - count(px)) / count(width), 6) END AS flow_null_rate FROM samples GROUP BY k % 5"))
def x2(spark: SparkSession, d: str) -> DataFrame:
    arm = F.concat(F.lit("arm"), (F.col("k") % 5).cast("string"))
    told = samples(spark, d).groupBy(arm.alias("arm")).agg((F.count(F.lit(1)) / 60.0).alias("pairs_per_s"), F.round((F.count("width") - F.count("px")) / F.count("width"), 6).alias("flow_null_rate"))
    pilot = F.create_map(F.lit("pairs_per_s"), "pairs_per_s", F.lit("pilot"), F.lit(1.0))  # a field that is not listed, and an arm that lacks one that is
    fields = F.when(F.col("arm") == "arm0", pilot).otherwise(F.map_concat(pilot, F.create_map(F.lit("flow_null_rate"), "flow_null_rate")))
    arms = told.select("arm", fields.alias("f")).agg(F.map_from_entries(F.collect_list(F.struct("arm", "f"))).alias("arms"))  # five arms
    return release.benchmark_rows(arms, ["pairs_per_s", "flow_null_rate"])


@query("x3_floor_rows", "SELECT 'rotation' AS series, CAST(s_nationkey AS DOUBLE) AS rotation_deg_per_s, 0.0 AS translation_m_per_s, s_acctbal AS floor_mm_s FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT 'translation', 0.0, CAST(s_nationkey AS DOUBLE), s_acctbal FROM supplier WHERE s_suppkey % 3 = 1 UNION ALL SELECT 'narrow_control', CAST(s_nationkey AS DOUBLE), 0.0, s_acctbal FROM supplier WHERE s_suppkey % 3 = 2")
def x3(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").cast("double").alias("m"), F.col("s_acctbal").alias("floor_mm_s"))
    part = lambda k, name: s.filter(F.col("s_suppkey") % 3 == k).select(F.col("m").alias(name), "floor_mm_s")
    return release.floor_rows(part(0, "rotation_deg_per_s"), part(1, "translation_m_per_s"), part(2, "rotation_deg_per_s"))


@query("x5_quiver_points", "WITH f AS (SELECT o_custkey % 64 AS x, o_orderkey % 64 AS y, count(*) / 7.0 + max(o_custkey) AS u FROM orders GROUP BY 1, 2) SELECT x, y, u FROM f WHERE (x + y) % 17 != 0 AND ((x % 16 = 0 AND y % 16 = 0) OR (x % 4 = 0 AND y % 4 = 0 AND x BETWEEN 10 AND 40 AND y BETWEEN 8 AND 30))")
def x5(spark: SparkSession, d: str) -> DataFrame:
    x, y = F.col("o_custkey") % 64, F.col("o_orderkey") % 64
    flow = table(spark, d, "orders").groupBy(x.alias("x"), y.alias("y")).agg((F.count(F.lit(1)) / 7.0 + F.max("o_custkey")).alias("w"))
    flow = flow.select("x", "y", F.when((F.col("x") + F.col("y")) % 17 != 0, F.col("w")).alias("u"), F.lit(1.0).alias("v"))
    return release.quiver_points(flow, 16, 4, (10, 8, 40, 30)).select("x", "y", "u")


@query("x9_payload", "SELECT s_suppkey AS k, json_extract(j, '$.a') IS NOT NULL AS has_a FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN '{}' ELSE '{\"a\":1}' END AS j FROM supplier)")
def x9(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.when(F.col("s_suppkey") % 4 == 0, F.lit(float("nan"))).otherwise(1.0).alias("a"))
    return release.payload(rows).select(F.get_json_object("json", "$.k").cast("long").alias("k"), F.get_json_object("json", "$.a").isNotNull().alias("has_a"))


# --- probes -----------------------------------------------------------------------------------------------------------


def probe_rows(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    features = e.select(F.col("vec_id").alias("frame_id"), F.col("embedding").alias("features"))
    labels = e.select(F.col("vec_id").alias("frame_id"), (F.col("label") < 5).alias("manipulation"), F.when(F.col("vec_id") % 10 == 0, "unreadable").otherwise("ok").alias("status"))
    return probe.training_set(features, labels)


@query("s13_training_set", "SELECT vec_id AS frame_id, len(embedding) AS width, CAST(label < 5 AS INTEGER) AS y FROM embeddings WHERE vec_id % 10 != 0")
def s13(spark: SparkSession, d: str) -> DataFrame:
    return probe_rows(spark, d).select("frame_id", F.size("features").cast("long").alias("width"), "y")


@query("m2_folds", "SELECT vec_id AS frame_id, (row_number() OVER (PARTITION BY label < 5 ORDER BY vec_id) - 1) % 5 AS fold FROM embeddings WHERE vec_id % 10 != 0")
def m2f(spark: SparkSession, d: str) -> DataFrame:
    return probe.folds(probe_rows(spark, d)).select("frame_id", F.col("fold").cast("long").alias("fold"))


@query("m2_fidelity_metrics", "WITH p AS (SELECT CAST(label < 5 AS INTEGER) AS y, CAST(embedding[1] > 0 AS INTEGER) AS p FROM embeddings) SELECT count(*) AS n, round(avg(CAST(y = p AS INTEGER)), 6) AS accuracy, round(greatest(avg(y), 1 - avg(y)), 6) AS majority, round((avg(p) FILTER (y = 1) + avg(1 - p) FILTER (y = 0)) / 2, 6) AS balanced_accuracy, round(avg(y), 6) AS prevalence, round(avg(p), 6) AS predicted_prevalence FROM p")
def m2(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select((F.col("label") < 5).cast("int").alias("y"), (F.col("embedding")[0] > 0).cast("int").alias("predicted"))
    return probe.fidelity(rows).select("n", *(r6(c) for c in ("accuracy", "majority", "balanced_accuracy", "prevalence", "predicted_prevalence")))


@query("m1_cross_validated_probe")
def m1(spark: SparkSession, d: str) -> DataFrame:
    rows = probe_rows(spark, d)
    return probe.beats_majority(probe.cross_validated_fidelity(rows, len(rows.first().features)))


@query("m3_linear_scores", "SELECT vec_id, round(0.5 + list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) * 0.25, 4) AS score FROM embeddings")
def m3(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    n = len(e.first().embedding)
    return e.select("vec_id", F.round(probe.logit(F.col("embedding").cast("array<double>"), [0.25] * n, 0.5), 4).alias("score"))


@query("m7_detector_stats", sql("SELECT count(*) AS n, round(count(*) / 10.0, 6) AS frames_per_s, round(count(width) / count(*), 6) AS box_coverage, quantile_cont(width, 0.1) AS p10, quantile_cont(width, 0.5) AS p50, quantile_cont(width, 0.9) AS p90, max(width) AS p100, round(1e6 / (count(*) / 10.0) / 3600, 6) AS projected_hours, false AS no_box FROM samples"))
def m7(spark: SparkSession, d: str) -> DataFrame:
    rows = probe.detector_stats(samples(spark, d), 10.0, 1_000_000)
    return rows.withColumns({c: F.round(c, 6) for c in ("frames_per_s", "box_coverage", "projected_hours")})


# --- contracts and claims ---------------------------------------------------------------------------------------------


@query("f10_clip_ref_violations", sql("SELECT clip_id, concat_ws('; ', CASE WHEN k % 7 = 0 THEN 'byte range' END, CASE WHEN k % 5 = 0 THEN 'positive rate' END, CASE WHEN k % 11 = 0 THEN 'revision' END) AS broken FROM clips"))
def f10(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    rows = clips(spark, d).withColumns({"byte_start": k * 10, "byte_end": F.when(k % 7 == 0, k * 10).otherwise(k * 10 + 5), "fps": F.when(k % 5 == 0, 0.0).otherwise(30.0), "width": F.lit(1920), "height": F.lit(1080), "corpus_rev": F.when(k % 11 != 0, "r1")})
    return contracts.violations(rows, "clip_ref").select("clip_id", F.array_join("violations", "; ").alias("broken"))


@query("f10_segment_violations", sql(SETTLED + "SELECT clip_id, start_s, CASE WHEN end_s - start_s < 0.5 THEN 'length' ELSE '' END AS broken FROM segments"))
def f10b(spark: SparkSession, d: str) -> DataFrame:
    rows = bouts.exertion_segments(bouts.debounce(bouts.runs(samples(spark, d)))).withColumn("min_duration_s", F.lit(0.5))
    return contracts.violations(rows, "exertion_segment").select("clip_id", "start_s", F.array_join("violations", "; ").alias("broken"))


@query("f10_duty_violations", sql(DUTY + "SELECT clip_id, CASE WHEN status = 'ok' AND n_frames_excluded > 0.1 * (n_frames_scored + n_frames_excluded) THEN 'excluded' ELSE '' END AS broken FROM duty"))
def f10c(spark: SparkSession, d: str) -> DataFrame:
    return contracts.violations(exposure.duty_cycle_estimate(samples(spark, d), clips(spark, d)), "duty_cycle").select("clip_id", F.array_join("violations", "; ").alias("broken"))


@query("f10_speed_violations", sql(SPEED + "SELECT clip_id, CASE WHEN n_samples < n_with_box THEN 'counts' ELSE '' END AS broken FROM speed"))
def f10d(spark: SparkSession, d: str) -> DataFrame:
    return contracts.violations(speed.hand_speed_estimate(samples(spark, d), clips(spark, d)), "hand_speed").select("clip_id", F.array_join("violations", "; ").alias("broken"))


@query("f10_hal_violations", sql(SCORE + "SELECT clip_id, CASE WHEN hal NOT BETWEEN 0 AND 10 THEN 'bounds' ELSE '' END AS broken FROM hal WHERE NOT (status = 'no_input' AND coalesce(duty_cycle = 0, false))"))
def f10e(spark: SparkSession, d: str) -> DataFrame:
    c, s = clips(spark, d), samples(spark, d)
    rows = exposure.score_speed_path(exposure.duty_cycle_estimate(s, c), speed.hand_speed_estimate(s, c)).withColumn("force_axis", F.lit(None).cast("double"))
    return contracts.violations(rows.filter("not (status = 'no_input' and coalesce(duty_cycle = 0, false))"), "hal").select("clip_id", F.array_join("violations", "; ").alias("broken"))


@query("c1_roll_up", "WITH p AS (SELECT s_nationkey AS parent, CASE s_suppkey % 7 WHEN 0 THEN 'FAILED' WHEN 1 THEN NULL ELSE 'HOLDS' END AS status FROM supplier) SELECT parent, CASE WHEN bool_or(coalesce(status = 'FAILED', false)) THEN 'FAILED' WHEN bool_and(coalesce(status = 'HOLDS', false)) THEN 'HOLDS' ELSE 'UNTESTED' END AS status FROM p GROUP BY 1")
def c1(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey") % 7
    return gates.roll_up_claims(table(spark, d, "supplier").select(F.col("s_nationkey").alias("parent"), F.when(k == 0, "FAILED").when(k != 1, "HOLDS").alias("status")))


@query("s14_read_claims", "SELECT s_suppkey AS claim_id, CASE WHEN s_suppkey % 3 = 0 THEN 'HOLDS' ELSE 'UNTESTED' END AS status, CASE WHEN s_suppkey % 3 = 0 AND s_suppkey % 2 = 0 THEN s_acctbal END AS lo FROM supplier")
def s14(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    claims = s.select(F.col("s_suppkey").alias("claim_id"), F.col("s_name").alias("statement"), (F.col("s_suppkey") % 2 == 1).alias("pilot_gate"))
    results = s.filter("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("claim_id"), F.lit("HOLDS").alias("status"), F.col("s_acctbal").alias("lo"), (F.col("s_acctbal") + 1).alias("hi"))
    return gates.read_claims(claims, results).select("claim_id", "status", "lo")


@query("c2_card", "SELECT count(*) FILTER (s_suppkey % 3 != 0) AS n_untested, count(*) AS n_claims, 1 AS n_gaps, 'UNVERIFIED' AS verdict FROM supplier")
def c2(spark: SparkSession, d: str) -> DataFrame:
    return gates.build_card(s14(spark, d), spark.createDataFrame([("Force",)], "gap string"))


@query("c3_arms", "WITH a AS (SELECT s_nationkey, min(s_acctbal) > -500 AS measured FROM supplier GROUP BY 1) SELECT min(CAST(measured AS INTEGER)) = 1 AS decided, count(*) AS n_arms FROM a")
def c3(spark: SparkSession, d: str) -> DataFrame:
    arms = table(spark, d, "supplier").groupBy(F.col("s_nationkey").cast("string").alias("arm")).agg((F.min("s_acctbal") > -500).alias("measured"))
    return gates.arms_decided(arms)


@query("e2_duty_pairs", sql(AGREE + "SELECT clip_id, round(a, 6) AS a, round(b, 6) AS b FROM pairs"))
def e2b(spark: SparkSession, d: str) -> DataFrame:
    return rate_pairs(spark, d).select("clip_id", r6("a"), r6("b"))


@query("x_observation_means", sql("SELECT factory_id, count(*) AS n, round(avg(hal), 6) AS hal FROM observations GROUP BY 1"))
def xo(spark: SparkSession, d: str) -> DataFrame:
    return observations(spark, d).groupBy("factory_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("hal"), 6).alias("hal"))


# --- sources ----------------------------------------------------------------------------------------------------------


@query("s2_clip_records", sql("""m AS (SELECT *, k % 7 != 0 AS side, k % 11 != 0 AS media, k % 13 = 0 AS big FROM clips)
SELECT factory_id, worker_id, clip_index, factory_id || '/' || worker_id || '.tar' AS shard, k * 4096 AS byte_start, k * 4096 + 100 + k % 900 AS byte_end, duration_s, fps, 1920 AS width, 1080 AS height, 'h265' AS codec FROM m WHERE side AND media AND NOT big"""))
def s2(spark: SparkSession, d: str) -> DataFrame:
    return tar_shards.clip_records(members(spark, d))[0]


@query("s2_left_out", sql("""m AS (SELECT *, factory_id || '/' || worker_id || '.tar' AS shard, k % 7 != 0 AS side, k % 11 != 0 AS media, k % 13 = 0 AS big FROM clips WHERE k % 7 != 0 OR k % 11 != 0)
SELECT shard, count(*) FILTER (NOT side) AS orphan_media, count(*) FILTER (NOT media) AS orphan_sidecars, count(*) FILTER (side AND big) AS oversized FROM m GROUP BY 1"""))
def s2_left(spark: SparkSession, d: str) -> DataFrame:
    return tar_shards.clip_records(members(spark, d))[1].drop("error")


def members(spark: SparkSession, d: str) -> DataFrame:
    """Clips as members of their workers' shards: a sidecar and its media, some without the one or the other, some sidecars too large."""
    c = clips(spark, d)
    k, shard, stem = F.col("k"), F.concat_ws("/", "factory_id", F.concat("worker_id", F.lit(".tar"))), F.format_string("v%06d", "k")
    content = F.to_json(F.struct("factory_id", "worker_id", F.col("clip_index").alias("video_index"), F.col("duration_s").alias("duration_sec"), "fps", F.lit(1920).alias("width"), F.lit(1080).alias("height"), F.lit("h265").alias("codec")))
    none = F.lit(None).cast("string")
    side = c.filter("k % 7 != 0").select(shard.alias("shard"), F.concat(stem, F.lit(".json")).alias("name"), (k * 4096 - 512).alias("offset"), F.when(k % 13 == 0, 20_000).otherwise(F.length(content)).cast("long").alias("size"), F.when(k % 13 != 0, content).alias("content"), none.alias("error"))
    media = c.filter("k % 11 != 0").select(shard.alias("shard"), F.concat(stem, F.lit(".mp4")).alias("name"), (k * 4096).alias("offset"), (100 + k % 900).cast("long").alias("size"), none.alias("content"), none.alias("error"))
    return side.unionByName(media)


@query("s6_factory_ids", sql("SELECT DISTINCT factory_id FROM clips"))
def s6(spark: SparkSession, d: str) -> DataFrame:
    return tar_shards.factory_ids(clips(spark, d).select(F.concat_ws("/", "factory_id", F.concat("worker_id", F.lit(".tar"))).alias("path")))


@query("s10_detection_store", sql("SELECT clip_id, t_s, CASE WHEN width IS NULL THEN 0 ELSE 1 END AS n_boxes, width AS box_width, CASE WHEN i % 50 = 7 THEN 'decode failed' END AS failed_reason FROM samples"))
def s10(spark: SparkSession, d: str) -> DataFrame:
    box = F.struct(F.lit(1.0).alias("x"), F.lit(2.0).alias("y"), F.col("width").cast("double").alias("width"), F.lit(80.0).alias("height"), F.lit(0.9).alias("score"))
    rows = samples(spark, d).select("clip_id", "t_s", F.lit(K.MASK_SOURCES[0]).alias("mask_source"), F.when(F.col("width").isNull(), F.array().cast("array<struct<x:double,y:double,width:double,height:double,score:double>>")).otherwise(F.array(box)).alias("boxes"), F.when(F.col("i") % 50 == 7, F.lit("decode failed")).alias("failed_reason"))
    stores.write_jsonl(rows, path := stores.scratch_folder(spark))
    return stores.read_detections(spark, path).select("clip_id", "t_s", F.size("boxes").alias("n_boxes"), F.try_element_at("boxes", F.lit(1)).getField("width").alias("box_width"), "failed_reason")


@query("s11_label_store", sql("SELECT clip_id, t_s, v AS manipulation, CAST(hands AS INTEGER) AS hands_visible, CASE WHEN v IS NULL THEN 'unreadable' END AS unreadable_reason, 4.0 AS fps_sampled FROM samples"))
def s11(spark: SparkSession, d: str) -> DataFrame:
    rows = samples(spark, d).select("clip_id", "t_s", F.lit("r1").alias("corpus_rev"), F.lit(4.0).alias("fps_sampled"), F.lit("model").alias("label_source"), F.lit("v1").alias("label_rev"), F.lit("plain").alias("prompt_variant"), F.col("v").alias("manipulation"), F.col("hands").alias("hands_visible"), F.when(F.col("v").isNull(), F.lit("unreadable")).alias("unreadable_reason"))
    stores.write_jsonl(rows, path := stores.scratch_folder(spark))
    return stores.read_labels(spark, path).select("clip_id", "t_s", "manipulation", "hands_visible", "unreadable_reason", "fps_sampled")


@query("s12_manifest", sql("SELECT clip_id, factory_id, worker_id, clip_index, 'r1' AS corpus_rev, duration_s, fps FROM clips WHERE k % 7 != 0 AND k % 11 != 0 AND k % 13 != 0"))
def s12(spark: SparkSession, d: str) -> DataFrame:
    stores.write_jsonl(tar_shards.clip_records(members(spark, d))[0], path := stores.scratch_folder(spark))
    return tar_shards.clip_refs(stores.read_jsonl(spark, path, stores.MANIFEST), "r1").select("clip_id", "factory_id", "worker_id", "clip_index", "corpus_rev", "duration_s", "fps")


@query("s3_clip_refs", sql("SELECT clip_id, corpus_rev FROM (SELECT clip_id, 'r1' AS corpus_rev FROM clips)"))
def s3_refs(spark: SparkSession, d: str) -> DataFrame:
    return tar_shards.clip_refs(clips(spark, d).drop("clip_id"), "r1").select("clip_id", "corpus_rev")


# --- chains of versions -----------------------------------------------------------------------------------------------

VERSIONS = """
o AS (SELECT o_custkey AS document, o_orderkey AS version, lag(o_orderkey) OVER w AS before, lag(o_orderkey, 2) OVER w AS before2, lead(o_orderkey) OVER w AS next FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
v AS (SELECT document, version, CASE version % 23 WHEN 5 THEN before2 WHEN 7 THEN coalesce(next, before) WHEN 11 THEN -1 WHEN 13 THEN NULL ELSE before END AS prior FROM o)
"""


def versions(spark: SparkSession, d: str) -> DataFrame:
    """A customer's orders as versions that amend one another; some skip one, point forwards, name an unknown one or none."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("document"), F.col("o_orderkey").alias("version"), F.lag("o_orderkey").over(w).alias("before"), F.lag("o_orderkey", 2).over(w).alias("before2"), F.lead("o_orderkey").over(w).alias("next"))
    kind = F.col("version") % 23
    prior = F.when(kind == 5, F.col("before2")).when(kind == 7, F.coalesce("next", "before")).when(kind == 11, F.lit(-1)).when(kind == 13, F.lit(None)).otherwise(F.col("before"))
    return o.select("document", "version", prior.alias("prior"))


@query("f15_amendment_chain", "WITH RECURSIVE" + VERSIONS.rstrip() + """,
r AS (SELECT document, min(version) AS version, 0 AS steps FROM v WHERE prior IS NULL GROUP BY 1 UNION ALL SELECT v.document, v.version, r.steps + 1 FROM r JOIN v ON v.document = r.document AND v.prior = r.version),
p AS (SELECT v.*, r.steps, CASE WHEN v.prior IS NULL AND r.steps IS NULL THEN 'second root' WHEN v.prior IS NOT NULL AND k.version IS NULL THEN 'unknown prior' WHEN v.prior IS NOT NULL AND count(*) OVER (PARTITION BY v.document, v.prior) > 1 THEN 'fork' END AS own
  FROM v LEFT JOIN r ON r.document = v.document AND r.version = v.version LEFT JOIN v k ON k.document = v.document AND k.version = v.prior),
s AS (SELECT c.document, c.version FROM p JOIN p c ON c.document = p.document AND c.prior = p.version WHERE p.own IS NOT NULL UNION SELECT c.document, c.version FROM s JOIN v c ON c.document = s.document AND c.prior = s.version)
SELECT p.document, p.version, CASE WHEN own = 'second root' THEN NULL ELSE steps END AS steps, coalesce(own, CASE WHEN s.version IS NOT NULL THEN 'after a problem' WHEN steps IS NULL THEN 'loop' END) AS problem FROM p LEFT JOIN s ON s.document = p.document AND s.version = p.version""")
def f15_chain(spark: SparkSession, d: str) -> DataFrame:
    return chains.amendment_chain(versions(spark, d))


@query("f15_plan_before_code", "WITH o AS (SELECT o_custkey AS repo, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, count(*) OVER (PARTITION BY o_custkey) AS m FROM orders) SELECT repo, 'src/' || id AS path, CASE WHEN repo % 7 = 0 OR m < 3 THEN 'no plan' WHEN id % 19 = 3 THEN 'uncommitted' WHEN n = 3 THEN 'same commit' ELSE 'not an ancestor' END AS problem FROM o WHERE repo % 7 = 0 OR m < 3 OR n <= 3 OR id % 19 = 3")
def f15_plan(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("repo"), F.col("o_orderkey").alias("id"), F.lag("o_orderkey").over(w).alias("parent"), F.row_number().over(w).alias("n"))
    code = o.select("repo", F.concat(F.lit("src/"), F.col("id").cast("string")).alias("path"), F.when(F.col("id") % 19 != 3, F.col("id")).alias("id"))
    return chains.plan_before_code(o.select("repo", "id", "parent"), code.unionByName(o.filter("n = 3 and repo % 7 != 0").select("repo", F.lit("PLAN.md").alias("path"), "id")), "PLAN.md")


# --- images -----------------------------------------------------------------------------------------------------------

MASK_WIDTH = 40
LABEL_BOXES = """
px AS (SELECT clip_id, i, CASE WHEN v THEN 1 ELSE 2 END AS c FROM samples WHERE v IS NOT NULL),
half AS (SELECT a.clip_id, a.i AS a, b.i AS b FROM px a JOIN px b ON b.clip_id = a.clip_id AND b.c = a.c AND (b.i = a.i + 40 OR b.i = a.i + 1 AND a.i % 40 < 39)),
edge AS (SELECT * FROM half UNION ALL SELECT clip_id, b, a FROM half),
reach AS (SELECT clip_id, i AS root, i FROM px UNION SELECT r.clip_id, r.root, e.b FROM reach r JOIN edge e ON e.clip_id = r.clip_id AND e.a = r.i WHERE e.b > r.root),
comp AS (SELECT clip_id, i, min(root) AS root FROM reach GROUP BY 1, 2),
"""


@query("f9_label_boxes", sql(LABEL_BOXES.rstrip() + """
size AS (SELECT clip_id, root, px.c AS class, count(*) AS pixels, min(i % 40) AS x, min(i // 40) AS y, max(i % 40) - min(i % 40) + 1 AS width, max(i // 40) - min(i // 40) + 1 AS height FROM comp JOIN px USING (clip_id, i) GROUP BY 1, 2, 3)
SELECT clip_id, class, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(width AS DOUBLE) AS width, CAST(height AS DOUBLE) AS height, pixels FROM size WHERE pixels >= 64 QUALIFY row_number() OVER (PARTITION BY clip_id, class ORDER BY pixels DESC, root) = 1""").replace("WITH ", "WITH RECURSIVE ", 1))
def f9(spark: SparkSession, d: str) -> DataFrame:
    """A clip's settled instants as an image of 40 columns: exertion in one class, rest in the other."""
    cls = F.when(F.col("v").isNull(), "00").when(F.col("v"), "01").otherwise("02")
    rows = samples(spark, d).groupBy("clip_id").agg(F.array_sort(F.collect_list(F.struct("i", cls.alias("c")))).alias("px"))  # a clip is bounded by its length
    high = F.ceil(F.size("px") / MASK_WIDTH).cast("int")
    data = F.unhex(F.rpad(F.array_join(F.transform("px", lambda p: p["c"]), ""), 2 * MASK_WIDTH * high, "0"))
    masks_ = rows.select("clip_id", F.lit(0.0).alias("t_s"), F.lit(MASK_WIDTH).alias("width"), high.alias("height"), data.alias("mask"))
    return masks.boxes_from_masks(masks_).select("clip_id", F.explode("boxes").alias("b")).select("clip_id", "b.*")


@query("m4_model_inputs")
def m4(spark: SparkSession, d: str) -> DataFrame:
    """Frames of 48 x 27 made of each embedding, brought to a small model's size: a digest of each input."""
    e = table(spark, d, "embeddings")
    level = F.expr("transform(sequence(0, 48 * 27 * 3 - 1), j -> lpad(hex(cast(abs(element_at(embedding, cast(j % size(embedding) as int) + 1)) * 700 + 3 * j as int) % 256), 2, '0'))")
    frames = e.select(F.col("vec_id").cast("string").alias("clip_id"), F.lit(0.0).alias("t_s"), F.lit(48).alias("width"), F.lit(27).alias("height"), F.unhex(F.array_join(level, "")).alias("rgb"))
    return preprocess.model_inputs(frames, edge=20, crop=18).select("clip_id", F.octet_length("input").alias("bytes"), F.sha2("input", 256).alias("input_sha256"), "failed_reason")


@query("m6_saved_probe")
def m6(spark: SparkSession, d: str) -> DataFrame:
    """A probe trained by its driver, saved, loaded and applied to all embeddings. The target is a half-space with a label in eleven turned round."""
    e = table(spark, d, "embeddings")
    features = e.select(F.col("vec_id").alias("frame_id"), F.col("embedding").alias("features"))
    half = F.col("embedding")[0] + F.col("embedding")[1] / 2 > 0
    labels = e.select(F.col("vec_id").alias("frame_id"), F.when(F.col("vec_id") % 11 == 0, ~half).otherwise(half).alias("manipulation"), F.when(F.col("vec_id") % 10 == 0, "unreadable").otherwise("ok").alias("status"))
    path = stores.scratch_folder(spark)
    probe.train_probe(features, labels, path, "embeddings", "half-space", len(e.first().embedding))
    return probe.load_probe(spark, path, "embeddings", "half-space").score(features).select("frame_id", F.round("score", 3).alias("score"), "predicted")
