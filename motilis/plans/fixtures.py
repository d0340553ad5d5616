"""Measurement views over the driver's tables, in Spark and, word for word, in SQL.

clips come from supplier, instants from lineitem in a fixed order, observations from orders and customer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clip_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, factory_id, worker_id, clip_index, clip_id."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.format_string("factory_%03d", F.col("s_nationkey") + 1).alias("factory_id"), F.format_string("worker_%03d", F.col("s_suppkey") % 3 + 1).alias("worker_id"), F.col("s_suppkey").alias("clip_index"))
    return s.withColumn("clip_id", C.clip_id(F.col("factory_id"), F.col("worker_id"), F.col("clip_index")))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per instant: clip_id, k, i, t_s, v, hands, width, px. Dealt out by clip once; all that follows by clip stays in place."""
    line = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("q"), F.col("l_tax").alias("x"), F.col("l_discount").alias("d"), F.col("l_extendedprice").alias("p"))
    rows = line.join(clip_names(spark, sf_dir).select("k", "clip_id"), "k")
    w = Window.partitionBy("clip_id").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")
    rows = rows.withColumn("i", F.row_number().over(w) - 1).filter(~((F.col("k") % 11 == 10) & (F.col("i") >= 200)))
    v = F.when((F.col("x") >= 0.075) | ((F.col("k") % 5 == 4) & (F.col("x") >= 0.065)), None).when(F.col("k") % 3 == 0, (F.col("i") * (1 + F.col("k") % 5)) % 20 < 12).otherwise(F.col("q") > 15)
    rows = rows.withColumn("v", v)
    hands = F.when(F.col("v").isNull(), None).when(~F.col("v") & (F.col("l_linenumber") % 4 == 0), 0).otherwise(1 + F.col("l_linenumber") % 2)
    boxed = F.when(F.col("k") % 7 == 6, F.col("d") > 0.055).otherwise(F.col("d") > 0.025)
    null_flow = (F.col("x") > 0.065) & (F.col("x") < 0.075) & (F.col("d") > 0.055)
    return rows.select("clip_id", "k", "i", (F.col("i") / 4.0).alias("t_s"), "v", hands.cast("int").alias("hands"), F.when(boxed, 150 + 2 * F.col("q")).alias("width"), F.when(boxed & ~null_flow, F.col("p") / 100).alias("px"))


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per clip: k, factory_id, worker_id, clip_index, clip_id, n, duration_s, fps."""
    # the fixture trims some clips by count, so a count is all their length needs
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.count(F.lit(1)).alias("c"))
    n = n.select("k", F.when(F.col("k") % 11 == 10, F.least("c", F.lit(200))).otherwise(F.col("c")).alias("n"))
    return clip_names(spark, sf_dir).join(n, "k").withColumn("duration_s", F.col("n") / 4.0 + 0.25).withColumn("fps", F.lit(30.0))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """factory_id, worker_id, hal."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.format_string("factory_%03d", F.col("c_nationkey") + 1).alias("factory_id"), F.format_string("worker_%06d", F.col("c_custkey")).alias("worker_id"), F.least(F.lit(10.0), F.col("o_totalprice") / 50000).alias("hal"))


SQL = """
clip_names AS (
  SELECT s_suppkey AS k, format('factory_{:03d}', s_nationkey + 1) AS factory_id, format('worker_{:03d}', s_suppkey % 3 + 1) AS worker_id,
         s_suppkey AS clip_index, format('factory_{:03d}/worker_{:03d}/{:06d}', s_nationkey + 1, s_suppkey % 3 + 1, s_suppkey) AS clip_id
  FROM supplier
), raw_rows AS (
  SELECT l_suppkey AS k, l_linenumber AS ln, l_quantity AS q, l_tax AS x, l_discount AS d, l_extendedprice AS p,
         row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) - 1 AS i
  FROM lineitem
), labelled AS (
  SELECT *, CASE WHEN x >= 0.075 OR (k % 5 = 4 AND x >= 0.065) THEN NULL WHEN k % 3 = 0 THEN (i * (1 + k % 5)) % 20 < 12 ELSE q > 15 END AS v,
         CASE WHEN k % 7 = 6 THEN d > 0.055 ELSE d > 0.025 END AS boxed, x > 0.065 AND x < 0.075 AND d > 0.055 AS null_flow
  FROM raw_rows WHERE NOT (k % 11 = 10 AND i >= 200)
), samples AS (
  SELECT clip_id, labelled.k AS k, i, i / 4.0 AS t_s, v,
         CASE WHEN v IS NULL THEN NULL WHEN NOT v AND ln % 4 = 0 THEN 0 ELSE 1 + ln % 2 END AS hands,
         CASE WHEN boxed THEN 150 + 2 * q END AS width, CASE WHEN boxed AND NOT null_flow THEN p / 100 END AS px
  FROM labelled JOIN clip_names USING (k)
), clips AS (
  SELECT clip_names.*, n, n / 4.0 + 0.25 AS duration_s, 30.0 AS fps FROM clip_names JOIN (SELECT k, count(*) AS n FROM samples GROUP BY k) USING (k)
), observations AS (
  SELECT format('factory_{:03d}', c_nationkey + 1) AS factory_id, format('worker_{:06d}', c_custkey) AS worker_id, least(10.0, o_totalprice / 50000) AS hal
  FROM orders JOIN customer ON o_custkey = c_custkey
)
"""


def sql(body: str) -> str:
    """A query with the views in front."""
    return f"WITH {SQL.strip()}{', ' if not body.lstrip().upper().startswith('SELECT') else ' '}{body.strip()}"
