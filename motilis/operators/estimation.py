"""From clips to publishable rows: clusters, bootstrap, components, disclosure floor.

Everything relational is aggregated in Spark. What reaches the cluster bootstrap is one sum and count per cluster, a number of rows
that follows the workforce and not the clips; replicates are dealt out over tasks (resampling.py), quantiles are exact at any
size (ranks.py).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from .ranks import exact_quantiles
from .resampling import cluster_replicates, value_replicates


def composite_cluster(df: DataFrame) -> DataFrame:
    """Worker ids repeat across factories; a bare one is refused."""
    return df.withColumn("cluster", F.when(F.length("factory_id") > 0, F.concat_ws("/", "factory_id", "worker_id")).otherwise(F.raise_error(F.lit("a cluster id needs its factory")).cast("string")))


def cluster_sums(observations: DataFrame) -> DataFrame:
    return composite_cluster(observations).groupBy("cluster").agg(F.sum("hal").alias("s"), F.count(F.lit(1)).alias("n"))


def cluster_bootstrap_means(observations: DataFrame, b: int = K.BOOTSTRAP_B, seed: int = K.BOOTSTRAP_SEED) -> DataFrame:
    """replicate, mean: clusters in lexicographic order, drawn from one stream."""
    return cluster_replicates(cluster_sums(observations), b, seed)


def iid_bootstrap_means(observations: DataFrame, b: int = K.BOOTSTRAP_B, seed: int = K.BOOTSTRAP_SEED) -> DataFrame:
    """replicate, mean, as if clips were independent: each replicate draws as many clips as there are, with replacement."""
    return value_replicates(observations, "hal", b, seed)


def interval(means: DataFrame) -> DataFrame:
    """95 % percentile interval, linear between order statistics."""
    p = F.percentile("mean", F.array(F.lit(0.025), F.lit(0.975)))
    return means.agg(p[0].alias("lo"), p[1].alias("hi"), F.count(F.lit(1)).alias("b"))


def design_effect(clustered: DataFrame, iid: DataFrame, by: list[str] | None = None) -> DataFrame:
    """variance_ratio and width_ratio of two intervals (lo, hi), one each or one for each value of `by`; null where the second has no width."""
    by = by or []
    a, b = clustered.select(*by, (F.col("hi") - F.col("lo")).alias("wc")), iid.select(*by, (F.col("hi") - F.col("lo")).alias("wi"))
    ratio = F.when(F.col("wi") > 0, F.try_divide("wc", "wi"))
    return (a.join(b, by) if by else a.crossJoin(b)).select(*by, (ratio * ratio).alias("variance_ratio"), ratio.alias("width_ratio"))


def variance_components(observations: DataFrame) -> DataFrame:
    """Between factories against between workers within a factory, over worker means. Not evaluable without a measured denominator."""
    workers = observations.groupBy("factory_id", "worker_id").agg(F.avg("hal").alias("m"))
    factories = workers.groupBy("factory_id").agg(F.avg("m").alias("m"), F.var_samp("m").alias("within"), F.count(F.lit(1)).alias("n"))
    rows = factories.agg(F.var_samp("m").alias("between_factory"), F.coalesce(F.avg(F.when(F.col("n") > 1, F.col("within"))), F.lit(0.0)).alias("between_worker_within_factory"), F.count(F.lit(1)).alias("n_factories"), F.sum("n").alias("n_workers"), F.count_if(F.col("n") > 1).alias("n_factories_with_two_workers"))
    w = F.col("between_worker_within_factory")
    ratio = F.when(w <= 0, F.lit(float("inf"))).otherwise(F.try_divide(F.col("between_factory"), w))
    evaluable = (F.col("n_factories_with_two_workers") > 0) & (w > 0)
    return rows.withColumn("ratio", ratio).withColumn("evaluable", evaluable).withColumn("holds", evaluable & (ratio > 1))


def floor_check(observations: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts, shares and reasons for suppression (empty if the floor is cleared), in all or for each value of `by`."""
    by = by or []
    workers = observations.groupBy(*by, "factory_id", "worker_id").agg(F.count(F.lit(1)).alias("clips"))
    factories = workers.groupBy(*by, "factory_id").agg(F.sum("clips").alias("clips"), F.count(F.lit(1)).alias("workers"))
    rows = factories.groupBy(*by).agg(F.sum("clips").alias("n_clips"), F.count(F.lit(1)).alias("n_factories"), F.sum("workers").alias("n_workers"), (F.max("workers") / F.sum("workers")).alias("max_factory_share_workers"), (F.max("clips") / F.sum("clips")).alias("max_factory_share_clips"))
    pct = lambda c: F.bround(F.col(c) * 100, 0).cast("int").cast("string")
    why = F.concat_ws(
        "; ",
        F.when(F.col("n_factories") < K.K_FACTORIES_FLOOR, F.concat(F.col("n_factories").cast("string"), F.lit(f" factories, floor is {K.K_FACTORIES_FLOOR}"))),
        F.when(F.col("n_workers") < K.K_WORKERS_FLOOR, F.concat(F.col("n_workers").cast("string"), F.lit(f" workers, floor is {K.K_WORKERS_FLOOR}"))),
        F.when(F.col("max_factory_share_workers") > K.MAX_FACTORY_SHARE, F.concat(F.lit("one factory holds "), pct("max_factory_share_workers"), F.lit("% of workers"))),
        F.when(F.col("max_factory_share_clips") > K.MAX_FACTORY_SHARE, F.concat(F.lit("one factory holds "), pct("max_factory_share_clips"), F.lit("% of clips"))),
    )
    return rows.withColumn("failures", why).withColumn("clears", why == "")


def quantiles(observations: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The published percentiles of hal, exact, in all or for each value of `by`."""
    names = [f"p{q}" for q in K.QUANTILES]
    found = exact_quantiles(observations, "hal", [q / 100 for q in K.QUANTILES], by)
    return found.select(*(by or []), *(F.col(f"q{i}").alias(n) for i, n in enumerate(names)))


def size_terciles(observations: DataFrame) -> DataFrame:
    """Factories by number of workers, in three strata; the remainder goes to the last."""
    f = observations.groupBy("factory_id").agg(F.countDistinct("worker_id").alias("n_workers"))
    one = Window.partitionBy(F.lit(0))
    r = F.row_number().over(one.orderBy("n_workers", "factory_id")) - 1  # a row per factory
    third = F.greatest((F.count(F.lit(1)).over(one) / 3).cast("int"), F.lit(1))
    return f.withColumn("r", r).withColumn("third", third).select("factory_id", "n_workers", F.when(F.col("r") < F.col("third"), "size_tercile_1").when(F.col("r") < 2 * F.col("third"), "size_tercile_2").otherwise("size_tercile_3").alias("stratum"))


def build_aggregate(observations: DataFrame, stratum: str, b: int = K.BOOTSTRAP_B, seed: int = K.BOOTSTRAP_SEED) -> DataFrame:
    """One publishable row, or a suppressed one with its reason. No identifier is carried along."""
    if b != K.BOOTSTRAP_B:
        raise ValueError(f"B is fixed at {K.BOOTSTRAP_B}")
    check = floor_check(observations)
    if not check.first()["clears"]:
        return check.select(F.lit(stratum).alias("stratum"), F.lit(None).cast("double").alias("hal_mean"), F.col("failures").alias("suppressed_reason"))
    clustered, iid = interval(cluster_bootstrap_means(observations, b, seed)), interval(iid_bootstrap_means(observations, b, seed))
    mean = observations.agg(F.avg("hal").alias("hal_mean"))
    rows = check.drop("failures", "clears").crossJoin(mean).crossJoin(quantiles(observations))  # one row each
    rows = rows.crossJoin(clustered.select(F.col("lo").alias("ci_lo"), F.col("hi").alias("ci_hi"))).crossJoin(iid.select(F.col("lo").alias("iid_lo"), F.col("hi").alias("iid_hi")))
    ratio = F.try_divide(F.col("ci_hi") - F.col("ci_lo"), F.col("iid_hi") - F.col("iid_lo"))
    return rows.select(F.lit(stratum).alias("stratum"), "*", (ratio * ratio).alias("design_effect"), ratio.alias("design_effect_width_ratio"), F.lit(b).alias("bootstrap_b"), F.lit(seed).alias("seed"), F.lit(None).cast("string").alias("suppressed_reason"))
