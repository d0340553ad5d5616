"""Bootstrap replicates over tasks against plain draws, ranks and quantiles against numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from motilis.operators import estimation, ranks, resampling


def clusters(spark, s, n):
    names = [f"f/{i:04d}" for i in range(len(s))]
    return spark.createDataFrame(list(zip(names, map(float, s), map(int, n)))[::-1], "cluster string, s double, n long").repartition(3)


def means(df):
    rows = sorted((r.replicate, r["mean"]) for r in df.collect())
    assert [r for r, _ in rows] == list(range(len(rows)))
    return np.array([m for _, m in rows])


def test_cluster_replicates_are_those_of_one_task(spark, monkeypatch):
    rng = np.random.default_rng(0)
    s, n = rng.random(101), rng.integers(1, 9, 101)
    at = np.random.default_rng(777).integers(0, 101, (500, 101))
    want = s[at].sum(1) / n[at].sum(1)
    df = clusters(spark, s, n)
    assert (means(resampling.cluster_replicates(df, 500, 777)) == want).all()
    assert (means(resampling.cluster_replicates(df, 500, 777, chunks=3)) == want).all()
    assert means(resampling.cluster_replicates(df, 500, 777, part=17)) == pytest.approx(want, rel=1e-12)  # clusters in six parts
    monkeypatch.setattr(resampling, "_STEP", 1000)
    assert resampling.stream_states(101, 500, 777, 8)[5] == resampling.stream_states(101, 500, 777, 4)[2] or 500 % 8
    assert (means(resampling.cluster_replicates(df, 500, 777)) == want).all()
    assert len(means(resampling.cluster_replicates(df, 3, 1))) == 3  # fewer replicates than chunks
    for few in (0, 1):
        with pytest.raises(ValueError, match="two clusters"):
            resampling.cluster_replicates(df.limit(few), 10, 1)


def test_value_replicates_are_those_of_plain_draws(spark):
    """One part: each replicate's own stream, over the sorted values or their counts."""
    rng = np.random.default_rng(1)
    for values in (rng.normal(5, 1, 400), rng.integers(0, 9, 3000) / 2.0, np.array([2.5])):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "hal double").repartition(5)
        x, counts = np.unique(values, return_counts=True)
        want = []
        for r in range(200):
            g = np.random.default_rng([3, r, 1])
            n = len(values)
            want.append((g.multinomial(n, counts / n) @ x if n > 16 * len(x) else np.sort(values)[g.integers(0, n, n)].sum()) / n)
        assert means(resampling.value_replicates(df, "hal", 200, 3)) == pytest.approx(np.array(want), rel=1e-12)
        assert means(resampling.value_replicates(df, "hal", 200, 3, chunks=2)) == pytest.approx(np.array(want), rel=1e-12)
    with pytest.raises(ValueError):
        resampling.value_replicates(df.limit(0), "hal", 10, 1)


def test_parts_draw_with_replacement_from_the_whole(spark):
    rng = np.random.default_rng(4)
    values = rng.normal(5, 2, 2000)
    df = spark.createDataFrame([(float(v),) for v in values], "hal double")
    many = means(resampling.value_replicates(df, "hal", 3000, 9, most=150))
    assert many.mean() == pytest.approx(values.mean(), abs=4 * values.std() / math.sqrt(2000 * 3000))
    assert many.std() == pytest.approx(values.std() / math.sqrt(2000), rel=0.06)


def test_ten_million_clips_of_few_values_take_few_draws(spark):
    df = spark.range(10_000_000).select((F.col("id") % 37 / 4.0).alias("hal"))
    got = means(resampling.value_replicates(df, "hal", 1000, 5))
    x = np.arange(10_000_000) % 37 / 4.0
    assert got.mean() == pytest.approx(x.mean(), abs=4 * x.std() / math.sqrt(1e10)) and got.std() == pytest.approx(x.std() / math.sqrt(1e7), rel=0.1)


def test_design_effect_of_clustered_data(spark):
    rng = np.random.default_rng(0)
    rows = [(f"f{k % 20}", f"w{k}", float(x)) for k in range(400) for x in rng.normal(rng.normal(0, math.sqrt(0.3)), math.sqrt(0.7), 10)]
    o = spark.createDataFrame(rows, "factory_id string, worker_id string, hal double")
    a, b = (estimation.interval(f(o, 2000)) for f in (estimation.cluster_bootstrap_means, estimation.iid_bootstrap_means))
    assert estimation.design_effect(a, b).first().variance_ratio == pytest.approx(1 + 9 * 0.3, rel=0.25)
    flat = b.withColumn("hi", F.col("lo"))
    assert estimation.design_effect(a, flat).first().variance_ratio is None


def test_places_in_the_order_of_all_rows(spark):
    rng = np.random.default_rng(6)
    rows = [(int(v), i) for i, v in enumerate(rng.integers(0, 50, 1000))]
    df = spark.createDataFrame(rows, "v int, i int").repartition(7)
    got = sorted(ranks.numbered(df, "v", "i").collect(), key=lambda r: r.rank)
    assert [r.rank for r in got] == list(range(1000)) and [(r.v, r.i) for r in got] == sorted(rows)
    assert ranks.numbered(df.limit(0), "v").count() == 0


@pytest.mark.parametrize("most", [1 << 16, 3])
def test_quantiles_are_exact(spark, most):
    """With ranges of three distinct values every place takes rounds of bins."""
    rng = np.random.default_rng(8)
    groups = {"normal": rng.normal(0, 1, 500), "ties": rng.integers(0, 4, 333) / 3.0, "one": np.array([7.25]), "two": np.array([1.0, 2.0]), "wide": 10.0 ** rng.integers(-300, 300, 200), "ends": np.array([-1.7e308, 1.7e308, 0.0]), None: np.array([3.0, 9.0, 3.0])}
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [("none", None), ("nan", float("nan")), ("one", float("inf"))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    shares = [0.1, 0.5, 0.975]
    out = {r.g: list(r)[1:] for r in ranks.exact_quantiles(df, "v", shares, ["g"], bins=64 if most == 3 else 4096, most=most).collect()}
    assert set(out) == set(groups)
    for g, values in groups.items():
        order = np.sort(values)
        for q, got in zip(shares, out[g]):
            pos = (len(order) - 1) * q
            a, b = order[math.floor(pos)], order[min(math.floor(pos) + 1, len(order) - 1)]
            part = pos - math.floor(pos)
            assert got == (a if part == 0 else a + (b - a) * part)
    whole = np.concatenate(list(groups.values()))
    got, order = ranks.exact_quantiles(df, "v", [0.0, 0.5, 1.0], most=most).first(), np.sort(np.append(whole, []))
    assert (got.q0, got.q2) == (order[0], order[-1]) and order[(len(order) - 1) // 2] <= got.q1 <= order[len(order) // 2]
    assert ranks.exact_quantiles(df.limit(0), "v", [0.5]).first().q0 is None and ranks.exact_quantiles(df.limit(0), "v", [0.5], ["g"]).count() == 0
