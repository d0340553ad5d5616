"""Steps that failed at size: rounded shares, and many small groups or large ones in bounded frames."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from motilis.functions import columns as C
from motilis.operators import chains, grouped, plan, resampling, spectral


def test_shares_are_rounded_by_their_doubles(spark):
    """304 of 640 is a double below 0.475, 7 of 40 one above 0.175, 1 of 8 a half whose even neighbour is below."""
    pairs = [(a, b) for b in (8, 40, 200, 640, 7) for a in range(b + 1)]
    rows = spark.createDataFrame(pairs, "a int, b int").select("a", "b", C.share_text(F.col("a") / F.col("b")).alias("t")).collect()
    assert {(r.a, r.b): r.t for r in rows} == {(a, b): f"{a / b:.2f}" for a, b in pairs}
    assert spark.range(1).select(C.share_text(F.lit(None).cast("double")).alias("t")).first().t is None


def test_native_frames_take_the_first_instant_without_grouping(spark):
    rows = [("a", i, i * 0.01) for i in range(40)] + [("a", 99, None), ("b", 5, 0.0), ("b", 3, 0.001), ("b", 4, 1.0)]
    df = plan.native_frames(spark.createDataFrame(rows, "clip_id string, i int, t_s double").withColumn("fps", F.lit(30)).repartition(3))
    want, before = {}, {}
    for clip, i, t in rows:
        key = clip, None if t is None else int(np.floor(t * 30 + 0.5))
        want[key] = min(i, want.get(key, i))
    got = {(r.clip_id, r.idx): (r.i, r.after_previous) for r in df.collect()}
    before = {k: k[1] is not None and (k[0], k[1] - 1) in want for k in want}
    assert got == {k: (i, before[k]) for k, i in want.items()}
    assert "HashAggregate" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("batch", ["1", "3", "10000"])
def test_frames_hold_whole_groups(spark, batch):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = spark.createDataFrame([(g, i) for g in range(20) for i in range(g % 7 + 1)] + [(None, 1)], "g int, i int").repartition(5)

        def run(pdf):
            b = grouped.starts(pdf.g.to_numpy())
            assert (np.diff(pdf.i)[np.diff(pdf.g) == 0] == 1).all()
            return pdf.iloc[b[:-1]][["g"]].assign(n=np.diff(b))

        assert sorted((r.g, r.n) for r in grouped.over_whole_groups(df, "g", "i", run, "g int, n long").collect()) == [(g, g % 7 + 1) for g in range(20)]
        assert grouped.over_whole_groups(df.limit(0), "g", "i", run, "g int, n long").count() == 0
        commits = [(r, i, i - 1 if i else None) for r in range(30) for i in range(9)]
        added = [(r, "PLAN", r % 9) for r in range(30)] + [(r, f"{i}", i) for r in range(30) for i in range(9)]
        out = chains.plan_before_code(spark.createDataFrame(commits, "repo int, id int, parent int"), spark.createDataFrame(added, "repo int, path string, id int"), "PLAN").collect()
        assert {(r.repo, int(r.path)): r.problem for r in out} == {(r, i): "same commit" if i == r % 9 else "not an ancestor" for r in range(30) for i in range(9) if i <= r % 9}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_many_small_groups_take_few_calls(spark):
    calls = spark.sparkContext.accumulator(0)
    df = spark.range(20_000).select((F.col("id") / 2).cast("long").alias("g"), "id").coalesce(2)

    def run(pdf):
        calls.add(1)
        return pdf[["g"]].drop_duplicates()

    assert grouped.over_whole_groups(df, "g", "id", run, "g long").count() == 10_000
    assert calls.value < 50


def test_transforms_give_the_periodogram_of_sums():
    rng = np.random.default_rng(3)
    for trial in range(60):
        k = np.flatnonzero(rng.random(int(rng.integers(40, 900))) < (0.15, 0.9, 1.0)[trial % 3])
        k = k - k[0]
        if len(k) < 9:
            continue
        v = (rng.random(len(k)) < 0.4 if trial % 2 else k * 3 % 20 < 12).astype(float)
        bins = k[-1] // 2
        want = spectral.periodogram(k / 4.0, v, np.arange(1, bins + 1) / (k[-1] / 4.0))
        assert spectral.grid_periodogram(k, v, bins) == pytest.approx(want, rel=1e-9, abs=1e-10 * want.max())
    assert not spectral.grid_periodogram(np.arange(20), np.ones(20), 9).any()


def test_a_clip_of_two_hours_has_a_spectrum():
    """28,800 instants and 14,399 bins: as sums, matrices of 3.3 GB."""
    import resource

    k = np.arange(28_800)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    row = spectral.estimate("a", 7200.0, k.astype(float), k % 20 < 12, len(k), 4.0)
    assert row[1] == 14_399 and row[2] == pytest.approx(0.2, rel=1e-3) and row[-1] == "ok"
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300_000


def same_draws(states, n):
    """The first draws from each state; the buffered half of a number counts only where one waits."""
    out = []
    for s in states:
        rng = np.random.default_rng()
        rng.bit_generator.state = s
        out.append(rng.integers(0, n, 50).tolist())
    return out


@pytest.mark.parametrize("n", [1001, 4096, (1 << 31) + 5])
def test_states_found_by_tasks_are_those_of_one_run_through_the_stream(spark, n):
    """Of numbers below 2**31 + 5 nearly half are not used."""
    b, segment = (3, 1 << 14) if n > 1 << 20 else (200, 1 << 14)
    if n > 1 << 20:  # chunks of a few draws: one replicate is too long to run through here
        got = [resampling._used(n, 7, 0, 1 << 12)]
        draws = np.random.default_rng(7).integers(0, n, 1500)
        bits = np.random.PCG64(7).random_raw(1 << 11).view(np.uint32).astype(np.uint64)
        used = np.concatenate([u for _, u in got[0]])
        assert ((bits[used] * np.uint64(n)) >> np.uint64(32))[:1500].tolist() == draws.tolist()
        return
    got = resampling.states_over_tasks(spark, n, b, 7, 9, segment)
    assert same_draws(got, n) == same_draws(resampling.stream_states(n, b, 7, 9), n)


def test_clusters_in_parts_and_pieces_give_the_same_means(spark, monkeypatch):
    rng = np.random.default_rng(0)
    s, c = rng.random(3001), rng.integers(1, 9, 3001)
    df = spark.createDataFrame([(f"f/{i:05d}", float(x), int(k)) for i, (x, k) in enumerate(zip(s, c))], "cluster string, s double, n long").repartition(3)
    at = np.random.default_rng(777).integers(0, 3001, (40, 3001))
    want = s[at].sum(1) / c[at].sum(1)
    means = lambda d: np.array([r["mean"] for r in sorted(d.collect())])
    monkeypatch.setattr(resampling, "_STEP", 256)
    monkeypatch.setattr(resampling, "SEGMENT", 1 << 12)
    assert (means(resampling.cluster_replicates(df, 40, 777)) == want).all()
    assert means(resampling.cluster_replicates(df, 40, 777, part=1000)) == pytest.approx(want, rel=1e-12)
