"""Chains of versions, plans before code, and probes that are saved with what they were fitted to."""

import numpy as np
import pytest

from motilis.operators import chains, probe


def test_chains_with_a_gap_a_fork_and_a_loop(spark):
    told = {
        "sound": [("1", None, 0, None), ("2", "1", 1, None), ("3", "2", 2, None)],
        "gap": [("1", None, 0, None), ("3", "2", None, "unknown prior"), ("4", "3", None, "after a problem")],
        "fork": [("1", None, 0, None), ("2", "1", 1, "fork"), ("2b", "1", 1, "fork"), ("3", "2", 2, "after a problem")],
        "loop": [("1", None, 0, None), ("2", "3", None, "loop"), ("3", "2", None, "loop"), ("9", "9", None, "loop")],
        "forked loop": [("1", None, 0, None), ("2", "3", None, "fork"), ("3", "2", None, "after a problem"), ("4", "3", None, "fork"), ("5", "4", None, "after a problem")],
        "roots": [("1", None, 0, None), ("2", None, None, "second root"), ("3", "2", None, "after a problem")],  # of the first one alone are steps counted
        "no root": [("2", "1", None, "unknown prior")],
    }
    rows = [(d, v, p) for d, own in told.items() for v, p, _, _ in own]
    df = spark.createDataFrame([*rows, ("twice", "1", None), ("twice", "1", None), ("twice", "2", "1")], "document string, version string, prior string").repartition(3)
    out = {(r.document, r.version): (r.steps, r.problem) for r in chains.amendment_chain(df).collect()}
    want = {(d, v): (n, why) for d, own in told.items() for v, _, n, why in own}
    assert out == {**want, ("twice", "1"): (0, "repeated"), ("twice", "2"): (1, "after a problem")}
    assert chains.amendment_chain(df.limit(0)).count() == 0
    long = spark.range(500).selectExpr("'d' AS document", "id AS version", "CASE WHEN id > 0 THEN id - 1 END AS prior")
    assert [(r.steps, r.problem) for r in chains.amendment_chain(long).orderBy("version").collect()] == [(i, None) for i in range(500)]


def test_plan_before_code_by_ancestry(spark):
    """Merges on merges: 2**30 ways through 61 commits, each met once a step."""
    commits = [("r", 0, None)] + [("r", 2 * k + j, 2 * k - 2 + i) for k in range(1, 31) for j in (0, 1) for i in (0, 1)]
    commits += [("s", 0, None), ("s", 1, 0), ("s", 2, 0), ("s", 3, 1), ("s", 3, 2)]
    df = spark.createDataFrame(commits, "repo string, id int, parent int")
    added = [("r", "PLAN", 4), ("r", "old.py", 1), ("r", "same.py", 4), ("r", "other.py", 5), ("r", "new.py", 61), ("s", "PLAN", 1), ("s", "side.py", 2), ("s", "merged.py", 3), ("s", "loose.py", None), ("t", "bare.py", 5)]
    out = {(r.repo, r.path): r.problem for r in chains.plan_before_code(df, spark.createDataFrame(added, "repo string, path string, id int"), "PLAN").collect()}
    assert out == {("r", "old.py"): "not an ancestor", ("r", "same.py"): "same commit", ("r", "other.py"): "not an ancestor", ("s", "side.py"): "not an ancestor", ("s", "loose.py"): "uncommitted", ("t", "bare.py"): "no plan"}


def frames(spark, n=300, noise=0.5):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, n)
    x = rng.normal(0, noise, (n, 6)) + np.outer(2 * y - 1, np.linspace(0.2, 1, 6))
    features = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "frame_id long, features array<double>")
    labels = spark.createDataFrame([(i, bool(v), "ok" if i % 9 else "unreadable") for i, v in enumerate(y)], "frame_id long, manipulation boolean, status string")
    return features, labels, y


def test_a_saved_probe_scores_as_the_fitted_one(spark, tmp_path):
    features, labels, y = frames(spark)
    report = probe.train_probe(features, labels, str(tmp_path / "p"), "small", "manipulation", 6)
    assert report["accuracy"] > 0.9 > report["majority"] and report["n"] == int(sum(i % 9 > 0 for i in range(300)))
    loaded = probe.load_probe(spark, str(tmp_path / "p"), "small", "manipulation")
    model = probe.fit(probe.training_set(features, labels), 6)
    from pyspark.ml.functions import array_to_vector

    want = {r.frame_id: r.rawPrediction[1] for r in model.transform(features.withColumn("features", array_to_vector("features"))).collect()}
    got = {r.frame_id: r for r in loaded.score(features).collect()}
    assert all(got[i].score == pytest.approx(want[i], abs=1e-6) and got[i].predicted == int(want[i] > 0) for i in want)
    odd = spark.createDataFrame([(1, None), (2, [1.0]), (3, [1.0, None, 1.0, 1.0, 1.0, 1.0])], "frame_id long, features array<double>")
    assert all(r.score is None and r.predicted is None for r in loaded.score(odd).collect())
    probe.train_probe(features, labels, str(tmp_path / "p"), "small", "manipulation", 6)  # replaced as a whole


def test_probes_of_other_features_are_refused(spark, tmp_path):
    features, labels, _ = frames(spark)
    path = str(tmp_path / "p")
    probe.train_probe(features, labels, path, "small", "manipulation", 6)
    for backbone, target in (("large", "manipulation"), ("small", "hands")):
        with pytest.raises(ValueError, match="was fitted to small for manipulation"):
            probe.load_probe(spark, path, backbone, target)
    with pytest.raises(ValueError, match="width 7"):
        probe.train_probe(features, labels, path, "small", "manipulation", 7)
    noise, labels, _ = frames(spark, 60, 400.0)
    rare = labels.withColumn("manipulation", labels.frame_id % 20 == 1)
    with pytest.raises(ValueError, match="does not beat"):
        probe.train_probe(noise, rare, str(tmp_path / "q"), "small", "manipulation", 6)
    with pytest.raises(Exception):
        probe.load_probe(spark, str(tmp_path / "q"), "small", "manipulation")
