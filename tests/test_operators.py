"""Hand-computed cases, boundaries and seeded bounds."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from motilis import constants as K
from motilis.functions import columns as C
from motilis.operators import bouts, contracts, estimation, exposure, gain, gates, geometry, plan, probe, release, signals, spectral, speed, textgates


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_sample_counts(spark):
    n = lambda d, f: one(spark, C.n_samples(F.lit(float(d)), F.lit(float(f))))
    assert n(187.4, 4) == 749 and n(0.25, 4) == 0 and n(0.1, 4) == 0 and n(60.25, 4) == 240 and n(60.26, 4) == 241


def test_ids(spark):
    assert one(spark, C.clip_id(F.lit("f"), F.lit("w"), F.lit(7))) == "f/w/000007"
    assert one(spark, C.parse_clip_id(F.lit("f/w/000007"))).clip_index == 7
    assert one(spark, C.parse_clip_id(F.lit("f/w"))) is None and one(spark, C.parse_clip_id(F.lit("a/b/c/d"))) is None


def test_floors_and_scores(spark):
    assert one(spark, C.resolvability_floor(F.lit(120))) == pytest.approx(11.192, abs=1e-3)
    assert one(spark, C.resolvability_floor(F.lit(2400))) == pytest.approx(15.514, abs=1e-3)
    assert one(spark, C.hal_radwin(F.lit(0.42), F.lit(68.0))) == pytest.approx(4.397, abs=1e-3)
    assert one(spark, C.hal_akkas(F.lit(612.4), F.lit(68.0))) == pytest.approx(4.8229, abs=1e-4)
    for s, d, rated in ((255.3, 26, 0.6), (665.9, 31, 3.5), (574.0, 74, 5.98), (1055.0, 71, 8.13)):
        assert abs(one(spark, C.hal_akkas(F.lit(s), F.lit(float(d)))) - rated) <= 1.3
    assert one(spark, C.hal_radwin(F.lit(0.0), F.lit(68.0))) is None and one(spark, C.hal_radwin(F.lit(1.0), F.lit(101.0))) is None
    assert one(spark, C.clamp_hal(F.lit(4.25))) == 4.2 and one(spark, C.clamp_hal(F.lit(11.0))) == 10


def fixpoint(v, fps, least):
    """Debouncing by its definition: absorb the leftmost short run that has a readable neighbour into the longer neighbour, again and again."""
    v = list(v)
    while True:
        r = []
        for i, x in enumerate(v):
            if r and r[-1][0] is x:
                r[-1][2] = i + 1
            else:
                r.append([x, i, i + 1])
        for k, (x, a, b) in enumerate(r):
            near = [r[j] for j in (k - 1, k + 1) if 0 <= j < len(r) and r[j][0] is not None]
            if x is not None and (b - a) / fps < least and near:
                v[a:b] = [max(near, key=lambda y: y[2] - y[1])[0]] * (b - a)
                break
        else:
            return v


def test_debounce_equals_its_fixpoint(spark):
    rng, rows, want = random.Random(4), [], {}
    for k in range(300):
        v = [rng.choice([True, False, None] if k % 2 else [True, False]) for _ in range(rng.randint(1, 40))]
        rows += [(f"c{k}", i, x) for i, x in enumerate(v)]
        want[f"c{k}"] = fixpoint(v, 4, 0.75)
    out = {}
    first = bouts.runs(spark.createDataFrame(rows, "clip_id string, i int, v boolean"))
    for r in bouts.debounce(first, 4, 0.75).collect():
        out.setdefault(r.clip_id, {}).update({i: r.v for i in range(r.start, r.stop)})
    for c, v in want.items():
        got = [out[c][i] for i in range(len(v))]
        # an island whose runs are all short together yields no bout either way
        assert bout(got, 3) == bout(v, 3)


def bout(v, least):
    out, i = [], 0
    while i < len(v):
        j = i
        while j < len(v) and v[j] is v[i]:
            j += 1
        if v[i] and j - i >= least:
            out.append((i, j))
        i = j
    return out


def test_null_bounded_and_frequency(spark):
    v = [None, True, True, True, False, False, False, True, True, True]
    s = spark.createDataFrame([("a", i, x) for i, x in enumerate(v)], "clip_id string, i int, v boolean")
    r = bouts.transition_frequency(s).first()
    assert (r.n_segments, r.n_null_bounded, r.scored_s, r.status) == (2, 1, 2.25, "ok") and r.hz == pytest.approx(2 / 2.25)
    quiet = spark.createDataFrame([("a", i, False) for i in range(9)], "clip_id string, i int, v boolean")
    assert bouts.transition_frequency(quiet).first().status == "no_peak"


def test_spectral_square_wave_and_noise():
    i = np.arange(719)
    wave = spectral.estimate("a", 180.0, i.astype(float), (i * 0.25 * 0.25) % 1 < 0.5, 719, 4.0)
    assert wave[-1] == "ok" and wave[2] == pytest.approx(0.25, abs=0.01) and wave[3] > 1000 * 1
    hits = 0
    for seed in range(1000, 1040):
        v = np.random.default_rng(seed).random(719) < 0.5
        hits += spectral.estimate("a", 180.0, i.astype(float), v, 719, 4.0)[-1] == "ok"
    assert hits / 40 <= 0.15
    assert spectral.estimate("a", 59.0, i.astype(float), wave, 719, 4.0)[-1] == "too_short"
    assert spectral.estimate("a", 180.0, i[:7].astype(float), np.ones(7), 7, 4.0)[-1] == "no_labels"
    flat = spectral.estimate("a", 180.0, i.astype(float), np.ones(719), 719, 4.0)
    assert flat[-1] == "no_peak" and flat[3] == 0.0


def clip_rows(spark, rows):
    return spark.createDataFrame(rows, "clip_id string, i int, v boolean, hands int, width double, px double")


def test_boundaries_of_statuses(spark):
    mk = lambda c, nulls, boxes, fails: [(c, i, None if i < nulls else i % 2 == 0, None if i < nulls else 1, 100.0 if i >= 100 - boxes else None, None if i >= 100 - fails else 10.0) for i in range(100)]
    rows = clip_rows(spark, mk("edge", 10, 60, 6) + mk("over", 11, 59, 6) + mk("flow", 0, 60, 7) + mk("short", 0, 60, 0))
    clips = spark.createDataFrame([("edge", 60.0), ("over", 60.0), ("flow", 60.0), ("short", 59.9), ("bare", 60.0)], "clip_id string, duration_s double")
    duty = {r.clip_id: r for r in exposure.duty_cycle_estimate(rows, clips).collect()}
    assert {c: r.status for c, r in duty.items()} == {"edge": "ok", "over": "no_labels", "flow": "ok", "short": "too_short", "bare": "no_labels"}
    v = {r.clip_id: r for r in speed.hand_speed_estimate(rows, clips).collect()}
    assert {c: r.status for c, r in v.items()} == {"edge": "ok", "over": "low_coverage", "flow": "flow_failed", "short": "too_short"}
    assert v["edge"].rms_speed_mm_s == pytest.approx(10 * 85 / 100) and v["over"].status_reason == "detector coverage 0.59 below the 0.60 floor"
    scores = exposure.score_speed_path(exposure.duty_cycle_estimate(rows, clips), speed.hand_speed_estimate(rows, clips))
    assert {r.status for r in scores.filter("clip_id != 'edge'").collect()} == {"no_input"}
    idle = exposure.duty_cycle_estimate(clip_rows(spark, [("edge", i, False, 0, 100.0, 10.0) for i in range(240)]), clips.filter("clip_id = 'edge'"))
    assert exposure.score_speed_path(idle, speed.hand_speed_estimate(rows, clips)).first().status == "zero_duty_cycle"


def test_conflicts_must_be_resolved(spark):
    rows = clip_rows(spark, [("a", 0, None, None, 5.0, None), ("a", 1, False, 0, 5.0, None), ("a", 2, True, 1, 5.0, None)])
    clips = spark.createDataFrame([("a", 60.0)], "clip_id string, duration_s double")
    with pytest.raises(Exception, match="unresolved conflicts"):
        signals.frame_signal(rows, clips).collect()
    r = signals.frame_signal(signals.resolve_conflicts(rows), clips).first()
    assert r.hand_box_width_px == [None, None, 5.0] and r.manipulation == [None, False, True] and r.status == "no_labels"
    assert contracts.violations(signals.frame_signal(signals.resolve_conflicts(rows), clips).withColumn("label_source", F.lit("x")), "frame_signal").first().violations == []


def test_largest_box_is_the_first_of_equals(spark):
    b = lambda w, h: F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(w).alias("width"), F.lit(h).alias("height"), F.lit(1.0).alias("score"))
    assert one(spark, C.largest_box(F.array(b(1.0, 1.0), b(2.0, 3.0), b(3.0, 2.0))))["width"] == 2.0
    assert one(spark, C.largest_box(F.array(b(1.0, 1.0)))).width == 1.0
    assert one(spark, C.largest_box(F.filter(F.array(b(1.0, 1.0)), lambda x: x.width > 5))) is None


def test_components_and_suppression(spark):
    rows = [(f"f{f}", f"w{w}", 4 + 0.1 * ((f + w) % 5)) for f in range(10) for w in range(8) for _ in range(3)]
    o = spark.createDataFrame(rows, "factory_id string, worker_id string, hal double")
    assert estimation.floor_check(o).first().clears and estimation.variance_components(o).first().evaluable
    lone = estimation.variance_components(o.filter("worker_id = 'w0'")).first()
    assert lone.ratio == float("inf") and not lone.evaluable and not lone.holds
    few = estimation.build_aggregate(o.filter("factory_id < 'f4'"), "corpus").first()
    assert few.hal_mean is None and few.suppressed_reason == "4 factories, floor is 5; 32 workers, floor is 50"
    full = estimation.build_aggregate(o, "corpus")
    assert contracts.violations(full, "aggregate").first().violations in ([], ["contrast"]) and not contracts.identifier_leaks(full).count()
    assert [r.stratum for r in estimation.size_terciles(o).orderBy("factory_id").collect()].count("size_tercile_3") == 4


def test_contracts_name_the_broken_rule(spark):
    good = {"clip_id": "f/w/000001", "factory_id": "f", "worker_id": "w", "clip_index": 1, "byte_start": 0, "byte_end": 5, "duration_s": 1.0, "fps": 30.0, "width": 1, "height": 1, "corpus_rev": "r"}
    for change, rule in (({}, None), ({"clip_id": "x"}, "id matches parts"), ({"byte_end": 0}, "byte range"), ({"corpus_rev": ""}, "revision"), ({"fps": -1.0}, "positive rate")):
        df = contracts.violations(spark.createDataFrame([{**good, **change}]), "clip_ref")
        assert df.first().violations == ([rule] if rule else [])
    with pytest.raises(Exception, match="byte range"):
        contracts.checked(spark.createDataFrame([{**good, "byte_end": 0}]), "clip_ref").collect()
    assert contracts.identifier_leaks(spark.createDataFrame([({"factory_012": 1.0},)], "m map<string,double>")).count() == 1


def test_claims(spark):
    parts = spark.createDataFrame([("h1", "HOLDS"), ("h1", None), ("h2", "FAILED"), ("h2", None), ("h3", "HOLDS")], "parent string, status string")
    assert {r.parent: r.status for r in gates.roll_up_claims(parts).collect()} == {"h1": "UNTESTED", "h2": "FAILED", "h3": "HOLDS"}
    claims = spark.createDataFrame([("a", "s", False)], "claim_id string, statement string, pilot_gate boolean")
    with pytest.raises(Exception, match="unknown status"):
        gates.read_claims(claims, spark.createDataFrame([("a", "MAYBE", 0.0, 1.0)], "claim_id string, status string, lo double, hi double")).collect()
    empty = spark.createDataFrame([], "clip_id string, i int")
    assert gates.shortfall_gate(empty, empty).first().status == "NOT EVALUABLE"


def test_gain_curve_that_recovers_does_not_clear(spark):
    rows = spark.createDataFrame([(5.0, 0.99), (20.0, 0.2), (60.0, 0.95)], "hand_displacement_px double, gain double")
    c = gain.curve_from_rows(rows, geometry.DEPTH_RATIO)
    r = c.select("knee_px", "collapse_px", gain.verdict(F.lit(20.0)).alias("a"), gain.verdict(F.lit(1.0)).alias("b"), gain.verdict(F.lit(5.0)).alias("c")).first()
    assert tuple(r) == (5.0, 20.0, "FAIL", "UNTESTED", "PASS")


def test_geometry(spark):
    cam = geometry.scaled(geometry.CORPUS, 240)
    rays = geometry.unproject(geometry.pixels(spark, cam), cam).filter("valid and x % 16 = 0 and y % 16 = 0")
    back = geometry.project(rays.withColumns({"px": F.col("dx"), "py": F.col("dy"), "pz": F.lit(1.0)}), cam)
    assert back.agg(F.max(F.hypot(F.col("pu") - F.col("x"), F.col("pv") - F.col("y")))).first()[0] < 1e-3
    still = geometry.analytic_flow(spark, cam).filter("valid").agg(F.max(F.hypot("u", "v"))).first()[0]
    assert still < 1e-2
    box = geometry.hand_box(geometry.CORPUS)
    assert 190 < box["width"] < 200
    wide = geometry.floor_mm_s(spark, cam, 10.0).first().floor_mm_s
    narrow = geometry.floor_mm_s(spark, geometry.scaled(geometry.NARROW, 240), 10.0).first().floor_mm_s
    assert wide == pytest.approx(10.09, rel=0.1) and narrow < wide / 20
    rows = spark.createDataFrame([(2.0, 4.0), (1.0, 2.0), (0.0, 0.0)], "m double, floor_mm_s double")
    assert geometry.motion_budget(rows, "m", 23.0).first().motion == 11.5


def test_lens_against_the_model_written_out(spark):
    """Pixels of points by the published lens model: radius t + k0 t^3 + k1 t^5 + k2 t^7 + k3 t^9 of the angle t to the axis."""
    import math

    cam, rng = geometry.CORPUS, np.random.default_rng(2)
    points = [*rng.normal(size=(50, 3)).tolist(), [0.0, 0.0, 1.0], [0.1, 0.2, 0.0]]
    out = geometry.project(spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "i int, px double, py double, pz double"), cam).orderBy("i").collect()
    for (x, y, z), r in zip(points, out):
        z = z if abs(z) > 1e-12 else 1e-12
        t = math.atan(math.hypot(x / z, y / z))
        radius = t + sum(k * t ** (2 * n + 3) for n, k in enumerate(cam.k))
        turn = math.atan2(y / z, x / z)
        assert (r.pu, r.pv) == pytest.approx((cam.fx * radius * math.cos(turn) + cam.cx, cam.fy * radius * math.sin(turn) + cam.cy), abs=1e-6)


def test_gain_sweep_of_an_ideal_and_a_blind_estimator(spark):
    calls = []

    def ideal(first, second):
        calls.append(first.shape)
        field = np.zeros((*first.shape, 2))
        field[..., 0] = 3.0
        return field

    out = geometry.gain_sweep(spark, ideal, width=240, translations=(0.01,)).first()
    assert calls == [(135, 240)] and out.recovered_px == 3.0 and out.gain == pytest.approx(3.0 / out.hand_displacement_px, abs=1e-3)
    assert geometry.gain_sweep(spark, lambda a, b: None, width=240, translations=(0.01,)).first().flow_returned_none


def test_unwrap(spark):
    text = "# T\nline one\ncontinues  \n\n\n\n- item\n  goes on\n- next\n| a | b |\n```\n x \n\ny\n```\n> quote\nmore"
    want = "# T\nline one continues\n\n- item goes on\n- next\n| a | b |\n```\n x \n\ny\n```\n> quote more\n"
    df = spark.createDataFrame([(1, text)], "k int, t string")
    assert textgates.unwrap(df, "k", "t").first().body == want
    assert textgates.strip_title(spark.createDataFrame([(1, "# T\n\n\nx")], "k int, t string"), "k", "t").first().body == "x"


def test_probe_needs_two_classes_and_one_width(spark):
    rows = spark.createDataFrame([(i, [float(i % 2), 0.5 * (i % 3)], i % 2) for i in range(60)], "frame_id int, features array<double>, y int")
    assert probe.beats_majority(probe.cross_validated_fidelity(rows, 2)).first().passes
    with pytest.raises(ValueError):
        probe.fit(rows.filter("y = 1"), 2)
    with pytest.raises(ValueError):
        probe.fit(rows, 3)


def test_release_helpers(spark):
    assert release.card("a {{x}} {{y}}", {"x": 1, "y": "z"}) == "a 1 z"
    with pytest.raises(KeyError):
        release.card("{{x}}", {})
    assert release.rewrite(spark.createDataFrame([("import a.b",)], "s string"), "s", [(r"a\.b", "c")]).first().s == "import c"


def test_plan_of_short_clips(spark):
    clips = spark.createDataFrame([("a", 0.2, 30.0), ("b", 59.0, 30.0), ("c", 60.0, 30.0)], "clip_id string, duration_s double, fps double")
    assert {r.clip_id for r in plan.sample_times(clips).collect()} == {"b", "c"} and {r.clip_id for r in plan.plan_pairs(clips).collect()} == {"c"}
    one_instant = spark.createDataFrame([("a", 0.0)], "clip_id string, t_s double")
    assert plan.rate_of(one_instant).first().hz is None
    assert K.BOOTSTRAP_B == 10_000


def test_knees_of_the_published_sweep(spark):
    # published sweep, fixed values: frame width, displacement in px, gain
    rows = [
        (480, 2.849, 0.9429), (480, 5.698, 0.964), (480, 11.395, 0.7656), (480, 17.086, 0.2212), (480, 22.759, 0.1705),
        (960, 5.7, 0.9973), (960, 11.399, 0.9973), (960, 22.794, 0.9925), (960, 34.181, 0.2024), (960, 45.539, 0.2323),
        (1440, 8.549, 0.9971), (1440, 17.098, 0.9964), (1440, 34.191, 0.2036), (1440, 51.271, 0.199),
    ]
    out = {r.width: r for r in gain.curve_from_rows(spark.createDataFrame(rows, "width int, hand_displacement_px double, gain double"), 0.18, ["width"]).collect()}
    assert {w: (r.knee_px, r.collapse_px) for w, r in out.items()} == {480: (5.698, 17.086), 960: (22.794, 34.181), 1440: (17.098, 34.191)}
    assert all(r.tracks_background for r in out.values())
