"""Mixing, quality, language model and tool calls."""

import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from motilis.llm import maxent_lm, mixing, quality, tool_calls

from .conftest import odd_rows, rows_of, words


def test_targets_share_again_what_caps_cut_off():
    out = mixing.targets([100, 10, 1000], [5, 2, 1], 1.5 * 1110)
    assert out[0] == 200 and out[1] == 20 and out[2] == pytest.approx(1665 - 220)
    assert mixing.targets([], [], 0) == [] and mixing.targets([0, 10], [5, 2], 15) == [0, 15]


def test_flight_keeps_totals():
    rng = np.random.default_rng(1)
    sizes, p = rng.integers(1, 500, 300).astype(float).tolist(), [0.3] * 300
    out = mixing.flight(sizes, p, rng.random)
    assert sum(mixing.EPS < x < 1 - mixing.EPS for x in out) <= 2
    assert sum(out) == pytest.approx(90, abs=1e-6) and np.dot(out, sizes) == pytest.approx(0.3 * sum(sizes), abs=1e-4)
    whole = mixing.landing(sizes, out)
    assert set(whole) <= {0.0, 1.0} and abs(np.dot(whole, sizes) - 0.3 * sum(sizes)) < 500


def test_flight_keeps_each_rate_in_the_mean():
    # landing rounds the last two for closeness; the flight before it is fair to every unit
    rng, total, sizes = np.random.default_rng(2), np.zeros(12), [float(s) for s in range(5, 65, 5)]
    for _ in range(3000):
        total += mixing.flight(sizes, [0.25] * 12, rng.random)
    assert np.abs(total / 3000 - 0.25).max() < 0.05


@pytest.mark.parametrize("block", [4, 4096])
def test_mix_meets_targets(spark, block):
    rng = random.Random(5)
    rows = [(i, words(rng, rng.randint(1, 60)), "abc"[min(2, i % 7)]) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix_decisions(df, block=block).collect()
    by = defaultdict(lambda: [0, 0.0])
    for r in out:
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
        by[r.source][0] += r.taken
        by[r.source][1] = r.target
    assert all(abs(t - want) <= 60 for t, want in by.values())
    for name in "abc":  # documents are balanced along with words: as many copies as the source's rate asks for, worked out by hand
        own = [len(t.split()) for _, t, s in rows if s == name]
        copies = sum(r.copies for r in out if r.source == name)
        assert abs(copies - by[name][1] / sum(own) * len(own)) <= 3
    sizes = {s: sum(len(t.split()) for _, t, x in rows if x == s) for s in "abc"}
    assert [by[s][1] for s in "abc"] == pytest.approx(mixing.targets(list(sizes.values()), [5, 2, 1], 1.5 * sum(sizes.values())))
    assert {r.doc_id: r.size for r in out} == {i: len(t.split()) for i, t, _ in rows} and all(r.source_size == sizes[r.source] for r in out)
    assert sorted(out) == sorted(mixing.mix_decisions(df.repartition(5), block=block).collect())
    assert mixing.mix(df, block=block).count() == sum(r.copies for r in out)


def test_mix_of_odd_rows(odd, odd_wide, none):
    out = mixing.mix_decisions(odd)
    assert out.count() == len(odd_rows())
    assert [r.size for r in out.filter("doc_id = 6").collect()] == [0]
    assert rows_of(out) == rows_of(mixing.mix_decisions(odd_wide)) and mixing.mix_decisions(none).count() == 0
    mixed = mixing.mix(odd_wide)
    assert mixed.columns == odd_wide.columns and mixed.count() == sum(r.copies for r in out.collect())


def test_documents_of_one_id_are_spread_over_blocks(spark, monkeypatch):
    fly = mixing._fly
    rows = [(None if i % 3 else 7, "same words again" if i % 2 else " ".join(["w"] * (i % 90)) + f" x{i}", "a") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")

    def watched(level, land, seed):
        run = fly(level, land, seed)

        def told(pdf):
            assert level or len(pdf) < 400
            return run(pdf)

        return told

    monkeypatch.setattr(mixing, "_fly", watched)
    out = mixing.mix_decisions(df, block=256, share=1.5).collect()
    assert len(out) == 4000 and abs(sum(r.taken for r in out) - out[0].target) < 100
    assert sorted(map(tuple, out), key=repr) == sorted(map(tuple, mixing.mix_decisions(df.repartition(7), block=256).collect()), key=repr)


def test_mix_does_not_depend_on_the_join(spark, odd):
    want = rows_of(mixing.mix(odd).select("doc_id", "source"))
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert rows_of(mixing.mix(odd).select("doc_id", "source")) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def quality_rows(n=400):
    rng, rows, labels = random.Random(3), [], []
    for i in range(n):
        bad = i % 5 == 0
        text = " ".join([f"junk{i % 3}!!"] * 50) if bad else words(rng, 80) + "."
        rows.append((i, text, "en", f"s{i % 4}", len(text)))
        if i % 2 == 0:
            labels.append((i, int(not bad), 0))
    return rows, labels


def test_quality_separates_and_keeps(spark):
    rows, labels = quality_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in quality.scores(docs, labels).collect()}
    assert len(out) == len(rows) and np.mean([out[i].accepted == (i % 5 != 0) for i in out]) > 0.97
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i in out if out[i].accepted)


def test_quality_of_rows_held_out(spark, sf):
    """Labels that were not learnt from are met, and layout and record alone do better than chance where they say anything."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    apart = "pmod(xxhash64(doc_id, 5L), 3) = 0"
    out = quality.scores(docs, labels.filter(f"not {apart}")).join(labels.filter(apart), "doc_id").collect()
    good, bad = [r.score for r in out if r.quality], [r.score for r in out if not r.quality]
    assert len(good) > 10 and np.mean([s >= quality.REJECT for s in good]) > 0.95
    assert np.mean([g > b for g in good for b in bad]) > 0.97


def test_cotraining_exchanges_labels():
    rng = np.random.default_rng(4)
    y = np.arange(400) % 2
    view = lambda: ((y[:, None] * 2 - 1) * 0.8 + rng.normal(size=(400, 6))).astype(np.float32)
    x, few, met = [view(), view()], np.arange(400) < 120, []
    free = ~few

    def exchange(models, scale):
        out = []
        for v in (0, 1):
            p = quality.sigmoid(scale[v][0] * quality.odds(x[v], models[v]) + scale[v][1])
            at = np.flatnonzero(free & (np.abs(p - 0.5) > 0.4))[:30]
            free[at] = False
            met.append((v, len(at)))
            out.append(((x[0][at], x[1][at]), (p[at] > 0.5).astype(float)))
        return out

    model = quality.cotrain((x[0][few], x[1][few]), y[few].astype(float), np.arange(120) % 3 == 0, exchange)
    *_, c = quality.combine(model, quality.odds(x[0], model["models"][0]), quality.odds(x[1], model["models"][1]))
    assert ((c > 0.5) == (y > 0)).mean() > 0.93 and len(met) == 2 * quality.ROUNDS and {v for v, n in met if n} == {0, 1}


def test_cotraining_scores_the_whole_pool(spark):
    """What is learnt does not hang on how rows are dealt out, and the pool's pseudo-labels move the weights."""
    rows, labels = quality_rows(1200)
    table = quality.features(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    one = quality.learn_from(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    again = quality.learn_from(table.repartition(7), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    none = quality.learn_from(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rounds=0)
    assert all(np.allclose(a, b, atol=1e-6) for a, b in zip(one["models"], again["models"]))  # however rows are dealt out
    assert not np.allclose(one["models"][1], none["models"][1], atol=1e-3)


def test_quality_of_odd_rows(spark, odd, odd_wide, none):
    labels = spark.createDataFrame([(1, 1, 0), (4, 1, None), (9, 0, 0), (12, 0, 0), (16, 1, 0), (None, 1, 0), (99, None, 0)], "doc_id long, quality int, toxic int")
    out = quality.scores(odd, labels)
    near = lambda df: sorted((repr(r.doc_id), round(r.score, 5), r.accepted) for r in df.collect())  # noqa: E731  sums round as batches fall
    assert out.count() == len(odd_rows()) and near(out) == near(quality.scores(odd_wide, labels))
    assert quality.scores(none, labels).count() == 0
    assert quality.learn(odd, labels.limit(0)) is None and quality.scores(odd, labels.limit(0)).filter("accepted").count() == len(odd_rows())
    assert quality.keep_good(odd_wide, labels).columns == odd_wide.columns
    assert quality.scores(odd.drop("n_chars"), labels).count() == len(odd_rows())


def lm_reference(rows):
    tokens = [[*(r[1] or "").encode().lower().split(), b""] for r in rows]
    held = [zlib.crc32(b"" if r[0] is None else str(r[0]).encode()) % 7 == 2 for r in rows]
    c = Counter(t for w, h in zip(tokens, held) if not h for t in w)
    n, v = sum(c.values()), len(c)
    return [(repr(r[0]), h, len(w), sum(c[t] > 0 for t in w), n, round(sum(math.log10((c[t] + 1) / (n + v + 1)) for t in w), 6)) for r, w, h in zip(rows, tokens, held)]


@pytest.mark.parametrize("heavy", [5, 1 << 18])
def test_lm_base_scores(odd, heavy):
    out = maxent_lm.score(odd, heavy=heavy).collect()
    assert sorted((repr(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == sorted(lm_reference(odd_rows()))
    assert all(math.isfinite(r.score) and r.score <= 1e-9 for r in out)


def test_lm_odd_tables(spark, odd, odd_wide, none):
    assert rows_of(maxent_lm.score(odd_wide).select("doc_id", "n_tokens", "base_score")) == rows_of(maxent_lm.score(odd).select("doc_id", "n_tokens", "base_score"))
    assert maxent_lm.score(none).count() == 0
    alone = next(i for i in range(100) if maxent_lm.held_out(i))
    (r,) = maxent_lm.score(spark.createDataFrame([(alone, "a b")], "doc_id long, text string")).collect()
    assert (r.n_known, r.train_tokens, r.base_score) == (0, 0, 0.0) and math.isfinite(r.score)


def test_lm_learns_word_order(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(x for _ in range(60) for x in rng.choice((["a1", "b1"], ["c1", "d1"], ["e1", "f1"])))) for i in range(300)]
    out = maxent_lm.score(spark.createDataFrame(rows, "doc_id long, text string")).filter("held_out").collect()
    gain = np.mean([(r.score - r.base_score) / r.n_tokens for r in out])
    assert gain > 0.15  # half of the words follow from the word before


def test_lm_rounds_take_all_training_documents(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abcdefgh") + str(rng.randrange(1 + i % 9)) for _ in range(40)) for i in range(80)]
    ids = [i for i in range(200) if not maxent_lm.held_out(i)]
    score = lambda ids: np.sort([r.score for r in maxent_lm.score(spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")).collect()])
    apart = score(ids)
    assert score([ids[0]] * len(texts)) == pytest.approx(apart, abs=1e-3)  # what is learnt does not hang on how doc_ids fall
    assert score([None] * len(texts)) == pytest.approx(apart, abs=1e-3)


def trained(spark, rows, rounds=2):
    docs = maxent_lm.id_text(spark.createDataFrame(rows, "doc_id long, text string"))
    top = sorted(((bytes(r.token), r.c) for r in maxent_lm.count_tokens(docs).collect()), key=lambda x: (-x[1], x[0]))
    tokens, counts = [t for t, _ in top], np.array([c for _, c in top], float)
    encoded = maxent_lm.cut(maxent_lm.encode(docs, spark.sparkContext.broadcast(tokens)))
    none = spark.createDataFrame([], "token binary, c long")
    return maxent_lm.train(encoded, tokens, counts, none, int(counts.sum()), rounds), tokens, counts


def test_lm_probabilities_sum_to_one(spark):
    """After any history the known tokens and the unknown word of each part share a probability of 1."""
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(["the", "of", "a"]) + " " + words(rng, 3, 900) for _ in range(25))) for i in range(150)]
    m, tokens, counts = trained(spark, rows)
    discount, total, unknown = maxent_lm.word_factors(m["stats"])
    code = m["codes"][: len(tokens)]
    leaf, of_leaf = m["leaf"][code], {}
    for c in range(len(m["leaf"])):
        if m["stats"][m["leaf"][c], 3] > 0 or m["stats"][m["leaf"][c], 0] > 0:
            of_leaf.setdefault(int(m["leaf"][c]), c)
    assert len(of_leaf) > 60
    seen = []
    for _ in range(20):
        one, two, three = (np.int64(rng.choice([*code[:40].tolist(), len(m["leaf"])])) for _ in range(3))
        p = lambda codes: np.exp(maxent_lm.log_factors(m, np.array(codes), *(np.full(len(codes), x) for x in (one, two, three))))
        known = p(code) * np.maximum(counts - discount[leaf], 1e-12) / 10 ** total[leaf]
        open_ = [x for x in of_leaf if m["stats"][x, 3] > 0]
        rest = p([of_leaf[x] for x in open_]) * 10 ** unknown[open_]
        assert known.sum() + rest.sum() == pytest.approx(1, abs=1e-4)
        seen.append(known[:30])
    assert np.std(seen, axis=0).max() > 0.01  # what comes next hangs on the history


def test_lm_training_raises_the_likelihood(spark):
    rng = random.Random(10)
    rows = [(i, " ".join(x for _ in range(40) for x in rng.choice((["a1", "b1", "z"], ["c1", "b1", "y"], ["e1", "f1"])))) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    mean = [np.mean([r.score for r in maxent_lm.score(df, rounds=k).filter("held_out").collect()]) for k in (0, 2)]
    assert mean[1] > mean[0]  # "z" or "y" after "b1" hangs on the word two before: a skip feature


def test_lm_table_grows_with_the_corpus():
    sizes = [maxent_lm.table_rows(n) for n in (0, 10**6, 10**8, 10**10, 10**12, 10**16)]
    assert sizes == sorted(sizes) and sizes[0] == maxent_lm.LEAST_ROWS and sizes[3] > 4 * sizes[2] and sizes[-1] == maxent_lm.MOST_ROWS


def tool_call(i, after=None, **more):
    return "<tool_call>" + json.dumps({"id": i, "name": "reply", "arguments": {"prompt": "x", "turn": 1, **({"after": [{"$ref": after}]} if after else {}), **more}}) + "</tool_call>"


def test_tool_calls_link_and_order(spark):
    call, user = tool_call, '<tool_call>{"id":"u","name":"reply","arguments":{"prompt":"","turn":2}}</tool_call>'
    rows = [
        (1, 0, "assistant", call("b", "a") + call("a")), (1, 1, "tool", '<tool_response>{"id":"a","content":{"z":1.0,"a":[true,null]}}</tool_response>'),
        (2, 0, "assistant", call("p", "q") + call("q", "p") + call("r")), (2, 1, "tool", '<tool_response>{"id":"lost","content":1}</tool_response>'),
        (3, 0, "user", call("h")), (3, 1, "tool", '<tool_response>{"id":"h","content":"ho"}</tool_response>'), (3, 2, "user", user), (3, 0, "user", call("h")), (3, 5, "user", None), (3, 6, "user", "no tags"),
        (None, 0, "user", call("x")), (4, None, None, None), (5, 0, "assistant", "<tool_call>{bad</tool_call>" + call("s", "nowhere")),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {(r.conv_id, r.call_id, r.status): r for r in tool_calls.link_tool_calls(df).collect()}
    a = out[1, "a", "linked"]
    assert (a.seq, a.valid) == (0, True) and out[1, "b", "unanswered"].seq == 1
    assert a.record == '{"arguments":{"prompt":"x","turn":1},"conversation":1,"id":"a","name":"reply","order":0,"result":{"a":[true,null],"z":1}}'
    assert out[2, "r", "unanswered"].seq == 0 and out[2, "p", "unanswered"].errors == ["cycle"] and (2, "lost", "orphan") in out
    assert out[3, "h", "linked"].valid and (3, "h", "duplicate call") in out and out[3, "u", "unanswered"].errors == ["$.prompt: size 0"]
    assert out[5, "s", "unanswered"].errors == ["unknown reference nowhere"] and [r.errors for k, r in out.items() if k[0] == 5 and k[1].startswith("malformed-0-0-")] == [["malformed"]]
    assert (None, "x", "unanswered") in out
    assert all(json.loads(r.record) for r in out.values())
    wide = df.withColumns({c: F.lit(1).cast(k) for c, k in {"rid": "long", "k": "long", "kind": "string", "call_id": "string", "copy": "int", "at": "long", "part": "long", "payload": "string", "refs": "string", "seq": "long", "n": "long"}.items()})
    assert rows_of(tool_calls.link_tool_calls(wide)) == rows_of(tool_calls.link_tool_calls(df))


def test_malformed_calls_have_ids_of_their_own(spark):
    rows = [(1, 3, "user", "<tool_call>{bad</tool_call>"), (1, 3, "user", "<tool_call>{worse</tool_call>"), (1, 3, "user", "<tool_call>{bad</tool_call>"), (1, 3, "user", tool_call("malformed-3-0")), (2, 0, "user", tool_call("big", turn=1).replace('"turn": 1', '"turn": 1e999'))]
    out = tool_calls.link_tool_calls(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    told = sorted((r.conv_id, r.call_id[:13], r.status, r.errors[:1]) for r in out)
    assert told == [(1, "malformed-3-0", "duplicate call", ["malformed"]), (1, "malformed-3-0", "unanswered", []), (1, "malformed-3-0", "unanswered", ["malformed"]), (1, "malformed-3-0", "unanswered", ["malformed"]), (2, "malformed-0-0", "unanswered", ["malformed"])]
    assert len({r.call_id for r in out}) == 4 and all(json.loads(r.record) for r in out)


def test_tool_calls_nested_and_long(spark):
    depths = [1, 150, 199, 201, 500, 2000, 20_000, 100_000]
    rows = [(1, d, "user", tool_call(f"d{d}", x=0).replace('"x": 0', '"x": ' + "[" * d + "]" * d)) for d in depths]
    rows.append((1, 7, "user", tool_call("long", prompt="y" * 3_000_000)))
    out = {r.turn: r for r in tool_calls.link_tool_calls(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert len(out) == len(rows)
    for d in depths:  # the payload itself is two levels around the arrays
        assert (out[d].errors == ["malformed"]) == (d + 2 > tool_calls.DEEPEST + 1), d
        assert json.loads(out[d].record) if d < 500 else out[d].record
    assert len(out[7].record) > 3_000_000


def linked_by_hand(turns):
    """Rows of link_tool_calls() over turns with tags, worked out one conversation at a time."""
    of, out = defaultdict(list), []
    for conv, turn, text in turns:
        for k, (kind, body) in enumerate(re.findall(r"<tool_(call|response)>(.*?)</tool_\1>", text or "", re.S)):
            of[conv].append((turn, k, kind, json.loads(body)))
    for conv, found in of.items():
        calls, results = {}, {}
        for turn, k, kind, x in sorted(found, key=lambda e: (e[0], e[1], json.dumps(e[3], sort_keys=True))):
            if x["id"] in (own := calls if kind == "call" else results):
                out.append((conv, x["id"], turn, None, f"duplicate {kind}", False))
            else:
                own[x["id"]] = (turn, x)
        needs = {i: [r["$ref"] for r in x["arguments"].get("after", [])] for i, (_, x) in calls.items()}
        order, left = [], dict.fromkeys(calls)
        while free := next((i for i in left if all(d not in left for d in needs[i])), None):
            order.append(free)
            del left[free]
        order += left
        for i, (turn, x) in calls.items():
            a = x["arguments"]
            errors = ["prompt"] * (not a["prompt"]) + ["turn"] * (not isinstance(a["turn"], int)) + ["loud"] * ("loud" in a) + [d for d in needs[i] if d not in calls] + ["cycle"] * (i in left)
            out.append((conv, i, turn, order.index(i), "linked" if i in results else "unanswered", not errors and i in results))
        out += [(conv, i, turn, None, "orphan", False) for i, (turn, _) in results.items() if i not in calls]
    return out


def test_tool_calls_of_the_whole_table(spark, sf):
    sf = sf.replace("0.001", "0.01")
    turns = tool_calls.tool_turns(spark.read.parquet(f"{sf}/conversations.parquet"))
    want = linked_by_hand([tuple(r) for r in turns.collect()])
    out = tool_calls.op2_tool_calls(spark, sf).collect()
    assert sorted(((r.conv_id, r.call_id, r.turn, r.seq, r.status, r.valid) for r in out), key=repr) == sorted(want, key=repr)
    said = Counter(e.split(" turn")[0] for r in out for e in r.errors)
    assert {"cycle", "unknown reference", "$.turn: not integer", "$.loud: unexpected"} <= set(said)
    assert {r.status for r in out} == {"linked", "unanswered", "orphan", "duplicate call", "duplicate response"}
    straight = [r for r in out if r.seq is not None]
    assert any(a.conv_id == b.conv_id and a.turn < b.turn and a.seq > b.seq and "cycle" not in a.errors for a in straight for b in straight)
    assert tool_calls.link_tool_calls(turns.limit(0)).count() == 0


def test_validation():
    schema = {"type": "object", "properties": {"a": {"type": ["integer", "null"], "minimum": 2}, "b": {"type": "array", "items": {"enum": ["x"]}, "maxItems": 1}}, "required": ["a"], "additionalProperties": False}
    assert tool_calls.validate({"a": 2, "b": ["x"]}, schema) == [] and tool_calls.validate({"a": None}, schema) == []
    assert tool_calls.validate({"a": 1, "c": 0}, schema) == ["$.a: out of range", "$.c: unexpected"]
    assert tool_calls.validate({"b": ["y", "x"]}, schema) == ["$.a: missing", "$.b[0]: not in enum", "$.b: size 2"]
    assert tool_calls.validate({"a": True}, schema) == ["$.a: not integer or null"]


def test_topological_order_against_brute_force():
    rng = random.Random(2)
    for _ in range(200):
        n = rng.randint(1, 8)
        ids = [f"c{i}" for i in range(n)]
        needs = [rng.sample([*ids, "?"], rng.randint(0, 2)) for _ in ids]
        position, stuck = tool_calls.topological(ids, needs)
        assert sorted(position) == list(range(n))
        for i, deps in enumerate(needs):
            for d in deps:
                if d in ids and not stuck[i]:
                    assert position[ids.index(d)] < position[i]
