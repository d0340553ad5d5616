"""Exact dedup, Jaccard join and suffix dedup against brute force."""

import hashlib
import re
import uuid
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from motilis.llm import exact_dedup, induced_sort, jaccard_join, suffix_dedup
from motilis.llm.shingles import sets

from .conftest import odd_rows, rows_of


def test_exact_dedup_decides_as_brute_force(odd, odd_wide, none):
    text = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    groups = defaultdict(list)
    for r in odd_rows():
        groups[text(r[1])].append(r[0])
    out = exact_dedup.dedup_decisions(odd).collect()
    assert len(out) == len(odd_rows())
    by_digest = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    kept = Counter()
    for r in out:
        ids = by_digest[r.text_sha256]
        assert r.group_size == len(ids)
        assert r.keep_id == min((i for i in ids if i is not None), default=None)
        kept[r.text_sha256] += r.kept
    assert set(kept.values()) == {1}
    assert rows_of(exact_dedup.dedup_decisions(odd_wide)) == rows_of(exact_dedup.dedup_decisions(odd))
    assert exact_dedup.dedup_decisions(none).count() == 0


def test_exact_dedup_splits_heavy_hitters(spark):
    rows = [(i, "hot" if i % 3 else f"t{i % 50}") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for heavy, tracked in ((1, 4), (256, 2048)):
        out = {r.doc_id: r for r in exact_dedup.dedup_decisions(df, heavy, tracked).collect()}
        assert all(out[i].keep_id == min(j for j, u in rows if u == t) and out[i].group_size == sum(u == t for _, u in rows) for i, t in rows)


def test_dedup_keeps_one_row_with_its_columns(odd, odd_wide):
    out = exact_dedup.dedup(odd)
    assert out.columns == odd.columns
    assert out.count() == len({re.sub("[\x20\x09-\x0d]+", " ", r[1] or "") for r in odd_rows()})
    assert exact_dedup.dedup(odd_wide).columns == odd_wide.columns


def brute_shingles(t):
    w = (t or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_jaccard_join_finds_every_link(odd, odd_wide, none):
    rows = odd_rows()
    s = [brute_shingles(r[1]) for r in rows]
    links = [{j for j in range(len(rows)) if j != i and s[i] and len(s[i] & s[j]) >= 0.8 * len(s[i] | s[j])} for i in range(len(rows))]
    want = sorted((repr(r[0]), len(k)) for r, k in zip(rows, links))
    out = jaccard_join.jaccard_classes(odd).collect()
    assert sorted((repr(r.doc_id), r.n_links) for r in out) == want
    one = {r.doc_id: r for r in out}
    assert one[1].class_id == one[2].class_id == one[3].class_id == 1 and one[1].class_size == 3
    assert one[9].class_id == 9 and one[10].class_id == 9
    assert one[7].class_size == 1 and one[7].n_links == 0
    assert rows_of(jaccard_join.jaccard_classes(odd_wide)) == rows_of(jaccard_join.jaccard_classes(odd))
    assert jaccard_join.jaccard_classes(none).count() == 0
    kept = jaccard_join.drop_near_copies(odd_wide)
    assert kept.columns == odd_wide.columns
    assert {r.doc_id for r in kept.collect()} >= {1, 4, 7, 8, 9, 11} and not {2, 3, 5, 10} & {r.doc_id for r in kept.collect()}


def test_near_copies_of_repeated_and_null_ids(spark):
    text = lambda k: " ".join(f"{k}w{i}" for i in range(120))
    near = text("a").replace("aw60", "edited")
    rows = [
        *((None, text(f"n{k}"), k) for k in range(30)), (None, text("n3"), 30), (None, text("n4").replace(" ", "\n", 2), 31),  # of null ids each text once
        (1, text("a"), 40), (2, text("b"), 41), (2, near, 42), (2, text("c"), 43), (3, text("d"), 44), (3, text("d"), 45), (3, text("e"), 46),
        (0, text("g"), 47), (4, text("g"), 48), (4, text("h"), 49), (5, "", 50), (5, None, 51), (5, "", 52),
    ]
    kept = jaccard_join.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string, row long").coalesce(1)).collect()
    at = sorted(r.row for r in kept)
    assert len(at) == len(set(at)) and sum(r in at for r in (3, 30)) == 1 and sum(r in at for r in (4, 31)) == 1 and sum(r in at for r in (44, 45)) == 1
    assert set(at) - {3, 30, 4, 31, 44, 45} == {*range(30), 40, 41, 43, 46, 47, 49, 50, 51, 52} - {3, 4}


def test_jaccard_join_of_a_group_beyond_one_block(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    monkeypatch.setattr(jaccard_join, "BUCKET_BLOCK", 8)
    base = [f"v{i}" for i in range(200)]
    rows = []
    for i in range(40):
        w = list(base)
        w[(7 * i) % 200] = f"edit{i}"
        rows.append((i, " ".join(w)))
    out = jaccard_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    s = {i: brute_shingles(t) for i, t in rows}
    for r in out:
        assert r.n_links == sum(j != r.doc_id and len(s[j] & s[r.doc_id]) >= 0.8 * len(s[j] | s[r.doc_id]) for j in s)
        assert r.class_id == 0 and r.class_size == 40


def test_shingles_agree_with_tuples(odd):
    import pyarrow as pa

    texts = [r[1] or "" for r in odd_rows()] + ["a b", "  a  b ", "a b c d e", "a b c d e f"]
    got = sets(pa.array(texts))
    table = {}
    for t, h in zip(texts, got):
        assert len(h) == len(brute_shingles(t))
        assert table.setdefault(frozenset(brute_shingles(t)), h.tobytes()) == h.tobytes()
    assert len({v for v in table.values()}) == len(table)


def test_pruning_keeps_pairs_at_the_threshold():
    rng, least = np.random.default_rng(1), jaccard_join.fewest_matches()
    hits = rng.random((20_000, jaccard_join.COMPARED)) < 0.8
    kept = np.ones(len(hits), bool)
    for k, m in enumerate(least):
        kept &= hits[:, : (k + 1) * jaccard_join.STEP].sum(1) >= m
    assert kept.mean() > 0.9995
    assert (rng.random((2000, jaccard_join.COMPARED)) < 0.4).sum(1).max() < least[-1] + 10


def brute_removed(texts, length):
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((len(t), int(gone.sum()), int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if t else 0, hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_dedup_removes_as_brute_force(odd, odd_wide, none):
    rows = odd_rows()
    want = sorted(((repr(r[0]), *x) for r, x in zip(rows, brute_removed([(r[1] or "").encode() for r in rows], 400))), key=repr)
    for df in (odd, odd_wide):
        assert sorted(((repr(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup_digests(df).collect()), key=repr) == want
    assert suffix_dedup.dedup_digests(none).count() == 0
    spilled = suffix_dedup.dedup_digests(odd, shard_bytes=1, queue_bytes=256)
    assert sorted(((repr(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in spilled.collect()), key=repr) == want


def test_suffix_dedup_of_a_shard_beyond_its_queues(spark):
    """One key with many surroundings, cut into pieces or sorted whole over queues a fraction of the shard's size."""
    rng = np.random.default_rng(3)
    letters = lambda n: bytes(rng.integers(97, 123, n).astype(np.uint8)).decode()
    passage = letters(700)
    rows = [(i, letters(int(rng.integers(0, 60))) + passage + letters(int(rng.integers(0, 60)))) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(40)] + [(400, letters(5000))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = sorted((i, *x) for (i, _), x in zip(rows, brute_removed([t.encode() for _, t in rows], 400)))
    keyed = suffix_dedup.id_text(df).withColumn("tk", F.xxhash64("text"))
    for how in ({"hot": 20}, {"hot": 10**9, "shard_bytes": 1 << 30, "queue_bytes": 1 << 14}):
        assert sorted(tuple(r) for r in suffix_dedup.dedup_digests(df, **how).collect()) == want
    _, found = suffix_dedup.found_ranges(keyed, hot=10**9, shard_bytes=1 << 30, queue_bytes=1 << 14)
    assert found.agg(F.max("spilled")).first()[0] > 5
    _, found = suffix_dedup.found_ranges(keyed, hot=20)
    assert found.groupBy("key").count().agg(F.max("count")).first()[0] < 60


@pytest.mark.parametrize("bytes_long", [200, 380, 399, 400, 401, 450, 900])
def test_passages_are_removed_from_400_bytes_on(spark, bytes_long):
    rng = np.random.default_rng(bytes_long)
    prose = lambda n: " ".join("".join(chr(c) for c in rng.integers(97, 123, rng.integers(2, 9))) for _ in range(n))
    passage = prose(300)[:bytes_long]
    rows = [(i, prose(80) + chr(33 + i // 3) + passage + chr(33 + i // 3) + prose(50) if i % 3 == 0 else prose(150)) for i in range(60)]
    out = {r.doc_id: r for r in suffix_dedup.dedup_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, _ in rows:
        assert (out[i].n_removed >= bytes_long) == (bytes_long >= 400 and i % 3 == 0) and (out[i].n_removed > 0) == (out[i].n_removed >= bytes_long)


def test_long_repeats_are_sorted_without_their_overlaps(spark, tmp_path, monkeypatch):
    """Parts that follow one another in a repeated passage go through the sort as one text: about the bytes of both copies, not five times as many."""
    real = suffix_dedup.repeated_starts

    def noted(segments, *rest):
        (tmp_path / uuid.uuid4().hex).write_text(str(sum(len(x) for x in segments)))
        return real(segments, *rest)

    monkeypatch.setattr(suffix_dedup, "repeated_starts", noted)
    rng = np.random.default_rng(11)
    letters = lambda n: bytes(rng.integers(97, 123, n).astype(np.uint8)).decode()
    long, passage = letters(150_000), letters(3000)
    rows = [(1, long), (None, long), (3, letters(700) + passage + letters(90)), (4, passage + letters(50) + passage), (5, passage[:1500] + "#" + passage[1500:]), (6, letters(900)), (6, "ab" * 2000), (7, letters(80) + long[40_000:90_000])]
    rows += [(8, rows[2][1]), (8, rows[2][1]), (9, long[90_001:] + long[:20_000])]
    got = suffix_dedup.dedup_digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = [(repr(i), *x) for (i, _), x in zip(rows, brute_removed([t.encode() for _, t in rows], 400))]
    assert sorted((repr(r.doc_id), *tuple(r)[1:]) for r in got) == sorted(want)
    assert 2 * len(long) < sum(int(f.read_text()) for f in tmp_path.iterdir()) < 3 * len(long)


def test_recursion_spills_too(tmp_path):
    rng = np.random.default_rng(5)
    t = np.concatenate([np.tile(rng.integers(1, 4, 60), 40), rng.integers(1, 4, 3000), [0]])
    for budget in (1 << 28, 512):
        assert induced_sort.suffix_order(t, 1 << 13, 4, budget, str(tmp_path)).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())
    assert not list(tmp_path.iterdir())


@pytest.mark.parametrize("seed", range(8))
def test_induced_sort_orders_suffixes(seed):
    rng = np.random.default_rng(seed)
    for _ in range(25):
        t = np.concatenate([rng.integers(1, rng.integers(2, 7), rng.integers(1, 150)), [0]])
        if seed % 2:
            t = np.concatenate([np.tile(t[:-1][: max(1, len(t) // 7)], 6), [0]])
        ranked = t.tolist()
        assert induced_sort.suffix_order(t, 1 << 12, least=4 if seed % 3 else 1 << 12).tolist() == sorted(range(len(t)), key=lambda i: ranked[i:])


def test_queue_spills_and_keeps_the_order(tmp_path):
    q = induced_sort.BucketQueue(200, str(tmp_path))
    want = []
    for k in range(30):
        at = np.arange(k * 2000, k * 2000 + 1500)
        want += at.tolist()
        q.push(3, at, np.zeros(1500, np.uint16))
    got = []
    while (chunk := q.pop(3)) is not None:
        got += chunk[0].tolist()
    assert q.spilled > 5 and got == want and not list(tmp_path.iterdir())


def test_tables_are_broadcast_by_their_bytes(spark):
    from motilis.llm.common import sized

    rows = spark.createDataFrame([(i, "é" * 10) for i in range(100)], "a long, b string")  # 100 rows of 32 bytes and 20 of text
    marked = lambda most: "hint" in sized(rows, most)._jdf.queryExecution().logical().toString().lower()
    assert marked(5200) and not marked(5199)


def test_rows_that_stay_do_not_depend_on_the_join(spark, odd):
    drops = (exact_dedup.dedup, jaccard_join.drop_near_copies)
    before = [rows_of(f(odd)) for f in drops]
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert [rows_of(f(odd.repartition(5))) for f in drops] == before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_of_one_doc_id_the_same_row_stays_at_every_run(spark):
    rows = [(1, "a b", "x"), (1, "a\tb", "y"), (1, "a  b", "z"), (1, "a b", "x"), (2, "a b", "x"), (3, "c", None), (3, "c", "w"), (None, "d", "x"), (None, "d", "y"), (None, "d", "y")]
    kept = {tuple(rows_of(exact_dedup.dedup(spark.createDataFrame(rows if n % 2 else rows[::-1], "doc_id long, text string, lang string").repartition(n)))) for n in (1, 2, 3, 5)}
    assert len(kept) == 1 and sorted(str(r[0]) for r in next(iter(kept))) == ["1", "3", "None"]
