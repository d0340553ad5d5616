"""Importance resampling against plain counting, its SQL, and odd tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from motilis.llm import importance

from .conftest import rows_of


def features(text, k=importance.BUCKETS):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    return [zlib.crc32(f.encode()) % k for f in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))]]


def told(docs, target, percent=25, least=20, k=importance.BUCKETS):
    own, aim = [features(t, k) for _, t in docs], Counter(b for t in target for b in features(t, k))
    s = Counter(b for f in own for b in f)
    total, aimed = sum(s.values()), sum(aim.values())
    gain = {b: math.floor(1000 * math.log((aim[b] + 1) * (total + k) / ((s[b] + 1) * (aimed + k)))) for b in s}
    rows = []
    for (i, t), f in zip(docs, own):
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in f) // len(f) if f else 0
        rows.append((i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    best = sorted((r for r in rows if r[1] >= 2 * least - 1), key=lambda r: (-r[3], r[0] is None, r[0]))
    return rows, best, len(best) * percent // 100


def agrees(got, docs, target, **more):
    rows, best, n = told(docs, target, **more)
    assert sorted((tuple(r)[:4] for r in got), key=repr) == sorted(rows, key=repr)
    drawn = sorted((r for r in got if r.rank is not None), key=lambda r: r.rank)
    assert [r.rank for r in drawn] == list(range(1, n + 1))
    assert [(r.score, r.doc_id) for r in drawn] == [(r[3], r[0]) for r in best[:n]]


def test_checksums_of_words_and_pairs():
    rng = random.Random(2)
    texts = ["", "a", "A b", " x", "é日 9", "word " * 3, "q" * 200 + " " + "z" * 64 + " " + "y" * 63 + " k " + "t" * 65, "end", "start"]
    texts += ["".join(rng.choice("aB9é日 \n.-") for _ in range(rng.randrange(300))) for _ in range(400)]
    for column in (pa.array(texts), pa.array(texts).slice(5, 200), pa.array(texts[:1]), pa.array([], pa.string())):
        found, before = importance.feature_buckets(column)
        assert [found[a:b].tolist() for a, b in zip(before[:-1], before[1:])] == [features(t) for t in column.to_pylist()]


def test_table_against_plain_counting_and_sql(spark, sf):
    import duckdb

    got = importance.op13_resample(spark, sf).collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    agrees(got, docs, [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()])
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    assert sorted(map(tuple, got), key=repr) == sorted(db.execute(importance.SQL).fetchall(), key=repr)


def test_odd_rows_clashing_columns_and_no_rows(spark, odd, odd_wide, none):
    docs, target = [(r.doc_id, r.text) for r in odd.collect()], ["w1 w2 w3 one two", None, ""]
    aim = spark.createDataFrame([(t, 1) for t in target], "text string, weight int")
    agrees(importance.resample(odd, aim).collect(), docs, target)
    agrees(importance.resample(odd_wide.withColumn("weight", F.lit(1)).withColumn("rank", F.lit(2)), aim).collect(), docs, target)
    agrees(importance.resample(odd, aim.limit(0), percent=60, least_words=2, buckets=1 << 17).collect(), docs, [], percent=60, least=2, k=1 << 17)
    assert importance.resample(none, aim).count() == 0


def test_many_copies_meet_their_weight_by_broadcast(spark):
    common, rng = "the same long text again and again " * 5, random.Random(5)
    docs = [(i, common if i % 3 else " ".join(f"w{rng.randrange(300)}" for _ in range(25))) for i in range(6000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert rows_of(importance.distinct_texts(df).groupBy().agg(F.sum("copies"), F.max("copies"))) == [(6000, 4000)]
    agrees(importance.resample(df, spark.createDataFrame([("the same text w5",)], "text string")).collect(), docs, ["the same text w5"])
