"""The pipeline against its operators, stage by stage, and its queries over a small table."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from motilis.llm import entry, exact_dedup, jaccard_join, quality

from .conftest import rows_of


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for k, (name, f) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / name)
        f(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_stages_decide_as_their_operators(spark, sf, stages):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "mixing", "bpe"]
    assert all(s.columns == docs.columns for s in stages[:-1])
    ids = [{r.doc_id for r in s.select("doc_id").collect()} for s in stages]
    assert ids[0] == {r.doc_id for r in quality.scores(docs, spark.read.parquet(f"{sf}/labels.parquet")).filter("accepted").collect()}
    assert ids[1] == {r.doc_id for r in exact_dedup.dedup_decisions(stages[0]).filter("kept").collect()}
    assert ids[2] == {r.doc_id for r in jaccard_join.jaccard_classes(stages[1]).filter("kept").collect()}
    assert ids[3] <= ids[2] and stages[3].groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    assert stages[4].count() == stages[3].count()


def test_clean_documents_stay(spark, sf, stages):
    labels = spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1 and toxic = 0").select("doc_id")
    kept = stages[0].select("doc_id").join(labels, "doc_id").count()
    assert kept >= 0.97 * labels.count()


def test_run_gives_the_last_stage(spark, sf, stages):
    assert sorted(corpus_pipeline.run(spark, sf).collect()) == sorted(stages[-1].collect())


def folder(tmp_path_factory, spark, labels):
    at = tmp_path_factory.mktemp("tables")
    labels.write.parquet(f"{at}/labels.parquet")
    return str(at)


def test_stages_over_odd_tables(spark, tmp_path_factory, odd, odd_wide, none):
    """Each stage on null ids and texts, ties, repeated rows, a long text, columns of its own names, and no rows at all."""
    labels = [(i, 1, 0) for i in (1, 2, 4, 9, 14)] + [(i, 0, 0) for i in (6, 7, 12)] + [(None, 1, None), (3, None, None), (1, 1, 0)]
    shape = "doc_id long, quality int, toxic int"
    sf = folder(tmp_path_factory, spark, spark.createDataFrame(labels, shape))
    bare = folder(tmp_path_factory, spark, spark.createDataFrame([], shape))
    texts = {(r.doc_id, r.text) for r in odd.collect()}
    for name, f in corpus_pipeline.STAGES[:-1]:
        for df in (odd, odd_wide):
            out = f(spark, df, sf)
            assert out.columns == df.columns, name
            rows = out.collect()
            assert {(r.doc_id, r.text) for r in rows} <= texts and (rows or name == "quality")
        empty = f(spark, none, sf)
        assert empty.columns == none.columns and empty.count() == 0, name
    assert rows_of(corpus_pipeline.STAGES[0][1](spark, odd, bare)) == rows_of(odd)  # without labels nothing is rejected
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, odd_wide, sf).count() == odd.count() and last(spark, none, sf).count() == 0
    exact, near, mix = (dict(corpus_pipeline.STAGES)[n] for n in ("exact_dedup", "near_dedup", "mixing"))
    assert {None, 6} & {r.doc_id for r in exact(spark, odd, sf).filter("coalesce(text, '') = ''").collect()} == {6}  # null ids come last
    assert near(spark, odd, sf).filter("doc_id in (1, 2, 3)").count() == 1
    assert mix(spark, odd, sf).groupBy("doc_id", "text", "source").count().agg(F.max("count")).first()[0] <= 4  # twice each of two equal rows


def test_all_queries_are_registered():
    names = set(__spark_entry__.queries())
    assert {f"op{n}" for n in range(1, 14)} == {x.split("_")[0] for x in names if x.startswith("op")} and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(entry.queries())
