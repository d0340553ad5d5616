"""Fill-in-the-middle against plain slicing, its way back, and odd tables."""

import hashlib
import random

from motilis.llm import fill_middle as fm

from .conftest import rows_of


def told(i, text):
    t = text or ""
    n, h = len(t), hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    r = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((r[0] % (n + 1), r[1] % (n + 1)))
    form = "plain" if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or r[2] % 100 >= 90 else "spm" if r[3] % 100 < 20 else "psm"
    p, m, s = t[:a], t[a:b], t[b:]
    out = {"plain": t, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
    return (i, n, form, *((None, None) if form == "plain" else (a, b - a)), out)


def test_cuts_at_every_place_of_a_block(spark):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice("ab\n\0é日😀<PSM> \r") for _ in range(rng.choice((0, 1, 3, 63, 64, 65, 127, 128, 129, 500))))) for i in range(1500)]
    rows += [(9000, "a" * 700_000), (9001, "<P>"), (9002, "x<M>y"), (9003, "<P<S"), (9004, "P>S>M>")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = [told(*r) for r in rows]
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    out = fm.fill_middle(df)
    assert rows_of(out) == sorted(want, key=repr)
    assert rows_of(fm.restored(out)) == sorted(rows, key=repr)
    hashed = [(*w[:5], hashlib.sha256(w[5].encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for w, (_, t) in zip(want, rows)]
    assert rows_of(fm.digests(df)) == sorted(hashed, key=repr)


def test_odd_rows_clashing_columns_and_no_rows(spark, odd, odd_wide, none):
    want = sorted((told(r.doc_id, r.text) for r in odd.collect()), key=repr)
    assert rows_of(fm.fill_middle(odd)) == want == rows_of(fm.fill_middle(odd_wide.withColumn("h", odd_wide.text).withColumn("form", odd_wide.text)))
    assert fm.fill_middle(none).count() == fm.digests(none).count() == 0


def test_shares_of_forms_are_parameters(spark, odd):
    assert {r.form for r in fm.fill_middle(odd, plain=100).collect()} == {"plain"}
    assert {r.form for r in fm.fill_middle(odd.filter("length(text) > 0 and doc_id <> 17"), plain=0, spm=100).collect()} == {"spm"}


def test_query_agrees_with_sql(spark, sf):
    import duckdb

    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert rows_of(fm.op11_fill_middle(spark, sf)) == sorted(db.execute(fm.SQL).fetchall(), key=repr)
