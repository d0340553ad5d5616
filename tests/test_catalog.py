"""Every query of the catalogue against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from motilis.plans import catalog, catalog_more

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return repr(v) if not isinstance(v, (list, tuple)) else "[" + ",".join(map(norm, v)) + "]"


def table(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted([norm(float(r[i]) if type(r[i]).__name__ == "Decimal" else r[i]) for i in order] for r in rows)


@pytest.mark.parametrize("name", sorted(catalog_more.QUERIES))
def test_query_agrees_with_sql(spark, sf, duck, name):
    df = catalog_more.QUERIES[name](spark, sf)
    rows = df.collect()
    if name not in catalog.ORACLE:
        assert df.columns and rows is not None
        return
    got = duck.execute(catalog.ORACLE[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    assert table(df.columns, rows) == table(names, got.fetchall())


def test_entry_gives_clips_and_the_corpus(spark, sf):
    rows = catalog.flagship(spark, sf).collect()
    assert sum(r.level == "corpus" for r in rows) == 1 and len(rows) > 1
