"""Every query with SQL gives DuckDB's rows; the others give rows with a schema."""

import math

import duckdb
import pytest

from skyvane.catalog import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return repr(float(v)) if isinstance(v, int | float) and not isinstance(v, bool) else str(v)


@pytest.fixture(scope="session")
def duck(small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, duck, name):
    df = QUERIES[name](spark, small)
    rows = df.collect()
    assert df.columns and (rows or name in ("doa_shift",))
    if name in SQL:
        r = duck.execute(SQL[name])
        names = [d[0] for d in r.description]
        want = [dict(zip(names, x, strict=True)) for x in r.fetchall()]
        assert sorted(names) == sorted(df.columns)
        cols = sorted(names)
        assert sorted([plain(x[c]) for c in cols] for x in rows) == sorted([plain(x[c]) for c in cols] for x in want)


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
