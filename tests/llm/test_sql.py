import duckdb
import pytest

from skyvane.llm.registry import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql_gives_the_same_rows(spark, small, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "conversations", "labels", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    r = c.execute(SQL[name])
    names = [d[0] for d in r.description]
    want = sorted(str([x[names.index(n)] for n in sorted(names)]) for x in r.fetchall())
    df = QUERIES[name](spark, small)
    assert sorted(df.columns) == sorted(names)
    assert sorted(str([x[n] for n in sorted(names)]) for x in df.collect()) == want
