"""Every query with SQL gives the rows of that SQL in DuckDB."""

import duckdb
import pytest

from tidemark.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(x):
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, (list, tuple)):
        return [plain(y) for y in x]
    if x is None or str(x) in ("<NA>", "NaT", "nan"):
        return None
    return round(float(x), 9) + 0.0 if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


def rows(df):
    return sorted((tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", [n for n, (_, sql) in catalog.QUERIES.items() if sql])
def test_like_sql(spark, duck, name):
    query, sql = catalog.QUERIES[name]
    got, want = query(spark, SF).toPandas(), duck.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", [n for n, (_, sql) in catalog.QUERIES.items() if not sql])
def test_gives_rows(spark, name):
    assert catalog.QUERIES[name][0](spark, SF).count() > 0
