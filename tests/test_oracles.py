"""Every registered query of the library proper against DuckDB over the smallest tables."""

import duckdb
import pytest

from weft import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(str(x) for x in r) for r in df.astype(object).where(df.notna(), None).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_same_rows(spark, duck, name):
    got, want = plans.QUERIES[name](spark, SF).toPandas(), duck.execute(plans.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_runs(spark, name):
    assert plans.QUERIES[name](spark, SF).count() > 0
