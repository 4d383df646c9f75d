"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from sweepframe.plans import catalog, streams  # noqa: F401

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "events", "embeddings"):
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def plain(v):
    if pd.isna(v):
        return None
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


def rows(frame, columns):
    out = [tuple(plain(v) for v in r) for r in frame[columns].astype(object).itertuples(index=False, name=None)]
    return sorted(out, key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_rows_as_duckdb(spark, duck, name):
    ours, theirs = catalog.QUERIES[name](spark, DIR).toPandas(), duck.sql(catalog.ORACLE_SQL[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    assert rows(ours, columns) == rows(theirs, columns)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, DIR).count() > 0
