"""Every query with an oracle against DuckDB on the smallest tables."""

import numbers
import os
import sys

import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from tidemark import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if np.isscalar(v) and pd.isna(v) or v is None or v is pd.NA or v is pd.NaT:
            return ""
        if hasattr(v, "isoformat"):
            return v.isoformat()[:10]
        if isinstance(v, numbers.Number) and not isinstance(v, (bool, np.bool_)):
            return f"{v + 0.0:.4f}".replace("-0.0000", "0.0000")
        return str(v)

    return sorted(tuple(plain(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES) or [n for n in entry.oracle_sql()])
def test_query_matches_oracle(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    want = duck.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).columns == ["week", "feature", "scaled"]


def test_oracles_name_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_all_days_and_series_are_asked(spark, duck):
    from tidemark.sources import tables as T

    first = T.prices(spark, SF).agg({"obs_date": "min"}).first()[0]
    days = duck.execute("SELECT count(DISTINCT CAST(o_orderdate AS DATE)) FROM orders WHERE CAST(o_orderdate AS DATE) >= ?", [first]).fetchone()[0]
    assert catalog.QUERIES["asof_unbounded"](spark, SF).select("as_of").distinct().count() == days
    series = duck.execute("SELECT count(DISTINCT o_orderpriority) FROM orders").fetchone()[0]
    assert catalog.QUERIES["payload_scan"](spark, SF).select("series_id").distinct().count() == series


def test_entry_works_without_the_corpus_operators(monkeypatch):
    monkeypatch.setitem(sys.modules, "tidemark.llm.queries", None)
    assert set(entry.queries()) == set(catalog.QUERIES) and entry.oracle_sql() == catalog.ORACLES
