"""Every catalogue query against its independent DuckDB SQL (sf0.001)."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from shopstat.plans.catalog import build_queries
from shopstat.plans.oracle import build_oracle

SF = "/root/testdata/sf0.001"
TABLES = ["customer", "part", "orders", "lineitem", "events"]
QUERIES = build_queries()
ORACLE = build_oracle()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def _norm(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].map(lambda v: None if v is None or (isinstance(v, float) and pd.isna(v))
                          else (pd.Timestamp(v).isoformat() if hasattr(v, "isoformat") else str(v)))
    return df.sort_values(list(df.columns), key=lambda s: s.fillna("")).reset_index(drop=True)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_query_matches_oracle(spark, con, key):
    got = QUERIES[key](spark, SF).toPandas()
    want = con.execute(ORACLE[key]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    assert _norm(got).equals(_norm(want))


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() == 1 and "p_value" in df.columns
