"""Every query of the catalogue against DuckDB on the smallest tables."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest
from conftest import DATA

from ledgerloom.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(d: pd.DataFrame) -> pd.DataFrame:
    d = d[sorted(d.columns)].copy()
    for c in d.columns:
        d[c] = d[c].map(lambda x: "null" if x is None or x is pd.NaT or (isinstance(x, float) and x != x) else f"{x:.6f}" if isinstance(x, float) else str(x))
    return d.sort_values(list(d.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def duck() -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/sf0.001/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_against_sql(spark, duck, name) -> None:
    got = plain(catalogue.QUERIES[name](spark, f"{DATA}/sf0.001").toPandas())
    want = plain(duck.execute(catalogue.ORACLE_SQL[name]).fetchdf())
    pd.testing.assert_frame_equal(got, want)


def test_entry_imports_without_the_llm_folder() -> None:
    import __spark_entry__ as e

    assert set(catalogue.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
