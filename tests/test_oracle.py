"""Every registered query against its DuckDB twin on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as E
from lectern.plans import catalog, oracle
from lectern.plans.compare import differences, type_differences
from lectern.sources.tables import TABLES

from .conftest import SF_SMALL

NAMES = sorted(catalog.queries())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    yield con
    con.close()


def test_every_query_has_an_oracle():
    assert set(oracle.oracle_sql()) == set(catalog.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF_SMALL)
    s_rows = [tuple(r) for r in df.collect()]
    rel = duck.sql(E.oracle_sql()[name])
    assert type_differences(df.schema, rel.columns, rel.types) == {}
    res = duck.execute(E.oracle_sql()[name])
    d_cols = [c[0] for c in res.description]
    assert differences(df.columns, s_rows, d_cols, res.fetchall()) == []


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["user_id", "submission_id", "word", "count", "first_sentence",
                          "first_paragraph", "language_frequency", "rank"]
