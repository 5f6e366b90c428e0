"""Every registered query with oracle SQL against DuckDB on the given tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from codeloom import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def oracle(small):
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9))
    return str(value)


def test_every_query_is_known():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == {"train_classifier"}


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, small, oracle, name):
    df = catalog.queries()[name](spark, small)
    names = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    result = oracle.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == names
    places = [columns.index(c) for c in names]
    assert got == sorted(tuple(plain(row[i]) for i in places) for row in result.fetchall())


def test_entry(spark, small):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["doc_id", "code", "language", "repo", "path", "size"] and df.count() > 0
