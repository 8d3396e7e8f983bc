"""Registered queries against their SQL on the smallest tables."""

import datetime
import os

import duckdb
import pytest

import tracelens.demo.ledger  # noqa: F401  registers its queries
import tracelens.demo.lists  # noqa: F401
import tracelens.demo.more  # noqa: F401
import tracelens.demo.overview  # noqa: F401
import tracelens.demo.people  # noqa: F401
import tracelens.demo.records  # noqa: F401
import tracelens.demo.recovery  # noqa: F401
import tracelens.demo.relations  # noqa: F401
import tracelens.demo.signals  # noqa: F401
import tracelens.demo.stores  # noqa: F401
from tracelens.demo.queries import QUERIES, SQL

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return v.isoformat() if isinstance(v, datetime.datetime) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, sql, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    rel = sql.sql(SQL[name])
    at = [rel.columns.index(c) for c in columns]
    assert sorted(rel.columns) == columns
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
