"""Every query with SQL against DuckDB on the smallest data."""

import datetime as dt
import importlib.util
import os

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for name in os.listdir(data):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{data}/{name}'")
    return con


def plain(v):
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_is_its_sql(spark, duck, data, name):
    df = QUERIES[name](spark, data)
    out = duck.execute(SQL[name])
    columns = [c[0] for c in out.description]
    assert sorted(columns) == sorted(df.columns)
    key = lambda row: [(v is None, str(v)) for v in row]
    want = sorted(([plain(row[columns.index(c)]) for c in sorted(columns)] for row in out.fetchall()), key=key)
    assert sorted(([plain(r[c]) for c in sorted(columns)] for r in df.collect()), key=key) == want


def test_every_sql_has_its_query():
    assert set(SQL) <= set(QUERIES)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_problem_queries_are_there():
    general = {"p1_found", "p2_found", "p3_found"}
    corpus = {"p4_found", "p5_found", "p6_ids", "p7_packets", "p8_found"} if importlib.util.find_spec("cluemill.llm") else set()
    assert general | corpus <= set(QUERIES)
