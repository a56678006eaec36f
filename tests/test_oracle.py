"""Every registered query against its SQL, run by DuckDB over the same Parquet tables."""

import datetime
import math

import duckdb
import pytest

import __spark_entry__ as entry
from exposure.plans.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES.split():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    return value


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(plain(row[i]) for i in order) for row in rows]
    return sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(name, spark, duck):
    result = QUERIES[name](spark, SF_DIR)
    got = normal([tuple(r) for r in result.collect()], result.columns)
    assert name in ORACLES, "every query so far has SQL"
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(result.columns)
    assert got == normal(cursor.fetchall(), names)
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_entry_runs(spark):
    top = entry.entry(spark).collect()
    assert 0 < len(top) <= 5
    assert [r.risk for r in top] == sorted((r.risk for r in top), reverse=True)


def test_registry_builds_before_any_session_is_needed():
    assert set(entry.oracle_sql()) <= set(entry.queries())
