"""Every registered query against its SQL in DuckDB."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from folioroute.plans import catalogue as C
from folioroute.plans.oracle import ORACLE

TABLES = "documents pages conversations events".split()
QUERIES = C.QUERIES


@pytest.fixture(scope="module")
def duck(sf001):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf001}/{table}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return repr(value)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, duck, sf001, name):
    frame = QUERIES[name](spark, sf001)
    columns = sorted(frame.columns)
    got = sorted(tuple(plain(row[c]) for c in columns) for row in frame.collect())
    result = duck.execute(ORACLE[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert got == sorted(tuple(plain(row[i]) for i in order) for row in result.fetchall())


def test_flagship(spark):
    rows = {r.name: r.files for r in entry.entry(spark).collect()}
    assert sum(rows.values()) == 200


def test_known_numbers(spark, sf01):
    rows = {r.name: r.files for r in C.route_counts(spark, sf01).collect()}
    assert rows == dict(
        has_email=11, licensed=25, table_like=24, en_src1x=322, lucky=10, english_like=198,
        german_like=105, romance=209, none=96,
    )
    states = C.simple_status_counts(spark, sf01).first().asDict()
    assert states == dict(pending=31, processing=59, completed=30, failed=30, total=150)


def test_queries_leave_the_session_zone_alone(spark, sf001):
    """Times are shown as UTC in a session of any zone, and the zone stays the session's."""
    names = ("status_export", "log_table", "status_table", "display_states")
    want = {n: sorted(map(str, C.QUERIES[n](spark, sf001).collect())) for n in names}
    spark.conf.set("spark.sql.session.timeZone", "Asia/Taipei")
    try:
        assert {n: sorted(map(str, C.QUERIES[n](spark, sf001).collect())) for n in names} == want
        assert spark.conf.get("spark.sql.session.timeZone") == "Asia/Taipei"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
