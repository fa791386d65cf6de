"""Every query against its SQL on the smallest tables."""

import math
import re

import duckdb
import pytest

import __spark_entry__ as entry_points

QUERIES, CHECKS = entry_points.queries(), entry_points.oracle_sql()
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
# queries of the optional package have tests against brute force beside it
ELSEWHERE = {name for name in QUERIES if re.match(r"op\d+_|pipeline$", name)}


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_matches_sql(spark, duck, small, name):
    got = QUERIES[name](spark, small)
    want = duck.sql(CHECKS[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got.columns, got.collect()) == canonical(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(CHECKS) - ELSEWHERE))
def test_gives_rows(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_every_check_has_a_query():
    assert set(CHECKS) <= set(QUERIES)
