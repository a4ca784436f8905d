"""Every registered query with an SQL twin gives the twin's rows on the smallest tables."""

import datetime
import decimal
import math

import duckdb
import pytest

from pagemill.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def twin():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_twin(spark, twin, name):
    found = QUERIES[name](spark, SF)
    if name not in ORACLES:
        assert found.count() >= 0
        return
    expected = twin.sql(ORACLES[name])
    assert sorted(found.columns) == sorted(expected.columns)
    assert rows(found.columns, map(tuple, found.collect())) == rows(expected.columns, expected.fetchall())
