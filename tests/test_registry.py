"""Every registered query against its SQL, on the smallest tables."""

import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = entry.oracle_sql()
# The SQL of the whole content pipeline takes long; these are compared on the first rows of the tables.
SLOW = {"sanitize_content", "sanitize_detections", "scan_headers", "gateway_verdict"}
FEW = 24

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def connection(folder):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def whole():
    return SF, connection(SF)


@pytest.fixture(scope="module")
def few(tmp_path_factory):
    folder = tmp_path_factory.mktemp("few")
    for t in TABLES:
        duckdb.execute(f"COPY (FROM '{SF}/{t}.parquet' LIMIT {FEW}) TO '{folder}/{t}.parquet'")
    return str(folder), connection(folder)


def plain(v):
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return None if math.isnan(float(v)) else round(float(v), 6) + 0.0
    return v


def test_every_sql_has_a_query():
    assert set(SQL) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, whole, few, name):
    folder, con = few if name in SLOW else whole
    df = entry.queries()[name](spark, folder)
    columns = sorted(df.columns)
    got = Counter(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    if name not in SQL:
        return
    cursor = con.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    expected = Counter(repr(tuple(plain(r[i]) for i in at)) for r in cursor.fetchall())
    assert got == expected


def test_entry(spark):
    assert entry.entry(spark).count() > 0
