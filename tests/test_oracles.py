"""Every query that has a DuckDB equivalent gives its rows: on the smallest tables, values compared."""

import math
import os

import duckdb
import pytest

from lexmill.plans import catalog

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9)
    return x


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_rows(spark, duck, name):
    got = catalog.queries()[name](spark, FOLDER)
    want = duck.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    order = [columns.index(c) for c in got.columns]
    expected = sorted((tuple(plain(r[i]) for i in order) for r in want.fetchall()), key=repr)
    assert sorted((tuple(map(plain, r)) for r in got.collect()), key=repr) == expected
