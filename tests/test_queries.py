"""Every query gives the rows that its SQL gives."""

import glob
import os

import duckdb
import pytest

from quire.plans.catalog import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda v: f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) or type(v).__name__ == "Decimal" else str(v)
    return sorted(tuple(plain(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(name, spark, duck):
    df = QUERIES[name](spark, DATA)
    got = rows(df.columns, df.collect())
    if name in ORACLES:
        cursor = duck.execute(ORACLES[name])
        names = [c[0] for c in cursor.description]
        assert sorted(names) == sorted(df.columns)
        assert got == rows(names, cursor.fetchall())
    else:
        assert got
