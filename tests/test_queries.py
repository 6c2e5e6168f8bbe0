"""Every registered query of the engine against its SQL."""

import math
import os

import duckdb
import pytest

from credence.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def shown(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "null"
    return f"{x:.6g}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = sorted(tuple(shown(r[c]) for c in columns) for r in df.collect())
    if name not in ORACLES:
        assert found
        return
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    expected = sorted(tuple(shown(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
    assert found == expected
