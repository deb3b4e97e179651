"""Every registered query against its DuckDB statement on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from shelfmatch.plans import catalog

SF = "/root/testdata/sf0.001"


def _cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "null"
    if isinstance(x, bool) or not isinstance(x, (int, float)):
        return str(x)
    return repr(round(float(x), 6))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    names = sorted(got.columns)
    rows = sorted(tuple(_cell(v) for v in r) for r in got.select(*names).collect())
    if name not in catalog.SQL:
        assert rows
        return
    want = duck.execute(catalog.SQL[name])
    cols = [d[0] for d in want.description]
    assert sorted(cols) == names
    place = [cols.index(c) for c in names]
    assert rows == sorted(tuple(_cell(r[i]) for i in place) for r in want.fetchall())
