"""Every registered query against its oracle, as the driver compares them."""

import glob
import math
import os

import duckdb
import pytest

from flowloom import registry


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def canon(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])

    def show(v):
        return "null" if v is None or (isinstance(v, float) and math.isnan(v)) else f"{v:.6f}" if isinstance(v, float) else str(v)

    return sorted(tuple(show(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_its_oracle(spark, con, sf, name):
    got = registry.QUERIES[name](spark, sf)
    rows = [tuple(r) for r in got.collect()]
    want = con.execute(registry.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert canon(rows, got.columns) == canon(want.fetchall(), columns)
