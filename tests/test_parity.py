"""Each query of the star schema against its SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from quiremill.plans import more, star  # noqa: F401  (more adds its queries to star's)

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def cell(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "null"
    if isinstance(x, (int, float)) and not isinstance(x, bool):
        return f"{float(x):.6g}"
    return str(x)


def rows(names, got):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in got)


@pytest.mark.parametrize("name", sorted(star.QUERIES))
def test_query(spark, duck, name):
    df = star.QUERIES[name](spark, DATA)
    got = [tuple(r) for r in df.collect()]
    if name not in star.SQL:
        assert got
        return
    want = duck.execute(star.SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, got) == rows(names, want.fetchall())


def test_entry(spark):
    assert star.flagship(spark, DATA).count() > 0
