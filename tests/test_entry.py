import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the test tables aren't here")


def value(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "null"
    if isinstance(x, float):
        return str(round(x, 6) + 0.0)
    return str([value(y) for y in x]) if isinstance(x, (list, tuple)) else str(x)


def rows(data, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(value(r[i]) for i in order) for r in data)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and {"contig", "pos", "alt", "gt"} <= set(df.columns)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_equals_sql(spark, name):
    got = entry.queries()[name](spark, str(DATA))
    data = got.collect()
    assert len(got.columns) == len(set(got.columns))
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return
    db = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        db.execute(f"create view {p.stem} as select * from '{p}'")
    want = db.execute(sql)
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert rows(data, got.columns) == rows(want.fetchall(), columns)
