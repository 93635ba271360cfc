"""Every query that has SQL, held against DuckDB on the smallest tables."""

import os

import duckdb
import pytest
from lodegraph.plans import queries as own

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(v):
    import datetime
    import decimal
    import math

    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (int, float, decimal.Decimal)) and not isinstance(v, bool):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


@pytest.mark.parametrize("name", sorted(own.oracle_sql()))
def test_against_sql(spark, duck, name):
    df = own.queries()[name](spark, SF)
    cur = duck.execute(own.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    want = sorted(([plain(r[names.index(c)]) for c in order] for r in cur.fetchall()), key=repr)
    got = sorted(([plain(r[c]) for c in order] for r in df.collect()), key=repr)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g == pytest.approx(w, rel=1e-9) if all(isinstance(x, float) for x in w) else g == w
