"""The queries that have SQL, held against DuckDB."""

import duckdb
import pytest
from lodegraph.llm import registry

from .helpers import SF


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.queries()[name](spark, SF)
    cur = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(r[names.index(c)] for c in df.columns) for r in cur.fetchall())
    assert sorted(tuple(r) for r in df.collect()) == want
