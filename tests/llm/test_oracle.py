"""The operators' SQL against their queries."""

import duckdb
import pytest

from typeahead.llm.queries import ORACLE_SQL, QUERIES

PATH = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{PATH}/{t}.parquet'")
    got, want = QUERIES[name](spark, PATH), con.sql(ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    names = sorted(got.columns)
    assert sorted(tuple(r[c] for c in names) for r in got.collect()) == sorted(want.select(*names).fetchall())
