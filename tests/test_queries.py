"""Every query with SQL against DuckDB on the smallest tables; the cheap ones here, all in the driver's check."""

import duckdb
import pytest

import __spark_entry__ as entry
from typeahead import queries as Q

PATH = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"complete_direct", "context_filter", "layer_merge", "short_query"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{PATH}/{t}.parquet'")
    return c


def plain(rows, columns):
    fix = lambda v: round(v, 5) if isinstance(v, float) else v
    return sorted((tuple(fix(r[c]) for c in sorted(columns)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(set(Q.ORACLE_SQL) - SLOW))
def test_query_equals_sql(spark, con, name):
    got = Q.QUERIES[name](spark, PATH)
    want = con.sql(Q.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got.collect(), got.columns) == plain([dict(zip(want.columns, r)) for r in want.fetchall()], got.columns)


def test_entry(spark):
    assert entry.entry(spark).columns == ["qid", "rank", "id", "score", "kind"]
    assert set(Q.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_stands_without_the_training_operators():
    """The library imports nothing of the subpackage that may be missing."""
    import pathlib
    import re

    root = pathlib.Path(entry.__file__).parent / "typeahead"
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert not re.search(r"^\s*(from|import)\s.*\bllm\b", f.read_text(), re.M), f


def test_hybrid_search_answers_every_query(spark):
    got = {r.qid for r in Q.QUERIES["hybrid_search"](spark, "/root/testdata/sf0.01").select("qid").distinct().collect()}
    assert got == {r.qid for r in Q.vector_asks(spark, "/root/testdata/sf0.01").collect()}
