"""What must not grow with the tables: rows sent to every task, entries listed for each query, rows one task orders."""

from functools import cached_property

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from typeahead import queries as Q
from typeahead.operators import retrieve as R
from typeahead.operators.complete import query_set
from typeahead.operators.index import Index
from typeahead.plans.lineage import cut, first
from typeahead.sources.documents import from_rows


def broadcast_rows(spark, run) -> int:
    """The most rows that a broadcast had while ``run`` ran."""
    store, most = spark._jsparkSession.sharedState().statusStore(), 0
    before = store.executionsCount()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    ids = [store.executionsList().apply(k).executionId() for k in range(store.executionsList().size())]
    for i in sorted(ids)[-(store.executionsCount() - before) :]:
        nodes, values = store.planGraph(i).allNodes(), store.executionMetrics(i)
        for node in (nodes.apply(k) for k in range(nodes.size())):
            if node.name() == "BroadcastExchange":
                for m in (node.metrics().apply(k) for k in range(node.metrics().size())):
                    got = values.get(m.accumulatorId())
                    if m.name() == "number of output rows" and got.isDefined():
                        most = max(most, int(got.get().replace(",", "")))
    return most


@pytest.mark.parametrize("name", ["prefix_topk", "alias_prefix", "complete_direct", "complete_fuzzy", "complete_with_highlights", "context_filter", "layer_merge", "layer_aliases"])
def test_no_index_table_is_broadcast(spark, name):
    """sf0.01 has 2,000 parts, whose tables are small on disk; entries up to a cap of the search may be broadcast."""
    assert broadcast_rows(spark, lambda: Q.QUERIES[name](spark, "/root/testdata/sf0.01").collect()) < 2000


def items(spark, n):
    return from_rows(spark, [{"id": i, "text": f"item {i}", "popularity": 0.5} for i in range(n)])


def test_a_word_of_every_document_is_not_listed_for_each_query(spark, monkeypatch):
    listed, holding = [], R.holding

    def counted(ix, words):
        out = cut(holding(ix, words))
        listed.append(out.count())
        return out

    monkeypatch.setattr(R, "holding", counted)
    asked = [(str(i), f"item {i}") for i in range(100, 600, 10)]
    q = R.prepare(cut(query_set(spark.createDataFrame(asked, "qid string, query string"), 10)))
    got = {(r.qid, r.id) for r in R.infix(Index(cut(items(spark, 600))).stored(), q).collect()}
    assert got == {(k, int(k)) for k, _ in asked}
    assert sum(listed) < 600


def test_words_inside_need_no_postings_of_all_texts(spark, monkeypatch):
    def none(self):
        raise AssertionError("postings of all texts")

    texts = ["the a of", "them and another", "then", "a der die", "der dieb ist", "The the a"]
    ix = Index(cut(from_rows(spark, [{"id": i, "text": t, "popularity": i / 10} for i, t in enumerate(texts)])))
    made = cached_property(none)
    made.__set_name__(Index, "postings")
    monkeypatch.setattr(Index, "postings", made)
    q = spark.createDataFrame([("1", "the a"), ("2", "der die i"), ("3", "of is")], "qid string, query string")
    got = R.infix(ix, R.prepare(cut(query_set(q, 10)))).collect()
    assert sorted((r.qid, r.id) for r in got) == [("1", 0), ("1", 1), ("1", 5), ("2", 4)]


def test_no_task_orders_all_rows_of_a_query(spark):
    rows = spark.range(5000).selectExpr("id", "cast(id % 2 as string) qid", "id * 7 % 10 x", "cast(50 + id % 2 as int) most")
    whole = rows.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy("x", F.desc("id")))).filter("r <= most")
    got = first(rows, [F.col("x"), F.desc("id")], "most")
    assert sorted(map(str, got.collect())) == sorted(map(str, whole.collect()))
    ix = Index(cut(items(spark, 50)))
    q = R.prepare(cut(query_set(spark.createDataFrame([("1", "i")], "qid string, query string"), 10)))
    assert "pmod(xxhash64(id" in R.title_prefix(ix, q)._jdf.queryExecution().executedPlan().toString()
