"""Completion against published scores and branch cases; segmentation must not matter."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from typeahead.errors import InvalidInputError, LayerNotFoundError
from typeahead.operators import layers as L
from typeahead.operators.complete import complete, query_set
from typeahead.operators.index import Index, kth_smallest, live_view
from typeahead.operators.retrieve import complete_aliases
from typeahead.operators import vectors
from typeahead.operators.vectors import fuse, vector_search
from typeahead.plans.lineage import cut
from typeahead.plans.options import HybridOptions
from typeahead.sources.documents import from_rows, read_json_lines, to_documents

SONGS = [
    {"id": 1, "text": "Bohemian Rhapsody – Queen", "popularity": 0.95, "synonyms": ["is this the real life"]},
    {"id": 2, "text": "Dancing Queen – ABBA", "popularity": 0.85},
    {"id": 3, "text": "Dancing in the Dark – Bruce Springsteen", "popularity": 0.7},
    {"id": 4, "text": "Under the Bridge – Red Hot Chili Peppers", "popularity": 0.75, "abbreviations": ["RHCP"]},
]


def built(docs):
    return Index(cut(docs)).cache()


def ask(spark, *texts, contexts=()):
    return spark.createDataFrame([(t, t, list(contexts)) for t in texts], "qid string, query string, contexts array<string>")


def answers(ix, spark, *texts, limit=10, contexts=()):
    out = {t: [] for t in texts}
    for r in complete(ix, ask(spark, *texts, contexts=contexts), limit, marks=False).orderBy("rank").collect():
        out[r.qid].append((r.id, r.kind, round(r.score, 3)))
    return out


def test_published_scores(spark):
    ix = built(from_rows(spark, SONGS))
    assert round(ix.max_score, 3) == 708.0
    got = answers(ix, spark, "danc", "RHCP", "bohemain rapsody", "queen", "dancingqueen", "hr queen", "")
    assert got["danc"] == [(2, "prefix", 0.547), (3, "prefix", 0.462)]
    assert got["RHCP"] == [(4, "abbreviation", 0.486)]
    assert got["bohemain rapsody"] == [(1, "fuzzy", 0.186)]
    assert got["queen"] == got["hr queen"] == [(1, "infix", 0.356), (2, "infix", 0.329)]
    assert got["dancingqueen"][0][:2] == (2, "prefix")
    assert got[""] == []
    alias = complete_aliases(ix, query_set(ask(spark, "is this the real"), 10)).collect()
    assert [(r.id, round(r.score, 4)) for r in alias] == [(1, 0.6637)]


SHELVES = [
    ("Harvest Moon Over Lisbon", 0.5), ("Harvest Lane", 0.9), ("A quiet garden of stones", 0.5), ("Gardening tools", 0.9),
    ("Copper kettle", 0.5), ("Coping saw", 0.9), ("Treppenhausfenster", 0.5), ("Night sailing", 0.5),
]


def test_corrections(spark):
    ix = built(from_rows(spark, [{"id": k, "text": t, "popularity": p} for k, (t, p) in enumerate(SHELVES, 1)]))
    got = answers(ix, spark, "havrest moon", "quiet gadren of", "harvest moon", "coper kettle", "trepenhausfenster", "XY night sailing")
    first = {q: hits[0][:2] for q, hits in got.items()}
    assert first["havrest moon"] == (1, "fuzzy")
    assert first["quiet gadren of"] == (3, "fuzzy")
    assert first["harvest moon"] == (1, "prefix")
    assert first["coper kettle"][0] == 5
    assert first["trepenhausfenster"][0] == 7
    assert first["XY night sailing"][0] == 8


def test_exact_ties_and_contexts(spark):
    rows = [{"id": i, "text": f"product {i}", "popularity": 0.5, "contexts": ["even" if i % 2 == 0 else "odd"]} for i in range(300)]
    rows += [{"id": 1000, "text": "B& (letter pair)", "abbreviations": ["B&"]}, {"id": 1001, "text": "Basalt"}, {"id": 1002, "text": "Bass tuning"}]
    ix = built(from_rows(spark, rows))
    got = answers(ix, spark, "product 12", "b&", limit=5)
    assert got["product 12"][0][:2] == (12, "exact")
    assert [h[0] for h in got["b&"]] == [1000]
    assert {h[0] % 2 for h in answers(ix, spark, "product", limit=5, contexts=["odd"])["product"]} == {1}


def test_segments_and_whole_agree(spark):
    rows = [{"id": i, "text": f"item {i} alpha{i % 31} beta{i % 7} gamma", "popularity": i % 100 / 100} for i in range(400)]
    whole = built(from_rows(spark, rows))
    old = from_rows(spark, [{**r, "text": "stale " + r["text"]} for r in rows[:50]] + [{"id": 999, "text": "item gone"}]).withColumn("seq", F.lit(0))
    new = from_rows(spark, rows).withColumn("seq", F.lit(1))
    deletes = spark.createDataFrame([(999, 1), (5, 0), (7, 1)], "id long, seq int")
    split = built(live_view(old.unionByName(new), deletes))
    assert split.documents.count() == len(rows)
    asked = ("item 1", "alpha3", "gamma beta2", "ite", "gmama")
    assert answers(whole, spark, *asked) == answers(split, spark, *asked)


def test_layers(spark):
    cat = [("rb", "River Boat", 0.4), ("rs", "River Stone", 0.9), ("rm", "River Mouth", 0.2)]
    base = from_rows(spark, [{"id": k, "text": t, "popularity": p} for k, t, p in cat])
    key = {r.key: r.id for r in base.collect()}
    over = from_rows(spark, [{"id": "rb", "text": "Harbour boat", "popularity": 0.4}])
    stack = [L.Layer("shared", built(base)), L.Layer("tenant", built(over), spark.createDataFrame([(key["rm"],)], "id long"))]
    got = L.complete_layers(stack, ask(spark, "river", "boat")).collect()
    assert {(r.qid, r.id, r.layer) for r in got} == {("river", key["rs"], 0), ("boat", key["rb"], 1)}
    with pytest.raises(LayerNotFoundError, match="did you mean 'tenant'"):
        L.pick({"tenant": stack[1]}, ["tenent"])
    assert L.pick({}, ["x"], True) == []


def test_vectors_and_fusion(spark):
    pad = lambda *v: [float(x) for x in v] + [0.0] * (8 - len(v))
    rows = [{"id": 1, "text": "a", "vector": pad(1), "contexts": ["books"]}, {"id": 2, "text": "b", "vector": pad(0.9, 0.1), "contexts": ["courses"]}, {"id": 3, "text": "c", "vector": pad(0, 1), "contexts": ["books", "courses"]}, {"id": 4, "text": "d", "vector": pad(0.8, 0, 0.2)}]
    ix = Index(from_rows(spark, rows))
    q = spark.createDataFrame([(0, pad(1), ["courses"])], "qid long, vector array<double>, contexts array<string>")
    assert [r.id for r in vector_search(ix, q, 3).orderBy("rank").collect()] == [2, 3]
    assert [r.id for r in vector_search(ix, q.drop("contexts"), 3).orderBy("rank").collect()] == [1, 2, 4]
    with pytest.raises(InvalidInputError):
        vector_search(ix, spark.createDataFrame([(0, [1.0])], "qid long, vector array<double>"))
    lex = spark.createDataFrame([(0, 1, 0.9, "prefix", 1), (0, 2, 0.5, "infix", 2)], "qid long, id long, score double, kind string, rank int")
    sem = spark.createDataFrame([(0, 1, 0.8, 1), (0, 3, 0.7, 2)], "qid long, id long, score double, rank int")
    got = fuse(lex, sem, 5).orderBy("rank").collect()
    assert [(r.id, round(r.score, 4), r.kind) for r in got] == [(1, 0.0328, "prefix"), (2, 0.0161, "infix"), (3, 0.0161, "semantic")]
    with pytest.raises(InvalidInputError):
        HybridOptions("weighted", weight=2)


def test_sources(spark, tmp_path):
    f = tmp_path / "d.jsonl"
    f.write_text('{"id": 1, "text": "a"}\n\n{"id": "k", "text": "b", "synonyms": ["c"]}\n{"id": 1, "text": "z"}\n')
    got = {r.text: r for r in read_json_lines(spark, str(f)).collect()}
    assert set(got) == {"z", "b"}
    assert got["b"].key == "k"
    assert got["b"].synonyms == ["c"]
    for bad, why in (({"id": 1}, "text"), ({"id": 1, "text": "x", "sinonyms": []}, "did you mean 'synonyms'"), ({"id": 1, "text": "x", "contexts": "y"}, "list"), ({"id": "", "text": "x"}, "empty")):
        with pytest.raises(InvalidInputError, match=why):
            from_rows(spark, [bad])
    assert from_rows(spark, {"id": [1, 2], "text": ["a", "b"], "popularity": [0.5, 1]}).count() == 2


def test_kth_smallest(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).cast("double").alias("x"))
    assert [kth_smallest(df, "x", k, keep=20) for k in (0, 500, 999)] == [0.0, 500.0, 999.0]


def test_the_last_row_of_an_id_wins(spark):
    rows = spark.createDataFrame([(1, "old"), (2, "b"), (1, "new")], "id long, text string").coalesce(1)
    assert sorted((r.id, r.text) for r in from_rows(spark, rows).collect()) == [(1, "new"), (2, "b")]
    assert sorted((r.id, r.title) for r in Index.from_documents(from_rows(spark, rows)).docs.collect()) == [(1, "new"), (2, "b")]


def test_lines_are_counted_with_blank_ones(spark, tmp_path):
    f = tmp_path / "d.jsonl"
    f.write_text('{"id": 1, "text": "a"}\n\n\n{"id": \n')
    with pytest.raises(InvalidInputError, match="line 4"):
        read_json_lines(spark, str(f))


def test_synonyms_scale_by_the_first_even_if_it_is_a_direct_hit(spark):
    kinds = "qid long, id long, score double, kind string, rank int"
    direct = spark.createDataFrame([(0, 1, 0.4, "prefix", 1)], kinds)
    synonyms = spark.createDataFrame([(0, 1, 0.8, "synonym", 1), (0, 2, 0.5, "synonym", 2)], kinds)
    got = {r.id: round(r.score, 4) for r in L.with_synonyms(direct, synonyms, 5).collect()}
    assert got == {1: 0.4, 2: 0.2375}


def test_a_missing_listed_layer_still_counts(spark):
    ix = built(from_rows(spark, [{"id": i, "text": f"pear {i}", "popularity": 0.5} for i in range(9)]))
    one = [L.Layer("base", ix)]
    assert L._fetch(one, None, 5, 4) == 5 and L._fetch(one, 2, 5, 4) == 20
    assert L.complete_layers(one, ask(spark, "pear"), 5, 4, 2).count() == 5


def test_searches_of_an_index(spark):
    ix = built(from_rows(spark, SONGS))
    assert [r.id for r in ix.complete(ask(spark, "danc")).orderBy("rank").collect()] == [2, 3]
    assert [r.id for r in ix.complete_aliases(ask(spark, "is this the real")).collect()] == [1]


def test_vector_blocks_equal_one_comparison(spark, monkeypatch):
    """Many blocks of either side, ties by unsigned id, contexts, an empty query set and one without vectors."""
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(300, 8)))
    ids = [i - 150 for i in range(300)]
    tags = ["even" if i % 2 == 0 else "odd" for i in ids]
    docs = spark.createDataFrame([(i, "t", [t], v.tolist()) for i, t, v in zip(ids, tags, x)], "id long, text string, contexts array<string>, vector array<float>")
    ix = Index(to_documents(docs))
    asked = [(k, x[k].tolist(), ["odd"] if k % 3 == 0 else None) for k in range(0, 300, 7)]
    queries = spark.createDataFrame(asked, "qid long, vector array<double>, contexts array<string>")

    def by_hand(k, wanted):
        score = x @ x[k]
        order = sorted((j for j in range(300) if not wanted or tags[j] in wanted), key=lambda j: (-score[j], ids[j] % (1 << 64)))
        return [(ids[j], score[j]) for j in order[:5]]

    want = {(k, r, *hit) for k, _, wanted in asked for r, hit in enumerate(by_hand(k, wanted), 1)}
    monkeypatch.setattr(vectors, "BLOCK", 16)
    assert {(r.qid, r["rank"], r.id, r.score) for r in vector_search(ix, queries, 5).collect()} == want
    assert vector_search(ix, queries.limit(0), 5).count() == 0
    assert vector_search(Index(ix.documents.withColumn("vector", F.lit(None).cast("array<float>"))), queries, 5).count() == 0
