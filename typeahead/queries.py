"""Registered queries over the standard tables, one or more for each operator, and their SQL."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import oracle as O
from .errors import closest
from .functions import text as T
from .functions.edits import highlights, key_ids
from .operators import layers as L
from .operators import quality as Q
from .operators import retrieve as R
from .operators import vectors as V
from .operators.complete import complete, query_set, ranked
from .operators.correct import near_words, phrases
from .operators.index import Index, exact_raw, live_view
from .plans.lineage import cut
from .plans.options import HybridOptions
from .sources import etl
from .sources.documents import last_wins, to_documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
NONE = "cast(array() as array<string>)"


def query(sql: str | None = None):
    """Register a function under its name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def part_docs(spark, d) -> DataFrame:
    """Parts as documents: synonyms from the type, initials as abbreviation, brand and type as contexts."""
    p = table(spark, d, "part")
    top = p.agg(F.max("p_retailprice").alias("top"))
    rows = p.crossJoin(F.broadcast(top)).selectExpr(
        "p_partkey id", "p_name text", "cast(p_retailprice / top as float) popularity", "array(p_type) synonyms",
        "array(concat(left(p_name, 1), left(split_part(p_name, ' ', 2), 1))) abbreviations", "array(p_brand, p_type) contexts",
    )
    return to_documents(rows)


def title_docs(spark, d) -> DataFrame:
    """Whole texts, weighted by length."""
    p = table(spark, d, "documents")
    top = p.agg(F.max("n_chars").alias("top"))
    rows = p.crossJoin(F.broadcast(top)).select(F.col("doc_id").alias("id"), "text", (F.log(F.lit(1) + F.col("n_chars")) / F.log(F.lit(1) + F.col("top"))).cast("float").alias("popularity"), F.array("lang", "source").alias("contexts"))
    return to_documents(rows)


def parts(spark, d) -> Index:
    return Index(cut(part_docs(spark, d)))


def titles(spark, d) -> Index:
    return Index(cut(title_docs(spark, d)))


def ask(spark, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame([(i, t, list(c or ())) for i, t, c in rows], "qid long, query string, contexts array<string>")


def candidates(ix: Index, f, rows, spark, limit: int = 10) -> DataFrame:
    found = f(ix, R.prepare(cut(query_set(ask(spark, rows), limit))))
    return found.select(F.col("qid").cast("long").alias("qid"), "id")


def shown(hits: DataFrame) -> DataFrame:
    return hits.select(F.col("qid").cast("long").alias("qid"), F.col("rank").cast("int").alias("rank"), "id", F.round("score", 6).alias("score"), "kind")


# text
@query(f"SELECT doc_id AS id, array_to_string(list_filter(regexp_split_to_array(lower(text), {O.BLANK}), lambda x: x <> ''), '|') AS words, len(list_filter(regexp_split_to_array(lower(text), {O.BLANK}), lambda x: x <> '')) AS n, length(text) AS chars FROM documents")
def norm_words(spark, d):
    w = T.words(T.lower(F.col("text")))
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.array_join(w, "|").alias("words"), F.size(w).cast("long").alias("n"), F.length("text").cast("long").alias("chars"))


@query(f"WITH {O.tables(O.TITLES)} SELECT word, n FROM freq")
def word_freq(spark, d):
    return Index(title_docs(spark, d)).freq


@query(f"WITH {O.tables(O.TITLES)} SELECT id, word FROM post")
def postings(spark, d):
    return Index(title_docs(spark, d)).postings.select("id", "word")


@query("SELECT p_partkey AS id, p_brand AS brand, row_number() OVER (PARTITION BY p_brand ORDER BY encode(lower(p_name)) || '\\xFF'::BLOB, p_partkey) AS place FROM part")
def title_key_order(spark, d):
    order = Window.partitionBy("p_brand").orderBy(T.term_key(T.lower(F.col("p_name"))), T.unsigned(F.col("p_partkey")))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"), F.row_number().over(order).cast("long").alias("place"))


@query("""WITH RECURSIVE w AS (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS word FROM part),
v(word, variant, k) AS (SELECT word, left(word, 7), 0 FROM w UNION SELECT word, left(variant, i - 1) || substr(variant, i + 1), k + 1 FROM (SELECT word, variant, k, unnest(range(1, length(variant) + 1)) AS i FROM v WHERE k < 2 AND length(variant) > 1))
SELECT DISTINCT word, variant FROM v""")
def delete_variants(spark, d):
    w = table(spark, d, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("word")).distinct()
    return w.select("word", F.explode(T.delete_variants(F.col("word"))).alias("variant"))


@query(f"WITH {O.tables()} SELECT round(top, 6) AS max_score FROM m")
def max_score(spark, d):
    return spark.createDataFrame([(round(parts(spark, d).max_score, 6),)], "max_score double")


@query(f"WITH {O.tables()}, s AS (SELECT id, (CAST(150 AS DOUBLE) - CAST(0.1 AS DOUBLE) * len + CASE WHEN len(ws) = 1 THEN 25 ELSE 0 END) * (CAST(1 AS DOUBLE) + CAST(greatest(w, CAST(0 AS FLOAT)) AS DOUBLE) * 4) AS x FROM d) SELECT id, round(x, 6) AS score FROM s")
def exact_score(spark, d):
    ix = Index(part_docs(spark, d))
    return ix.docs.select("id", F.round(exact_raw(F.col("w"), F.col("len"), F.col("single"), ix.factor), 6).alias("score"))


@query("SELECT c_custkey AS id, round((CAST(150 AS DOUBLE) - CAST(0.1 AS DOUBLE) * length(c_name) + 25) * (CAST(1 AS DOUBLE) + CAST(greatest(CAST(c_acctbal / 10000 AS FLOAT), CAST(0 AS FLOAT)) AS DOUBLE) * 4), 6) AS score FROM customer")
def negative_popularity(spark, d):
    rows = table(spark, d, "customer").selectExpr("c_custkey id", "c_name text", "cast(c_acctbal / 10000 as float) popularity")
    ix = Index(to_documents(rows))
    return ix.docs.select("id", F.round(exact_raw(F.col("w"), F.col("len"), F.col("single"), ix.factor), 6).alias("score"))


@query("SELECT x AS id, CASE WHEN x < 0 THEN CAST(x AS DECIMAL(20, 0)) + 18446744073709551616 ELSE x END::DECIMAL(20, 0) AS shown, row_number() OVER (ORDER BY x < 0, x) AS place FROM (SELECT CASE WHEN n_nationkey % 2 = 0 THEN -1 - n_nationkey ELSE CAST(n_nationkey AS BIGINT) END AS x FROM nation)")
def unsigned_ids(spark, d):
    x = table(spark, d, "nation").select(F.when(F.col("n_nationkey") % 2 == 0, -1 - F.col("n_nationkey")).otherwise(F.col("n_nationkey")).cast("long").alias("id"))
    return x.select("id", T.shown_id(F.col("id")).alias("shown"), F.row_number().over(Window.orderBy(T.unsigned(F.col("id")))).cast("long").alias("place"))


@query()
def key_hashes(spark, d):
    return table(spark, d, "nation").select(F.col("n_name").alias("key"), key_ids("n_name").alias("id"))


# retrieval
DIRECT = [(1, "cold widget", None), (2, "Hot", None), (3, "cold ", None), (4, "bolt", None), (5, " red gear ", None), (6, "zzz", None)]


@query(f"WITH {O.tables()}, {O.queries(DIRECT)}, {O.EXACT} SELECT CAST(qid AS BIGINT) AS qid, id FROM exa")
def exact_match(spark, d):
    return candidates(parts(spark, d), R.exact_title, DIRECT, spark)


@query(f"WITH {O.tables()}, {O.queries(DIRECT)}, {O.PREFIX} SELECT CAST(qid AS BIGINT) AS qid, id FROM pre")
def prefix_topk(spark, d):
    return candidates(parts(spark, d), R.title_prefix, DIRECT, spark)


ONE = [(1, "widget", None), (2, "widg", None), (3, "gear", None), (4, "bol", None), (5, "new", None)]


@query(f"WITH {O.tables()}, {O.queries(ONE)}, {O.INFIX} SELECT CAST(qid AS BIGINT) AS qid, id FROM inf")
def infix_one(spark, d):
    return candidates(parts(spark, d), R.infix, ONE, spark)


MANY = [(1, "widget cold", None), (2, "gea red", None), (3, "bolt bolt", None), (4, "hot gizmo x", None)]


@query(f"WITH {O.tables()}, {O.queries(MANY)}, {O.INFIX} SELECT CAST(qid AS BIGINT) AS qid, id FROM inf")
def infix_many(spark, d):
    return candidates(parts(spark, d), R.infix, MANY, spark)


SHORT_WORDS = [(1, "of the", None), (2, "der die i", None), (3, "the a", None), (4, "la que", None), (5, "of is", None)]


@query(f"WITH {O.tables(O.TITLES)}, {O.queries(SHORT_WORDS)}, {O.INFIX} SELECT CAST(qid AS BIGINT) AS qid, id FROM inf")
def infix_short_words(spark, d):
    return candidates(titles(spark, d), R.infix, SHORT_WORDS, spark)


INITIALS = [(1, "CW", None), (2, "hg", None), (3, " rb ", None), (4, "c", None)]


@query(f"WITH {O.tables()}, {O.queries(INITIALS)}, {O.ABBREVIATION} SELECT CAST(qid AS BIGINT) AS qid, id FROM abb")
def abbreviation(spark, d):
    return candidates(parts(spark, d), R.abbreviation, INITIALS, spark)


ALIAS = [(1, "econ", None), (2, "STAND", None), (3, "promo b", None), (4, "sm", None), (5, "large", None)]
ALIAS_SQL = f"""al AS (SELECT DISTINCT id, lower(unnest(synonyms)) AS a, 0 AS k FROM d UNION SELECT DISTINCT id, lower(unnest(abbreviations)), 1 FROM d),
short AS (SELECT qid, q, n BETWEEN 1 AND 3 AND len(ctx) = 0 AND (EXISTS (SELECT 1 FROM d WHERE starts_with(title, q)) OR EXISTS (SELECT 1 FROM al WHERE starts_with(a, q))) AS is_short FROM c),
look AS (SELECT c.qid, lim, is_short, CASE WHEN is_short THEN c.q ELSE ql END AS t, CASE WHEN is_short THEN 100 ELSE lim END AS f FROM c JOIN short USING (qid)),
ent AS (SELECT qid, id, k, a, lim, is_short, f, w, row_number() OVER (PARTITION BY qid ORDER BY encode(a) || '\\xFF'::BLOB, id, k) AS r FROM look JOIN al ON starts_with(a, t) JOIN d USING (id)),
ali AS (SELECT qid, id, lim, is_short, least((CAST(100 AS DOUBLE) - min(length(a)) * CAST(0.1 AS DOUBLE)) * CAST(CAST(1 AS FLOAT) + w * CAST(0.4 AS FLOAT) * CAST(10 AS FLOAT) AS DOUBLE) / (SELECT top FROM m), 1.0) AS score
  FROM ent WHERE r <= least(1000, f * 100) AND k = 0 GROUP BY qid, id, lim, is_short, w),
arank AS (SELECT qid, id, CASE WHEN is_short THEN CAST(CAST(score AS FLOAT) AS DOUBLE) ELSE score END AS score, lim, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM ali)"""


@query(f"WITH {O.tables()}, {O.queries(ALIAS)}, {ALIAS_SQL} SELECT CAST(qid AS BIGINT) AS qid, CAST(r AS INTEGER) AS rank, id, round(score, 6) AS score, 'synonym' AS kind FROM arank WHERE r <= lim")
def alias_prefix(spark, d):
    return shown(R.complete_aliases(parts(spark, d), query_set(ask(spark, ALIAS), 10)).withColumn("kind", F.lit("synonym")))


# completion
@query(O.hits([(1, "cold", None), (2, "widget", None), (3, "hot gear", None), (4, "bolt", None), (5, "new gizmo", None)]))
def complete_direct(spark, d):
    return shown(ranked(parts(spark, d), query_set(ask(spark, [(1, "cold", None), (2, "widget", None), (3, "hot gear", None), (4, "bolt", None), (5, "new gizmo", None)]), 10)))


@query(O.hits([(1, "red", None), (2, "Ho", None), (3, "n", None)], 10, fetch=100, f32=True))
def short_query(spark, d):
    return shown(ranked(parts(spark, d), query_set(ask(spark, [(1, "red", None), (2, "Ho", None), (3, "n", None)]), 10)))


FILTERED = [(1, "cold", ("Brand#11", "Brand#12", "Brand#13", "Brand#21", "Brand#22")), (2, "gea", ("Brand#11", "Brand#23", "Brand#31", "Brand#32"))]


@query(O.hits(FILTERED, 3))
def context_filter(spark, d):
    return shown(ranked(parts(spark, d), query_set(ask(spark, FILTERED), 3)))


TYPOS = [(1, "wigdet", None), (2, "clod widgt", None), (3, "coldwidget", None), (4, "gaer red", None), (5, "xq gizmo", None)]


@query()
def complete_fuzzy(spark, d):
    return shown(ranked(parts(spark, d), query_set(ask(spark, TYPOS), 10)))


@query()
def complete_with_highlights(spark, d):
    out = complete(parts(spark, d), ask(spark, [(1, "cold wid", None), (2, "gear", None)]), 5)
    return out.select("qid", "rank", "id", "text", F.round("score", 6).alias("score"), "kind", F.to_json("highlights").alias("highlights"))


def _terms(spark):
    return spark.createDataFrame([("wigdet", False), ("gizmoo", False), ("bol", False), ("gea", False), ("stel", False)], "term string, prefix boolean")


@query(f"""WITH {O.tables()}, t(term) AS (VALUES ('wigdet'), ('gizmoo'), ('bol'), ('gea'), ('stel')),
x AS (SELECT term, word AS found, damerau_levenshtein(term, word) AS distance, n FROM t, freq WHERE abs(length(term) - length(word)) <= 2 AND damerau_levenshtein(term, word) <= 2)
SELECT term, found, CAST(distance AS INTEGER) AS distance, CAST(n AS BIGINT) AS n, CAST(row_number() OVER (PARTITION BY term ORDER BY distance, n DESC, encode(found)) AS INTEGER) AS rank FROM x""")
def fuzzy_words(spark, d):
    return near_words(parts(spark, d), _terms(spark)).select("term", "found", "distance", "n", "rank")


@query()
def fuzzy_prefix(spark, d):
    t = spark.createDataFrame([("wigd", True), ("gzm", True), ("thign", True)], "term string, prefix boolean")
    return near_words(parts(spark, d), t).select("term", "found", "distance", "n", "rank")


@query()
def phrase_correction(spark, d):
    q = R.prepare(cut(query_set(ask(spark, TYPOS), 10))).withColumn("stuck", F.lit(True))
    return phrases(parts(spark, d), q).select(F.col("qid").cast("long").alias("qid"), "source", "rank", "phrase", "distance")


@query()
def did_you_mean(spark, d):
    names = sorted(r.n_name for r in table(spark, d, "nation").collect())
    return spark.createDataFrame([(x, closest(x, names)) for x in ("GERMANI", "frence", "xyz")], "name string, nearest string")


MARKS = ("co", "wid")


@query("WITH m AS (SELECT p_partkey AS id, list_sort(list_filter([strpos(' ' || lower(p_name), ' co') - 1, strpos(' ' || lower(p_name), ' wid') - 1], lambda x: x >= 0)) AS x, CASE WHEN strpos(' ' || lower(p_name), ' co') > 0 THEN 2 ELSE 0 END + CASE WHEN strpos(' ' || lower(p_name), ' wid') > 0 THEN 3 ELSE 0 END AS width FROM part) SELECT id, array_to_string(x, ',') AS starts, CAST(width AS BIGINT) AS width FROM m")
def highlight_prefix(spark, d):
    p = table(spark, d, "part").withColumn("h", highlights(F.lit(" ".join(MARKS)), F.col("p_name")))
    starts = F.array_join(F.transform("h", lambda r: r["start"].cast("string")), ",")
    return p.select(F.col("p_partkey").alias("id"), starts.alias("starts"), F.aggregate("h", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"]).alias("width"))


# segments
EVENT_SQL = """ev AS (SELECT user_id AS id, event_type AS text, CAST(value AS FLOAT) AS popularity, ntile, event_id FROM (SELECT *, event_id % 5 AS ntile FROM events))"""


def _segments(spark, d):
    ev = table(spark, d, "events").selectExpr("user_id id", "event_type text", "cast(value as float) popularity", "event_id % 5 seq", "event_id")
    last = ev.groupBy("seq", "id").agg(F.max_by(F.struct("text", "popularity"), "event_id").alias("x")).select("id", "x.*", "seq")
    gone = ev.filter("event_type = 'purchase'").select("id", "seq").distinct()
    return last, gone


@query("""WITH s AS (SELECT event_id % 5 AS seq, user_id AS id, arg_max(event_type, event_id) AS text, CAST(arg_max(value, event_id) AS FLOAT) AS popularity FROM events GROUP BY ALL),
g AS (SELECT user_id AS id, max(event_id % 5) AS gone FROM events WHERE event_type = 'purchase' GROUP BY user_id)
SELECT id, text, round(CAST(popularity AS DOUBLE), 3) AS popularity FROM (SELECT s.*, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS r FROM s) LEFT JOIN g USING (id) WHERE r = 1 AND (gone IS NULL OR gone <= seq)""")
def live_segments(spark, d):
    docs, gone = _segments(spark, d)
    return live_view(docs, gone).select("id", "text", F.round(F.col("popularity").cast("double"), 3).alias("popularity"))


@query("SELECT user_id AS id, arg_max(event_type, event_id) AS text FROM events GROUP BY user_id")
def last_copy_wins(spark, d):
    ev = table(spark, d, "events").selectExpr("user_id id", "event_type text", "event_id position")
    return last_wins(to_documents(ev, "position")).select("id", "text")


@query("SELECT user_id AS id, count(DISTINCT event_type) AS keys FROM events GROUP BY 1 HAVING count(DISTINCT event_type) > 1")
def key_collisions(spark, d):
    from .sources.documents import key_collisions as clash

    return clash(table(spark, d, "events").selectExpr("user_id id", "event_type key"))


@query("SELECT p_partkey AS id, p_name AS text FROM part WHERE p_partkey = 7")
def point_lookup(spark, d):
    return Index(part_docs(spark, d)).document(7).select("id", "text")


@query("""WITH r AS (SELECT s_nationkey AS nation, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS pos, CASE WHEN s_suppkey % 5 = 0 THEN 255 ELSE s_suppkey % 2 END AS l FROM supplier),
g AS (SELECT *, pos - row_number() OVER (PARTITION BY nation, l ORDER BY pos) AS grp FROM r), runs AS (SELECT nation, l, min(pos) AS a, max(pos) + 1 AS b FROM g WHERE l <> 255 GROUP BY nation, l, grp HAVING count(*) >= 2),
o AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY l, a) AS k FROM runs) SELECT nation, CAST(a AS INTEGER) AS start_at, CAST(b AS INTEGER) AS end_at FROM o WHERE k = 1""")
def compaction_runs(spark, d):
    from .storage.database import compaction_run

    pick = F.udf(lambda levels: compaction_run(levels, 1), "start_at int, end_at int")  # a fanout under two counts as two
    level = F.when(F.col("s_suppkey") % 5 == 0, 255).otherwise(F.col("s_suppkey") % 2).cast("int")
    segments = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.array_sort(F.collect_list(F.struct("s_suppkey", level.alias("l")))).alias("x"))
    return segments.select("nation", pick(F.col("x.l")).alias("run")).filter("run is not null").select("nation", "run.*")


@query()
def ingest_change_sets(spark, d):
    from .storage.database import Database
    from .streaming.inbox import ChangeSet, Ingestor, submit

    db = Database(spark, tempfile.mkdtemp(prefix="typeahead-db-"))
    rows = [r.asDict() for r in table(spark, d, "nation").selectExpr("cast(n_nationkey as long) id", "n_name text").collect()]
    submit(db, ChangeSet().upsert("nations", rows[:15]))
    submit(db, ChangeSet().upsert("nations", rows[10:]).delete("nations", [0, 3]))
    Ingestor(db, "query").run_once()
    return db.open_index("nations").documents.select("id", "text")


# vectors
def vector_docs(spark, d) -> DataFrame:
    rows = table(spark, d, "embeddings").selectExpr("vec_id id", "concat('item ', vec_id) text", "cast(0.5 as float) popularity", "array(cast(label as string)) contexts", "embedding vector")
    return to_documents(rows)


def vector_asks(spark, d, tagged: bool = False) -> DataFrame:
    q = table(spark, d, "embeddings").filter("vec_id % 100 = 0")
    return q.selectExpr("vec_id qid", "embedding vector", "concat('item ', vec_id) query", *(["array(cast(label as string)) contexts"] if tagged else []))


DOT = "list_sum(list_transform(range(1, 65), lambda i: CAST(a.embedding[i] AS DOUBLE) * CAST(b.embedding[i] AS DOUBLE)))"
def _vectors(more: str = "") -> str:
    return f"v AS (SELECT a.vec_id AS qid, b.vec_id AS id, {DOT} AS x FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0{more}), vr AS (SELECT qid, id, x, row_number() OVER (PARTITION BY qid ORDER BY round(x, 12) DESC, id) AS r FROM v)"


@query(f"WITH {_vectors()} SELECT qid, CAST(r AS INTEGER) AS rank, id, round(x, 6) AS score FROM vr WHERE r <= 10")
def vector_topk(spark, d):
    return V.vector_search(Index(vector_docs(spark, d)), vector_asks(spark, d), 10).select("qid", "rank", "id", F.round("score", 6).alias("score"))


@query(f"WITH {_vectors(' AND a.label = b.label')} SELECT qid, CAST(r AS INTEGER) AS rank, id, round(x, 6) AS score FROM vr WHERE r <= 5")
def vector_filtered(spark, d):
    return V.vector_search(Index(vector_docs(spark, d)), vector_asks(spark, d, True), 5).select("qid", "rank", "id", F.round("score", 6).alias("score"))


FUSED = """l(qid, id, score, r) AS (SELECT p_size, p_partkey, p_retailprice / 10000, row_number() OVER (PARTITION BY p_size ORDER BY p_retailprice DESC, p_partkey) FROM part),
s(qid, id, score, r) AS (SELECT p_size, p_partkey, cos(p_partkey), row_number() OVER (PARTITION BY p_size ORDER BY cos(p_partkey) DESC, p_partkey) FROM part),
f AS (SELECT coalesce(a.qid, b.qid) AS qid, coalesce(a.id, b.id) AS id, a.score AS ls, b.score AS ss, a.r AS lr, b.r AS sr FROM (SELECT * FROM l WHERE r <= 8) a FULL JOIN (SELECT * FROM s WHERE r <= 8) b ON a.qid = b.qid AND a.id = b.id)"""


def _fused_sql(score: str) -> str:
    return f"WITH {FUSED}, g AS (SELECT *, {score} AS score FROM f) SELECT CAST(qid AS INTEGER) AS qid, id, round(score, 6) AS score, CASE WHEN lr IS NULL THEN 'semantic' ELSE 'infix' END AS kind, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM g) WHERE rank <= 10"


def _fused(spark, d, options) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_size").alias("qid"), F.col("p_partkey").alias("id"), (F.col("p_retailprice") / 10000).alias("a"), F.cos("p_partkey").alias("b"))
    side = lambda c: Q.rank_within(p.select("qid", "id", F.col(c).alias("score")), "qid", F.desc("score"), "id").filter("rank <= 8")
    return V.fuse(side("a").withColumn("kind", F.lit("infix")), side("b"), 10, options).select("qid", "id", F.round("score", 6).alias("score"), "kind", "rank")


@query(_fused_sql("coalesce(1.0::DOUBLE / (60 + lr), 0) + coalesce(1.0::DOUBLE / (60 + sr), 0)"))
def hybrid_rrf(spark, d):
    return _fused(spark, d, HybridOptions("rrf"))


@query(_fused_sql("0.7::DOUBLE * coalesce(ls, 0) + 0.3::DOUBLE * greatest(coalesce(ss, 0), 0)"))
def hybrid_weighted(spark, d):
    return _fused(spark, d, HybridOptions("weighted", weight=0.3))


@query(_fused_sql("CASE WHEN lr IS NOT NULL THEN 2.0::DOUBLE + 1.0::DOUBLE / lr ELSE 1.0::DOUBLE / sr END"))
def hybrid_lexical_first(spark, d):
    return _fused(spark, d, HybridOptions("lexical_first"))


@query()
def hybrid_search(spark, d):
    out = V.hybrid_search(Index(cut(vector_docs(spark, d))), vector_asks(spark, d), 5)
    return out.select("qid", "id", F.round("score", 6).alias("score"), "kind", "rank")


# layers
def _layers(spark, d) -> list[L.Layer]:
    docs = cut(part_docs(spark, d))
    over = docs.filter("id % 7 = 0").withColumn("popularity", F.lit(0.25).cast("float"))
    gone = docs.filter("id % 11 = 0").select("id")
    return [L.Layer("shared", Index(docs)), L.Layer("tenant", Index(over), gone)]


LAYER_ASK = [(1, "cold", None), (2, "widget", None)]
TENANT = "d0 AS (SELECT id, text, CAST(0.25 AS FLOAT) AS w, tags, synonyms, abbreviations FROM (WITH " + O.PART + " SELECT * FROM d0) WHERE id % 7 = 0)"
LAYER_SQL = f"""WITH a AS (WITH {O.ranked(LAYER_ASK, 20)} SELECT qid, id, score, kind, 0 AS layer, r, (SELECT top FROM m) AS top FROM hit WHERE r <= 20),
b AS (WITH {O.ranked(LAYER_ASK, 20, TENANT)} SELECT qid, id, score, kind, 1 AS layer, r, (SELECT top FROM m) AS top FROM hit WHERE r <= 20),
u AS (SELECT qid, id, score, kind, layer, r FROM a WHERE id % 7 <> 0 AND id % 11 <> 0 UNION ALL SELECT qid, id, score * (top / (SELECT any_value(top) FROM a)), kind, layer, r FROM b),
z AS (SELECT u.*, coalesce((SELECT min(a.r) FROM a WHERE a.qid = u.qid AND a.id = u.id), 1000 + u.r) AS pos FROM u),
o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pos) AS rank FROM z)
SELECT CAST(qid AS BIGINT) AS qid, CAST(rank AS INTEGER) AS rank, id, round(score, 6) AS score, kind, CAST(layer AS INTEGER) AS layer FROM o WHERE rank <= 10"""


@query(LAYER_SQL)
def layer_merge(spark, d):
    out = L.complete_layers(_layers(spark, d), ask(spark, LAYER_ASK), 10)
    return out.select(F.col("qid").cast("long").alias("qid"), "rank", "id", F.round("score", 6).alias("score"), "kind", "layer")


@query()
def layer_aliases(spark, d):
    out = L.aliases_layers(_layers(spark, d), ask(spark, [(1, "econ", None)]), 10)
    return out.select(F.col("qid").cast("long").alias("qid"), "rank", "id", F.round("score", 6).alias("score"), "kind", "layer")


@query(f"WITH {_vectors()} , h AS (SELECT qid, id, x, r FROM vr WHERE r <= 20), u AS (SELECT * FROM h WHERE id % 3 <> 0) SELECT qid, CAST(rank AS INTEGER) AS rank, id, round(x, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY x DESC, r) AS rank FROM u) WHERE rank <= 10")
def layer_vectors(spark, d):
    docs = vector_docs(spark, d)
    blank = Index(docs.limit(0))
    blank.__dict__["max_score"] = 750.0
    stack = [L.Layer("base", Index(docs)), L.Layer("hides", blank, docs.filter("id % 3 = 0").select("id"))]
    return L.vectors_layers(stack, vector_asks(spark, d), 10).select("qid", "rank", "id", F.round("score", 6).alias("score"))


@query("""WITH x AS (SELECT p_size AS qid, p_partkey AS id, p_retailprice / 10000 AS score, row_number() OVER (PARTITION BY p_size ORDER BY p_retailprice DESC, p_partkey) AS r FROM part WHERE p_partkey % 2 = 0),
y AS (SELECT p_size AS qid, p_partkey AS id, p_retailprice / 1000 AS score, row_number() OVER (PARTITION BY p_size ORDER BY p_retailprice DESC, p_partkey) AS r FROM part),
dx AS (SELECT * FROM x WHERE r <= 4), lo AS (SELECT qid, min(score) AS low, count(*) AS have FROM dx GROUP BY qid),
e AS (SELECT y.*, (SELECT z.score FROM y z WHERE z.qid = y.qid AND z.r = 1) AS top FROM y WHERE r <= 10 AND NOT EXISTS (SELECT 1 FROM dx WHERE dx.qid = y.qid AND dx.id = y.id)),
u AS (SELECT qid, id, score, 'infix' AS kind, r AS place FROM dx UNION ALL SELECT e.qid, id, score * CASE WHEN low IS NULL OR top <= 0 THEN 1.0::DOUBLE ELSE least(0.95::DOUBLE * low / top, 1.0) END, 'synonym', coalesce(have, 0) + r FROM e LEFT JOIN lo USING (qid))
SELECT CAST(qid AS INTEGER) AS qid, id, round(score, 6) AS score, kind, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY place) AS rank FROM u) WHERE rank <= 6""")
def collection_synonyms(spark, d):
    p = table(spark, d, "part").select(F.col("p_size").alias("qid"), F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("v"))
    top = lambda df, by, n: Q.rank_within(df.select("qid", "id", (F.col("v") / by).alias("score"), "v"), "qid", F.desc("v"), "id").filter(F.col("rank") <= n).drop("v")
    direct = top(p.filter("id % 2 = 0"), 10000, 4).withColumn("kind", F.lit("infix"))
    out = L.with_synonyms(direct, top(p, 1000, 10), 6)
    return out.select("qid", "id", F.round("score", 6).alias("score"), "kind", "rank")


@query("SELECT p_brand AS name, count(*) AS documents, count(DISTINCT p_type) AS types, round(max(p_retailprice), 2) AS heaviest FROM part GROUP BY p_brand")
def collection_stats(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("name")).agg(F.count("*").alias("documents"), F.count_distinct("p_type").alias("types"), F.round(F.max("p_retailprice"), 2).alias("heaviest"))


# measures
@query("SELECT left(event_type, 3) AS query, count(*) AS hits FROM events GROUP BY 1 ORDER BY hits DESC, query LIMIT 3")
def hot_queries(spark, d):
    return Q.hot_queries(table(spark, d, "events").select(F.left("event_type", F.lit(3)).alias("q")), "q", 3)


TYPED = "SELECT o_custkey AS target, CAST(o_orderkey % 12 + 1 AS INTEGER) AS len, min(CASE WHEN o_totalprice < 100000 THEN CAST(o_orderkey % 9 + 1 AS INTEGER) END) AS rank FROM orders GROUP BY 1, 2"


@query(f"""WITH t AS ({TYPED}), o AS (SELECT target, avg(coalesce(1.0::DOUBLE / rank, 0)) AS rr, min(CASE WHEN rank <= 5 THEN len END) AS keys, max(len) AS whole, max(CASE WHEN coalesce(rank, 0) = 1 THEN 1 ELSE 0 END) AS top,
max(CASE WHEN len = 3 THEN CASE WHEN coalesce(rank, 99) <= 1 THEN 1 ELSE 0 END END) AS a, max(CASE WHEN len = 3 THEN CASE WHEN coalesce(rank, 99) <= 5 THEN 1 ELSE 0 END END) AS b FROM t GROUP BY target)
SELECT round(avg(rr), 9) AS mrr, round(avg(top), 9) AS reached_top, round(avg(coalesce(keys, whole)), 9) AS keystrokes, round(avg(a), 9) AS s_at_1_3, round(avg(b), 9) AS s_at_5_3 FROM o""")
def quality_mrr(spark, d):
    o = table(spark, d, "orders")
    t = o.groupBy(F.col("o_custkey").alias("target"), (F.col("o_orderkey") % 12 + 1).cast("int").alias("len")).agg(F.min(F.when(F.col("o_totalprice") < 100000, (F.col("o_orderkey") % 9 + 1).cast("int"))).alias("rank"))
    out = Q.typing_quality(t, 5, (3,))
    return out.select(*[F.round(c, 9).alias(c) for c in ("mrr", "reached_top", "keystrokes", "s_at_1_3", "s_at_5_3")])


@query("WITH t AS (SELECT CASE WHEN o_totalprice < 100000 THEN o_orderkey % 15 + 1 END AS rank FROM orders) SELECT round(avg(CASE WHEN coalesce(rank, 99) <= 1 THEN 1 ELSE 0 END), 9) AS s_at_1, round(avg(CASE WHEN coalesce(rank, 99) <= 10 THEN 1 ELSE 0 END), 9) AS s_at_10, round(avg(CASE WHEN rank <= 10 THEN 1.0::DOUBLE / rank ELSE 0 END), 9) AS mrr_10 FROM t")
def labelled_mrr(spark, d):
    out = Q.labelled_quality(table(spark, d, "orders").select(F.when(F.col("o_totalprice") < 100000, F.col("o_orderkey") % 15 + 1).alias("rank")))
    return out.select(*[F.round(c, 9).alias(c) for c in ("s_at_1", "s_at_10", "mrr_10")])


@query("WITH t AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS r, count(*) OVER () AS n FROM events WHERE value IS NOT NULL) SELECT p, value FROM t, (VALUES (50), (90), (99)) AS x(p) WHERE r = CAST(round_even(p / 100.0 * (n - 1), 0) AS BIGINT)")
def latency_percentiles(spark, d):
    return Q.latency_percentiles(table(spark, d, "events"), "value")


# preparation
@query("SELECT p_partkey AS id, p_name AS title, round(ln(1 + p_retailprice) / ln(1 + (SELECT max(p_retailprice) FROM part)), 9) AS popularity FROM part")
def etl_log_popularity(spark, d):
    out = etl.log_popularity(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), "p_retailprice"), "p_retailprice")
    return out.select("id", "title", F.round("popularity", 9).alias("popularity"))


@query("SELECT p_name AS title, p_partkey AS id FROM (SELECT *, row_number() OVER (PARTITION BY lower(p_name) ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) WHERE r = 1")
def etl_best_copy(spark, d):
    return etl.best_copy(table(spark, d, "part"), "p_name", "p_retailprice", "p_partkey").select(F.col("p_name").alias("title"), F.col("p_partkey").alias("id"))


@query("SELECT row_number() OVER (ORDER BY title) AS id, title, score FROM (SELECT p_name AS title, max(p_size) AS score FROM part GROUP BY p_name)")
def etl_search_terms(spark, d):
    return etl.search_terms(table(spark, d, "part"), "p_name", "p_size")


@query("SELECT c_custkey AS id, c_name AS title, coalesce(s, 0) AS score FROM customer LEFT JOIN (SELECT o_custkey, sum(CAST(o_totalprice AS BIGINT)) AS s FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON o_custkey = c_custkey WHERE c_nationkey <> 3".replace("sum(CAST(o_totalprice AS BIGINT))", "CAST(count(*) AS BIGINT)"))
def etl_article_titles(spark, d):
    pages = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.lit(0).alias("namespace"), (F.col("c_nationkey") == 3).alias("is_redirect"))
    views = table(spark, d, "orders").filter("o_orderstatus = 'F'").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_name").alias("title"), F.lit(1).alias("views"))
    return etl.article_titles(pages, views)


@query("SELECT s_suppkey AS id, s_name || ' – ' || n_name AS title, coalesce(q, 0) AS score FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN (SELECT l_suppkey, CAST(sum(l_linenumber) AS BIGINT) AS q FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey")
def etl_recordings(spark, d):
    lists = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_suppkey").alias("id"), F.col("l_linenumber").alias("listens"))).alias("recordings"))
    names = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("artist_id"))
    return etl.recordings(lists, names, table(spark, d, "nation").select(F.col("n_nationkey").alias("artist_id"), F.col("n_name").alias("artist")))


@query("SELECT p_partkey AS id, p_name || ' – ' || n_name AS title, coalesce(k, 0) AS score FROM part LEFT JOIN nation ON n_nationkey = p_partkey % 25 LEFT JOIN (SELECT l_partkey, count(*) + count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS k FROM lineitem GROUP BY 1) ON l_partkey = p_partkey")
def etl_works(spark, d):
    titles_ = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.array(F.lit(99), (F.col("p_partkey") % 25).cast("int"), F.lit(1)).alias("author_ids"))
    li = table(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), "l_returnflag")
    return etl.works(titles_, [li, li.filter("l_returnflag = 'R'")], table(spark, d, "nation").select(F.col("n_nationkey").alias("author_id"), F.col("n_name").alias("author")))


@query("SELECT left(p_name, 3) AS prefix, p_name AS term, id FROM (SELECT DISTINCT p_name FROM part) LEFT JOIN (SELECT row_number() OVER (ORDER BY title) AS id, title FROM (SELECT DISTINCT p_name AS title FROM part WHERE p_size > 49)) ON title = p_name")
def etl_labelled_prefixes(spark, d):
    tests = table(spark, d, "part").select(F.left("p_name", F.lit(3)).alias("prefix"), F.col("p_name").alias("term")).distinct()
    return etl.label_prefixes(tests, etl.search_terms(table(spark, d, "part").filter("p_size > 49"), "p_name", "p_size"))
