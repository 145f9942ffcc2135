"""Candidates of a set of queries: titles, words inside, abbreviations, synonyms.

Query sets have qid (string), query (as typed), lim, and ctx (array; empty
means no filter). Prefix joins are equi-joins: either side has the prefix of the
longest rung that fits in the query, and the rest is checked after the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.lineage import SMALL, cut, first, meet, planned
from .index import Index

MOST = 10_000
#: A word that stands in so many times the entries of the rarest beside it is looked up in the documents that hold the others.
OFTEN = 20


def prepare(queries: DataFrame) -> DataFrame:
    """Adds the lowered text, its stripped form, its words, and the candidate caps."""
    ql, lim = T.lower(F.col("query")), F.col("lim")
    q = queries.filter(F.col("query") != "").withColumn("ql", ql).withColumn("q", T.strip(F.col("ql"))).withColumn("n", F.length("q"))
    q = q.withColumn("words", T.words(F.col("ql")))
    cap = lambda mid, times_mid, low, times: (
        F.when(F.col("n") <= 3, F.lit(MOST)).when(F.col("n") <= 5, F.greatest(F.lit(mid), lim * times_mid)).otherwise(F.greatest(F.lit(low), lim * times))
    )
    return q.withColumn("p_cap", cap(50, 3, 30, 2)).withColumn("i_cap", cap(100, 5, 50, 3))


def allowed(ctx: str = "ctx", tags: str = "contexts") -> Column:
    """Whether a document has any of the wanted tags; no wish allows all."""
    return (F.size(ctx) == 0) | F.arrays_overlap(ctx, tags)


def starting_with(terms: DataFrame, column: str, table: DataFrame, target: str) -> DataFrame:
    """Rows of a rung table whose ``target`` starts with the term."""
    keyed = terms.withColumn("rung", T.rung(F.col(column))).withColumn("pre", F.expr(f"substring({column}, 1, rung)"))
    return meet(keyed, table, ["rung", "pre"]).filter(F.startswith(F.col(target), F.col(column))).drop("rung", "pre")


def title_prefix(ix: Index, q: DataFrame) -> DataFrame:
    """(qid, id) of the heaviest titles that start with the query, spaces and all."""
    hits = starting_with(q.select("qid", "ql", "p_cap", "ctx"), "ql", ix.titles, "title").filter(allowed())
    order = [F.desc("w"), T.term_key(F.col("title")), F.col("uid")]
    return first(hits.select("qid", "id", "uid", "w", "title", "p_cap"), order, F.least(F.lit(50 * MOST), F.col("p_cap"))).select("qid", "id")


def exact_title(ix: Index, q: DataFrame) -> DataFrame:
    return meet(q.select("qid", "ctx", F.col("q").alias("title")), ix.docs.select("title", "id", "contexts"), "title").filter(allowed()).select("qid", "id")


def abbreviation(ix: Index, q: DataFrame) -> DataFrame:
    hits = meet(q.select("qid", "ctx", F.col("q").alias("alias")), ix.aliases.filter("kind = 1").select("alias", "id"), "alias")
    return in_context(ix, hits).select("qid", "id").distinct()


def in_context(ix: Index, hits: DataFrame) -> DataFrame:
    """Hits (ctx, id, ...) whose document is allowed; documents are met only for those that ask for tags."""
    some = cut(hits)
    free = some.filter(F.size("ctx") == 0)
    asked = some.filter(F.size("ctx") > 0)
    if not asked.take(1):
        return free
    return free.unionByName(meet(asked, ix.docs.select("id", "contexts"), "id").filter(allowed()).drop("contexts"))


def narrowed(ix: Index, terms: DataFrame) -> Index:
    """The index for words that start with one of the terms alone, where it has no postings yet: texts are split once."""
    if "postings" in ix.__dict__:
        return ix
    keyed = cut(terms.select("term").distinct().withColumn("rung", T.rung(F.col("term"))).withColumn("pre", F.expr("substring(term, 1, rung)")))
    lengths = [r.rung for r in keyed.select("rung").distinct().collect()] or [max(T.RUNGS)]  # ten at most
    fits = F.filter(F.array(*map(F.lit, lengths)), lambda k: k <= F.length("word"))
    words = ix.entries.select("id", "word", F.explode(fits).alias("rung")).withColumn("pre", F.expr("substring(word, 1, rung)"))
    out = Index(ix.documents, ix.build, ix.options)
    kept = cut(meet(keyed, words, ["rung", "pre"]).filter(F.startswith(F.col("word"), F.col("term"))).select("id", "word").distinct())
    out.__dict__.update(docs=ix.docs, postings=kept, freq=kept.groupBy("word").agg(F.count("*").alias("n")))
    return out


def holding(ix: Index, words: DataFrame) -> DataFrame:
    """The words' rows with each document that holds the word; repeats in a text are dropped only among these."""
    return meet(words, ix.entries, "word").distinct()


def docs_with_words(ix: Index, terms: DataFrame) -> DataFrame:
    """(key, id) of documents that hold, for each (key, place, term), an indexed word that starts with the term.

    Entries of rare words are counted; words that are frequent beside them are
    looked up in the titles that this leaves, so a word that every document
    holds is not listed once for each query.
    """
    words = cut(starting_with(terms, "term", ix.dictionary, "word").select("key", "place", "word", "n"))
    bound = words.groupBy("key", "place").agg(F.sum("n").alias("bound"))
    bound = bound.withColumn("often", F.col("bound") > OFTEN * F.min("bound").over(Window.partitionBy("key")))
    need = terms.groupBy("key").agg(F.count_distinct("place").alias("need"))
    met = bound.groupBy("key").agg(F.count("*").alias("have"), F.count_if(~F.col("often")).alias("rare")).join(need, "key").filter("have = need")
    bound = cut(bound.join(met, "key").select("key", "place", "often", "rare"))
    rare = cut(words.join(bound.filter("not often"), ["key", "place"]).select("key", "place", "word", "rare"))
    held = holding(ix, rare).groupBy("key", "id", "rare").agg(F.count_distinct("place").alias("k")).filter("k = rare").select("key", "id")
    if not bound.filter("often").take(1):
        return held
    others = cut(terms.join(bound.filter("often"), ["key", "place"]).groupBy("key").agg(F.collect_set("term").alias("others")))
    held = cut(held.join(others, "key", "left"))
    inside = meet(held.filter("others is not null"), ix.docs.select("id", "title"), "id").withColumn("inside", T.indexed_words(F.col("title"), ix.build.min_word_chars))
    fits = F.forall("others", lambda t: F.exists("inside", lambda x: F.startswith(x, t)))
    return held.filter("others is null").select("key", "id").unionByName(inside.filter(fits).select("key", "id").distinct())


def infix(ix: Index, q: DataFrame) -> DataFrame:
    """(qid, id) of the heaviest documents that hold the query's words inside.

    One long word scans postings in (word, id) order and stops after five times
    the cap of entries; several must all be held. Words too short to be indexed
    must start some word of the text.
    """
    least = ix.build.min_word_chars
    split = q.select(
        "qid", "ctx", "i_cap", F.filter("words", lambda w: F.length(w) >= least).alias("long"), F.filter("words", lambda w: F.length(w) < least).alias("short")
    )
    split = cut(split)
    ix = narrowed(ix, split.select(F.explode("long").alias("term")))
    one = split.filter(F.size("long") == 1).select("qid", "ctx", "i_cap", F.get("long", F.lit(0)).alias("term"))
    words = cut(starting_with(one, "term", ix.dictionary, "word").select("qid", "ctx", "i_cap", "word"))
    entries = in_context(ix, holding(ix, words)).withColumn("uid", T.unsigned(F.col("id")))
    begun = first(entries, [T.term_key(F.col("word")), F.col("uid")], 5 * F.col("i_cap")).select("qid", "id").distinct()
    terms = split.filter(F.size("long") > 1).select(F.col("qid").alias("key"), F.posexplode("long").alias("place", "term"))
    many = docs_with_words(ix, terms).select(F.col("key").alias("qid"), "id")
    found = cut(begun.unionByName(many))
    docs, fits = ix.docs.select("id", "uid", "w", "contexts", "title"), F.lit(True)
    if split.filter(F.size("short") > 0).take(1):
        fits = F.forall("short", lambda s: F.exists(T.words(F.col("title")), lambda x: F.startswith(x, s)))
        if planned(found) > SMALL:  # the words' heads are shuffled instead of texts, which may be long
            heads = F.flatten(F.transform(T.words(F.col("title")), lambda x: F.array(*[F.substring(x, 1, k) for k in range(1, least)])))
            docs, fits = docs.withColumn("heads", F.array_distinct(heads)).drop("title"), F.forall("short", lambda s: F.array_contains("heads", s))
    hits = meet(split.drop("long"), meet(found, docs, "id"), "qid").filter(allowed()).filter(fits)
    return first(hits.select("qid", "id", "uid", "w", "i_cap"), [F.desc("w"), F.col("uid")], "i_cap").select("qid", "id")


def has_prefix(terms: DataFrame, column: str, table: DataFrame, target: str, key: str) -> DataFrame:
    """Distinct keys of terms that some entry of the table starts with."""
    return starting_with(terms, column, table, target).select(key).distinct()


def alias_rungs(ix: Index) -> DataFrame:
    return ix.aliases.select("alias", "kind", "id", F.explode(T.rungs(F.col("alias"))).alias("r")).select("r.rung", "r.pre", "alias", "kind", "id")


def short_queries(ix: Index, queries: DataFrame) -> DataFrame:
    """(qid, q) of unfiltered queries of few characters that some title or alias starts with."""
    q = queries.withColumn("q", T.strip(T.lower(F.col("query")))).filter((F.size("ctx") == 0) & (F.length("q").between(1, ix.options.short_query_chars)))
    q = q.select("qid", "q")
    return has_prefix(q, "q", ix.titles, "title", "qid").unionByName(has_prefix(q, "q", alias_rungs(ix), "alias", "qid")).distinct().join(q, "qid")


def complete_aliases(ix: Index, queries: DataFrame) -> DataFrame:
    """(qid, id, score, rank) of synonyms that start with the query.

    The first hundred times the limit (1,000 at most) entries of either kind in
    (alias, id) order are looked at; synonyms among them count, by their
    shortest per document.
    """
    queries = cut(queries)
    short = short_queries(ix, queries).withColumnRenamed("q", "short_q")
    q = queries.join(short, "qid", "left").withColumn("is_short", F.col("short_q").isNotNull())
    q = q.withColumn("ql", F.coalesce("short_q", T.lower(F.col("query")))).filter("ql <> ''")
    q = q.withColumn("n", F.when(F.col("is_short"), ix.options.short_query_limit).otherwise(F.col("lim")))
    q = cut(q.select("qid", "ql", "ctx", "lim", "n", "is_short"))
    hits = in_context(ix, starting_with(q, "ql", alias_rungs(ix), "alias")).withColumn("uid", T.unsigned(F.col("id")))
    scan = [T.term_key(F.col("alias")), F.col("uid"), F.col("kind")]
    seen = cut(first(hits, scan, F.least(F.lit(1000), F.col("n") * 100)).filter("kind = 0").drop("uid"))
    best = meet(seen, ix.docs.select("id", "uid", "w"), "id").groupBy("qid", "id", "uid", "w", "lim", "n", "is_short").agg(F.min(F.length("alias")).alias("len"))
    boost = (F.lit(1).cast("float") + F.col("w") * F.lit(ix.options.popularity_weight).cast("float") * F.lit(10).cast("float")).cast("double")
    score = F.least((F.lit(100.0) - F.col("len") * F.lit(0.1)) * boost / F.lit(ix.max_score), F.lit(1.0))
    order = Window.partitionBy("qid").orderBy(F.desc("raw"), "uid")
    out = best.withColumn("raw", score).withColumn("rank", F.row_number().over(order)).filter("rank <= lim")
    return out.select("qid", "id", F.when(F.col("is_short"), F.col("raw").cast("float").cast("double")).otherwise(F.col("raw")).alias("score"), "rank")
