"""Ranked completion of a set of queries.

A pass ranks direct hits and, where they are few and the depth allows, hits of
corrected phrases. Passes for run-together words and for queries that nothing
matched run only over the queries that need them; passes are cut by written
stages, so plans stay small and outlive executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.edits import highlights
from ..plans.lineage import cut, first, meet
from .correct import phrases
from .index import Index
from .retrieve import abbreviation, exact_title, infix, prepare, short_queries, title_prefix

HITS = ("qid", "id", "score", "kind", "rank")


def query_set(queries: DataFrame, limit: int) -> DataFrame:
    """Adds what is missing of lim and ctx; qid as a string."""
    lim = F.coalesce(F.col("limit").cast("int"), F.lit(limit)) if "limit" in queries.columns else F.lit(limit)
    ctx = F.col("contexts") if "contexts" in queries.columns else F.array().cast("array<string>")
    return queries.select(F.col("qid").cast("string").alias("qid"), "query", lim.alias("lim"), F.coalesce(ctx, F.array().cast("array<string>")).alias("ctx"))


def sources(ix: Index, q: DataFrame) -> DataFrame:
    """(qid, id, source) of all direct sources of prepared queries."""
    found = {"prefix": title_prefix, "exact": exact_title, "infix": infix, "abbreviation": abbreviation}
    rows = [f(ix, q).withColumn("source", F.lit(name)) for name, f in found.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


def direct(rows: DataFrame) -> DataFrame:
    """(qid, id, is_exact, from_prefix, is_abbreviation): precedence among the direct sources."""
    has = lambda s: F.max(F.col("source") == s)
    by = rows.groupBy("qid", "id").agg(has("exact").alias("is_exact"), (has("prefix") | has("exact")).alias("titled"), has("infix").alias("inside"), has("abbreviation").alias("is_abbreviation"))
    return by.select("qid", "id", "is_exact", (F.col("titled") | F.col("is_abbreviation") & ~F.col("inside")).alias("from_prefix"), "is_abbreviation")


def corrected(ix: Index, q: DataFrame, spelled: DataFrame) -> DataFrame:
    """(qid, id, distance, place, own): the best corrected phrase that reaches each document.

    Whole classes of equal distance are taken, closest first, until the classes
    before hold twice the limit of documents.
    """
    sub = spelled.filter("source = 'spelling'").join(q.select("qid", "lim", "ctx"), "qid")
    sub = sub.select(F.concat_ws("\x1f", "qid", "rank").alias("sub"), "qid", "phrase", "distance", "rank", "lim", "ctx")
    hits = one_pass(ix, sub.select(F.col("sub").alias("qid"), F.col("phrase").alias("query"), (F.col("lim") * 2).alias("lim"), "ctx"), 2)
    rows = hits.select(F.col("qid").alias("sub"), "id", F.col("score").alias("own")).join(sub.select("sub", "qid", "distance", F.col("rank").alias("place"), "lim"), "sub")
    best = cut(rows.groupBy("qid", "id", "lim").agg(F.min(F.struct("distance", "place", "own")).alias("b")).select("qid", "id", "lim", "b.*"))
    per = best.groupBy("qid", "distance").agg(F.count("*").alias("m"))
    before = F.coalesce(F.sum("m").over(Window.partitionBy("qid").orderBy("distance").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return best.join(per.withColumn("before", before), ["qid", "distance"]).filter("before < 2 * lim").select("qid", "id", "distance", "place", "own")


def rank(ix: Index, q: DataFrame, found: DataFrame) -> DataFrame:
    """Score, order, cut and normalise candidates; corrections come below every direct hit."""
    zero, one = F.lit(0.0).cast("float"), F.lit(1.0).cast("float")
    docs = ix.docs.select("id", "uid", "w", "len", "single")
    rows = meet(q.select("qid", "q", "lim"), meet(found, docs, "id"), "qid")
    asked = q.filter((F.instr("q", " ") == 0) & (F.col("q") != "")).select("q").distinct()
    bonus = meet(asked, ix.postings.select(F.col("word").alias("q"), "id", F.lit(True).alias("holds")), "q")
    rows = rows.join(bonus, ["q", "id"], "left")
    mult = (one + F.greatest(F.col("w"), zero) * F.lit(ix.factor).cast("float")).cast("double")
    fuzzy = F.col("distance").isNotNull()
    far = F.lit(20.0) * F.pow(F.lit(0.15), (F.col("distance") - 1).cast("double")) + F.greatest(F.lit(5.0) - F.col("place"), F.lit(0.0))
    base = F.when(fuzzy, far + F.lit(0.25) * (F.col("own") * F.lit(ix.max_score) / mult)).when(F.col("is_exact"), 150.0).when(F.col("from_prefix"), 90.0).otherwise(30.0)
    word = (F.instr("q", " ") == 0) & ~F.col("single") & F.coalesce("holds", F.lit(False))
    raw = (base - F.col("len").cast("double") * F.lit(0.1) + F.when(word, 25.0).otherwise(0.0)) * mult
    kept = first(rows.withColumn("raw", raw), [fuzzy, F.desc("raw"), F.col("len"), F.col("uid")], "lim", "rank")
    kept = kept.withColumn("part", F.least(F.col("raw") / F.lit(ix.max_score), F.lit(1.0))).withColumn("fuzzy", fuzzy)
    by = Window.partitionBy("qid")
    top, low = F.max(F.when(fuzzy, F.col("part"))).over(by), F.min(F.when(~fuzzy, F.col("part"))).over(by)
    kept = kept.withColumn("top", top).withColumn("low", low)
    score = F.when(F.col("fuzzy") & (F.col("top") > 0) & F.col("low").isNotNull(), F.col("part") * (F.col("low") * 0.95 / F.col("top"))).otherwise(F.col("part"))
    kind = F.when(F.col("fuzzy"), "fuzzy").when(F.col("is_exact"), "exact").when(F.col("is_abbreviation"), "abbreviation").when(F.col("from_prefix"), "prefix").otherwise("infix")
    return kept.select("qid", "id", score.alias("score"), kind.alias("kind"), "rank")


def one_pass(ix: Index, queries: DataFrame, depth: int) -> DataFrame:
    """Hits of (qid, query, lim, ctx); corrections below depth 2, run-together words at depth 0."""
    q = prepare(queries)
    blank = [F.lit(None).cast("int").alias("distance"), F.lit(None).cast("int").alias("place"), F.lit(None).cast("double").alias("own")]
    if depth == 2:
        return rank(ix, q, direct(cut(sources(ix, q))).select("*", *blank))
    rows = cut(sources(ix, q))
    plain = direct(rows)
    found = plain.select("*", *blank)
    is_, one_word = (lambda s: F.col("source") == s), (F.instr("q", " ") == 0) & (F.col("n") > 8)
    count = rows.groupBy("qid").agg(F.count(F.when(is_("prefix"), 1)).alias("titles"), F.count(F.when(is_("prefix") | is_("infix"), 1)).alias("reached"))
    state = q.join(count, "qid", "left").withColumn("needy", (F.coalesce("titles", F.lit(0)) < F.col("lim")) & (F.col("n") >= 3))
    state = cut(state.withColumn("run_on", one_word).withColumn("stuck", F.coalesce("reached", F.lit(0)) == 0))
    any_needy, any_run_on = state.agg(F.max("needy"), F.max("run_on")).first()
    if any_needy:
        needy = state.filter("needy")
        spelled = cut(phrases(ix, needy))
        if spelled.filter("source = 'spelling'").take(1):
            fuzzy = cut(corrected(ix, needy, spelled).join(plain.select("qid", "id"), ["qid", "id"], "left_anti"))
            no = F.lit(False)
            found = found.unionByName(fuzzy.select("qid", "id", no.alias("is_exact"), no.alias("from_prefix"), no.alias("is_abbreviation"), "distance", "place", "own"))
    hits = rank(ix, q, found).select(*HITS)
    if depth == 0 and any_run_on:
        hits = cut(hits)
        met = hits.filter("kind in ('exact', 'prefix', 'abbreviation')").select("qid").distinct()
        asked = state.filter("run_on").join(met, "qid", "left_anti").withColumn("query", F.col("q")).withColumn("ql", F.col("q")).withColumn("stuck", F.lit(False))
        whole = phrases(ix, asked).filter("source = 'compound' and rank = 0").join(asked.select("qid", "q", "lim", "ctx"), "qid").filter("phrase <> q")
        whole = cut(whole.select("qid", F.col("phrase").alias("query"), "lim", "ctx"))
        if whole.take(1):
            hits = hits.join(whole.select("qid"), "qid", "left_anti").select(*HITS).unionByName(one_pass(ix, whole, 1))
    return hits


def ranked(ix: Index, q: DataFrame, retry: bool = True) -> DataFrame:
    """Hits of a query set as ``query_set`` makes it, with the short-query path and the retry on long words."""
    ix, q = ix.stored(), cut(q)
    short = short_queries(ix, q).withColumnRenamed("q", "short_q")
    q = cut(q.join(short, "qid", "left"))
    asked = q.select("qid", F.coalesce("short_q", "query").alias("query"), F.when(F.col("short_q").isNotNull(), ix.options.short_query_limit).otherwise(F.col("lim")).alias("lim"), "ctx")
    hits = one_pass(ix, asked, 0)
    hits = hits.join(q.select("qid", F.col("lim").alias("cap"), F.col("short_q").isNotNull().alias("is_short")), "qid").filter("rank <= cap")
    hits = cut(hits.select("qid", "id", F.when(F.col("is_short"), F.col("score").cast("float").cast("double")).otherwise(F.col("score")).alias("score"), "kind", "rank"))
    if retry:
        words = T.words(T.lower(F.col("query")))
        long = F.filter(words, lambda w: F.length(w) >= ix.build.min_word_chars)
        mixed = q.filter("short_q is null").filter((F.size(long) > 0) & (F.size(long) < F.size(words)))
        if mixed.take(1):
            again = mixed.join(hits.select("qid").distinct(), "qid", "left_anti")
            again = cut(again.select("qid", F.array_join(long, " ").alias("query"), "lim", "ctx"))
            if again.take(1):
                hits = hits.unionByName(ranked(ix, again, False))
    return hits


def complete(ix: Index, queries: DataFrame, limit: int = 10, marks: bool = True) -> DataFrame:
    """(qid, rank, id, key, text, score, kind, highlights) for queries(qid, query[, contexts][, limit])."""
    q = query_set(queries, limit)
    hits = ranked(ix, q)
    out = meet(hits, ix.documents.select("id", "key", "text"), "id").join(q.select("qid", "query"), "qid")
    shown = [highlights(F.col("query"), F.col("text")).alias("highlights")] if marks else []
    return out.select(F.col("qid").cast(queries.schema["qid"].dataType).alias("qid"), "rank", "id", "key", "text", "score", "kind", *shown)
