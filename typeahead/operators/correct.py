"""Spelling: near words, near prefixes, phrase corrections, splits."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.edits import nearest
from ..plans.lineage import cut, meet
from .index import Index
from .retrieve import docs_with_words, starting_with

NEAR, SHOWN = 64, 3


def near_words(ix: Index, terms: DataFrame, most: int = NEAR) -> DataFrame:
    """(term, prefix, found, distance, n, rank): dictionary words, or their prefixes, near each term.

    Words meet terms on a common deletion variant of their heads; with
    ``prefix`` a longer word counts by its closest prefix, and words that share
    it pool their frequency.
    """
    b = ix.build
    terms = cut(terms)
    heads = terms.select("term", "prefix", F.explode(T.delete_variants(F.col("term"), b.max_edit_distance, b.fuzzy_prefix_chars)).alias("variant"))
    met = cut(meet(heads, ix.variants, "variant").select("term", "prefix", "head").distinct())
    words = ix.freq.filter("n > 0").withColumn("head", F.substring("word", 1, b.fuzzy_prefix_chars))
    pairs = meet(met, words, "head")
    wide = 2 * b.max_edit_distance
    whole = ~F.col("prefix") | (F.length("word") <= F.length("term"))
    pairs = pairs.filter(~whole | (F.abs(F.length("word") - F.length("term")) <= b.max_edit_distance) & (F.levenshtein("word", "term", wide) >= 0))
    hit = pairs.withColumn("hit", nearest(F.col("term"), F.col("prefix"), F.col("word"), F.lit(b.max_edit_distance))).filter("hit.found is not null")
    pooled = hit.groupBy("term", "prefix", F.col("hit.found").alias("found")).agg(F.min("hit.distance").alias("distance"), F.sum("n").alias("n"))
    order = Window.partitionBy("term", "prefix").orderBy("distance", F.desc("n"), F.col("found").cast("binary"))
    return pooled.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def fitting(ix: Index, words: DataFrame, near: DataFrame) -> DataFrame:
    """(qid, place, found, distance, together): corrections that a document holds beside the query's other words.

    Other words are those of at least the indexed length that begin words in few
    documents (one in twenty); only the closest distance that fits counts.
    """
    terms = words.filter(F.length("word") >= ix.build.min_word_chars)
    bound = starting_with(terms.select(F.col("word").alias("term")).distinct(), "term", ix.dictionary, "word").groupBy("term").agg(F.sum("n").alias("bound"))
    rare = terms.join(bound.withColumnRenamed("term", "word"), "word", "left").filter(F.coalesce("bound", F.lit(0)) <= ix.count // 20)
    rare = rare.select("qid", F.col("place").alias("other"), F.col("word").alias("other_word"))
    target = words.filter("not last and size(all_words) > 1").select("qid", "place", "word")
    beside = target.join(rare, "qid").filter("other <> place")
    held = docs_with_words(ix, beside.select(F.struct("qid", "place").alias("key"), F.col("other").alias("place"), F.col("other_word").alias("term")))
    held = cut(held.select("key.qid", "key.place", "id"))
    found = target.join(near.filter("not prefix").withColumnRenamed("term", "word"), "word").select("qid", "place", "found", "distance", "n", "rank")
    both = meet(held, ix.postings.withColumnRenamed("word", "found"), "id").join(found, ["qid", "place", "found"])  # from few documents to their words
    count = both.groupBy("qid", "place", "found", "distance", "rank").agg(F.count("*").alias("together"))
    closest = F.min("distance").over(Window.partitionBy("qid", "place"))
    return count.withColumn("closest", closest).filter("distance = closest").drop("closest")


def compound(words: list[dict], stuck: bool, splits: list[tuple], phrase: str) -> list[tuple[str, int]]:
    """Phrases near a query and their costs, cheapest first.

    Each word brings its own verdict: kept, replaced, and what else might stand
    there at which extra cost. One replacement set makes the first phrase; each
    alternative makes another, one at a time.
    """
    chosen, cost, replaced, others = [], 0, False, []
    for i, w in enumerate(words):
        near, fit = w["near"], w["fit"]
        keep, extra = w["word"], []
        if w["short"] or w["typing"] and not stuck:
            pass
        elif w["typing"]:
            extra = [(x, d) for x, d, _ in near[:SHOWN] if d > 0]
        else:
            ask = stuck or bool(near) and near[0][1] > 0
            pool = [(x, d, 0) for x, d in fit] if ask and fit else near[:SHOWN]
            if pool and pool[0][1] > 0:
                keep, base = pool[0][0], pool[0][1]
                cost += base
                replaced = True
                extra = [(x, d - base) for x, d, _ in pool[1:SHOWN] if d > 0]
            elif pool and not (ask and fit):
                usual = max(20 * pool[0][2], 20)
                extra = [(x, 1) for x, d, n in pool[1:] if d == 1 and n >= usual][:1]
        chosen.append(keep)
        others += [(i, x, more) for x, more in extra]
    out = []
    if replaced and " ".join(chosen) != phrase:
        out.append((" ".join(chosen), max(cost, 1)))
    for i, x, more in others:
        out.append((" ".join([*chosen[:i], x, *chosen[i + 1 :]]), max(cost + max(more, 0), 1)))
    out += [(f"{a} {b}", d + e + 1) for a, d, b, e in splits if d <= 1 and e <= 1 and f"{a} {b}" != phrase]
    out.sort(key=lambda x: x[1])
    return _first_of_each(out)


def _first_of_each(pairs: list[tuple[str, int]]) -> list[tuple[str, int]]:
    seen: dict[str, int] = {}
    for text, cost in pairs:
        seen.setdefault(text, cost)
    return list(seen.items())


PHRASES = "qid string, phrase string, distance int, rank int, source string"


def _assemble(pdf: pd.DataFrame) -> pd.DataFrame:
    rows = []
    for r in pdf.itertuples():
        words = sorted((w for w in r.words), key=lambda w: w["place"])
        words = [
            {**w, "near": [(x["found"], x["distance"], x["n"]) for x in w["near"]], "fit": [(x["found"], x["distance"]) for x in w["fit"]]} for w in words
        ]
        splits = [(s["left"], s["ld"], s["right"], s["rd"]) for s in sorted(r.splits, key=lambda s: s["at"])]
        got = compound(words, bool(r.stuck), splits, r.ql)[:SHOWN]
        rows += [(r.qid, p, d, k, "compound") for k, (p, d) in enumerate(got)]
        spelling = [(p, d) for p, d in got if p != r.ql]
        known = {p for p, _ in spelling}
        spelling += [(x["found"], x["distance"]) for x in r.whole if x["found"] != r.ql and x["distance"] > 0 and x["found"] not in known]
        spelling = sorted(spelling, key=lambda x: x[1])[: r.p_cap]
        rows += [(r.qid, p, d, k, "spelling") for k, (p, d) in enumerate(spelling)]
    return pd.DataFrame(rows, columns=["qid", "phrase", "distance", "rank", "source"])


def phrases(ix: Index, q: DataFrame) -> DataFrame:
    """Corrected phrases of prepared queries with a ``stuck`` flag.

    ``source`` is ``compound`` for phrase corrections alone, ``spelling`` for
    them and near words of the whole query together.
    """
    least = max(ix.build.min_word_chars, 2)
    words = q.filter(F.size("words") > 0).select("qid", "stuck", F.col("words").alias("all_words"), F.posexplode("words").alias("place", "word"))
    words = words.withColumn("last", F.col("place") + 1 == F.size("all_words"))
    typing = starting_with(words.filter("last").select("qid", "word").withColumnRenamed("word", "term"), "term", ix.dictionary, "word").select("qid").distinct()
    words = words.join(typing.withColumn("begun", F.lit(True)), "qid", "left")
    words = words.withColumn("typing", F.col("last") & F.coalesce("begun", F.lit(False))).withColumn("prefix", F.col("last") & (F.length("word") >= 3))
    words = cut(words.withColumn("short", F.length("word") < least))
    single = words.filter((F.size("all_words") == 1) & (F.length("word") > 6))
    cuts = single.select("qid", "word", F.explode(F.sequence(F.lit(3), F.length("word") - 3)).alias("at"))
    halves = cuts.select("qid", "at", F.expr("substring(word, 1, at)").alias("l"), F.expr("substring(word, at + 1)").alias("r"))
    no = F.lit(False).alias("prefix")
    terms = (
        words.filter("not short and (not typing or stuck)").select(F.col("word").alias("term"), "prefix")
        .unionByName(halves.select(F.col("l").alias("term"), no))
        .unionByName(halves.select(F.col("r").alias("term"), no))
        .unionByName(q.select(F.col("ql").alias("term"), no))
        .distinct()
    )
    near = cut(near_words(ix, terms))
    item = F.struct("rank", "found", "distance", F.col("n").cast("long").alias("n"))
    lists = near.groupBy("term", "prefix").agg(F.array_sort(F.collect_list(item)).alias("near"))  # NEAR entries at most
    fit = fitting(ix, words, near).groupBy("qid", "place").agg(F.array_sort(F.collect_list(F.struct((-F.col("together")).alias("o"), "rank", "found", "distance"))).alias("fit"))
    none = F.array().cast("array<struct<rank:int,found:string,distance:int,n:bigint>>")
    no_fit = F.array().cast("array<struct<o:bigint,rank:int,found:string,distance:int>>")
    full = words.join(lists.withColumnRenamed("term", "word"), ["word", "prefix"], "left").join(fit, ["qid", "place"], "left")
    full = full.groupBy("qid").agg(F.collect_list(F.struct("place", "word", "short", "typing", F.coalesce("near", none).alias("near"), F.coalesce("fit", no_fit).alias("fit"))).alias("words"))
    best = near.filter("not prefix and rank = 1").select("term", "found", "distance")
    sides = halves.join(best.select(F.col("term").alias("l"), F.col("found").alias("left"), F.col("distance").alias("ld")), "l")
    sides = sides.join(best.select(F.col("term").alias("r"), F.col("found").alias("right"), F.col("distance").alias("rd")), "r")
    sides = sides.groupBy("qid").agg(F.collect_list(F.struct("at", "left", "ld", "right", "rd")).alias("splits"))
    whole = q.select("qid", "ql", "p_cap", "stuck").join(lists.filter("not prefix").select(F.col("term").alias("ql"), F.slice("near", 1, 5).alias("whole")), "ql", "left")
    no_split = F.array().cast("array<struct<at:int,left:string,ld:int,right:string,rd:int>>")
    rows = whole.join(full, "qid").join(sides, "qid", "left")
    rows = rows.select("qid", "ql", "p_cap", "stuck", "words", F.coalesce("splits", no_split).alias("splits"), F.coalesce("whole", none).alias("whole"))
    return rows.mapInPandas(lambda it: map(_assemble, it), PHRASES)
