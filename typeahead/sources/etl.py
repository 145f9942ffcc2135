"""Corpus preparation: from raw tables to document tables."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.lineage import cut


def numbered(df: DataFrame, *order: str, name: str = "id") -> DataFrame:
    """Consecutive numbers from 1 in the given order, without one task that holds all rows."""
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = cut(sorted_.withColumn("_place", F.monotonically_increasing_id()))
    rows = rows.withColumn("_part", F.shiftright("_place", 33))
    sizes = sorted(rows.groupBy("_part").count().collect())  # one row a partition
    before = list(accumulate([0] + [r["count"] for r in sizes]))
    offsets = df.sparkSession.createDataFrame([(r["_part"], b) for r, b in zip(sizes, before)], "_part long, _before long")
    out = rows.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_place").bitwiseAND((1 << 33) - 1) + 1)
    return out.drop("_part", "_before", "_place")


def log_popularity(df: DataFrame, column: str) -> DataFrame:
    """popularity = log1p(score) / log1p(largest score)."""
    top = df.agg(F.max(column).alias("top"))
    return df.crossJoin(F.broadcast(top)).withColumn("popularity", F.when(F.col("top") > 0, F.log1p(F.col(column)) / F.log1p("top")).otherwise(0.0)).drop("top")


def best_copy(df: DataFrame, title: str, score: str, position: str) -> DataFrame:
    """Of titles equal in lower case the one with the best score, the first of equals."""
    order = Window.partitionBy(T.lower(F.col(title))).orderBy(F.desc(score), position)
    return df.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")


def article_titles(pages: DataFrame, views: DataFrame) -> DataFrame:
    """(id, title, score) of articles (namespace 0, no redirects) with their summed views, 0 without any."""
    total = views.groupBy("title").agg(F.sum("views").alias("score"))
    return pages.filter("namespace = 0 and not is_redirect").join(total, "title", "left").select("id", "title", F.coalesce("score", F.lit(0)).alias("score"))


def search_terms(log: DataFrame, term: str, count: str) -> DataFrame:
    """(id, title, score): distinct terms numbered in order, each with its largest count."""
    best = log.groupBy(F.col(term).alias("title")).agg(F.max(count).alias("score"))
    return numbered(best, "title").select(F.col("id").cast("long").alias("id"), "title", "score")


def label_prefixes(tests: DataFrame, terms: DataFrame) -> DataFrame:
    """(prefix, term, id) with a null id where the term is not in the corpus."""
    return tests.join(terms.select(F.col("title").alias("term"), "id"), "term", "left").select("prefix", "term", "id")


def recordings(listens: DataFrame, names: DataFrame, artists: DataFrame) -> DataFrame:
    """(id, title, score): listens summed over nested lists, titled ``name – artist``."""
    flat = listens.select(F.explode("recordings").alias("r")).groupBy(F.col("r.id").alias("id")).agg(F.sum("r.listens").alias("score"))
    titled = names.join(artists, "artist_id", "left").select("id", F.concat_ws(" – ", "name", "artist").alias("title"))
    return titled.join(flat, "id", "left").select("id", "title", F.coalesce("score", F.lit(0)).alias("score"))


def works(titles: DataFrame, logs: list[DataFrame], authors: DataFrame) -> DataFrame:
    """(id, title, score): works with their first known author, scored by readers' rows; white space collapsed."""
    rows = logs[0].select("id")
    for log in logs[1:]:
        rows = rows.unionByName(log.select("id"))
    readers = rows.groupBy("id").agg(F.count("*").alias("score"))
    first = titles.select("id", F.posexplode("author_ids").alias("k", "author_id")).join(authors, "author_id").groupBy("id").agg(F.min_by("author", "k").alias("author"))
    clean: Column = F.trim(F.regexp_replace(F.concat_ws(" – ", "title", "author"), r"\s+", " "))
    return titles.join(first, "id", "left").join(readers, "id", "left").select("id", clean.alias("title"), F.coalesce("score", F.lit(0)).alias("score"))
