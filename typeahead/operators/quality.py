"""How well completion serves typing: ranks, keystrokes, labelled prefixes, latencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def prefixes(targets: DataFrame, least: int = 1) -> DataFrame:
    """(qid, target, len, query): every prefix of each (id, title) as it is typed."""
    one = targets.select(F.col("id").alias("target"), F.lower("title").alias("t")).withColumn("len", F.explode(F.sequence(F.lit(least), F.length("t"))))
    return one.select(F.concat_ws("/", "target", "len").alias("qid"), "target", "len", F.expr("substring(t, 1, len)").alias("query"))


def ranks(typed: DataFrame, hits: DataFrame) -> DataFrame:
    """(target, len, rank): where the target stands in the hits of each prefix, null if it does not."""
    return typed.join(hits.select("qid", F.col("id").alias("target"), "rank"), ["qid", "target"], "left").select("target", "len", "rank")


def typing_quality(ranked: DataFrame, k: int = 5, at: tuple[int, ...] = (3, 5, 8)) -> DataFrame:
    """One row: mean reciprocal rank over targets' prefixes, success at 1 and k by length, reach, keystrokes."""
    rr = F.coalesce(F.lit(1.0) / F.col("rank"), F.lit(0.0))
    one = ranked.groupBy("target").agg(
        F.avg(rr).alias("rr"),
        F.min(F.when(F.col("rank") <= k, F.col("len"))).alias("keys"),
        F.max("len").alias("whole"),
        F.max((F.coalesce("rank", F.lit(0)) == 1).cast("int")).alias("top"),
        *[F.max(F.when(F.col("len") == n, (F.coalesce("rank", F.lit(1 << 30)) <= m).cast("int"))).alias(f"s{m}_{n}") for n in at for m in (1, k)],
    )
    typed = F.coalesce("keys", "whole")
    return one.agg(
        F.avg("rr").alias("mrr"),
        F.avg("top").alias("reached_top"),
        F.avg(typed).alias("keystrokes"),
        F.avg(F.lit(1.0) - typed / F.col("whole")).alias("saved"),
        *[F.avg(f"s{m}_{n}").alias(f"s_at_{m}_{n}") for n in at for m in (1, k)],
    )


def labelled_quality(labelled: DataFrame) -> DataFrame:
    """One row over (rank or null): success at 1 and 10, reciprocal rank within 10."""
    hit = lambda n: F.avg((F.coalesce("rank", F.lit(1 << 30)) <= n).cast("int"))
    return labelled.agg(hit(1).alias("s_at_1"), hit(10).alias("s_at_10"), F.avg(F.when(F.col("rank") <= 10, F.lit(1.0) / F.col("rank")).otherwise(0.0)).alias("mrr_10"))


def latency_percentiles(df: DataFrame, column: str, ps: tuple[int, ...] = (50, 90, 99)) -> DataFrame:
    """(p, value): the element at place round(p / 100 * (n - 1)) of the ascending order."""
    from .index import kth_smallest

    n = df.filter(F.col(column).isNotNull()).count()
    return df.sparkSession.createDataFrame([(p, float(kth_smallest(df, column, round(p / 100 * (n - 1))))) for p in ps] if n else [], "p int, value double")


def hot_queries(log: DataFrame, column: str, n: int) -> DataFrame:
    """(query, hits): the most frequent short queries, equal counts by text."""
    return log.groupBy(F.col(column).alias("query")).agg(F.count("*").alias("hits")).orderBy(F.desc("hits"), "query").limit(n)


def rank_within(df: DataFrame, by: str, *order) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
