"""Connected components of an edge table, without a driver-side graph.

Alternates large-star and small-star steps: each is one min-aggregation and one
join over the edges; the rounds grow with the logarithm of the longest path, and
stop as soon as every node hangs on its root by one edge.

Edge cases: loops and repeated edges do not count; null ends are dropped; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    low = materialize(low, "least")  # so that a node with very many edges is a skewed join, which Spark splits
    hung = both.join(low, "u")
    if large:
        out = hung.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one edge down and no root has one."""
    one = F.lit(1).cast("long")
    ends = edges.select(F.col("u").alias("x"), one.alias("down"), (one * 0).alias("up")).unionByName(edges.select(F.col("v").alias("x"), (one * 0).alias("down"), one.alias("up")))
    return ends.groupBy("x").agg(F.sum("down").alias("down"), F.sum("up").alias("up")).filter("down > 1 or (down > 0 and up > 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) long pairs -> (u, root): the least node reachable from each node but the root itself."""
    spark = edges.sparkSession
    with scratch(spark) as outer:
        now = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
        while not _settled(now):
            with scratch(spark) as round_:
                now = round_.keep(materialize(_star(_star(now, True), False), "edges"))
        return outer.keep(now).select("u", F.col("v").alias("root"))
