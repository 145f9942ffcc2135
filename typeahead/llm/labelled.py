"""Bounded samples of labelled rows for the operators that fit a classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a classifier is fitted on, at most.
TRAIN_ROWS = 20_000


def held_out(column: str = "doc_id"):
    """True for the fifth of the rows that no classifier learns from."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 5 == 0, F.lit(True))


def sample(docs: DataFrame, labels: DataFrame, column: str, rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, text, y) of at most ``rows`` labelled documents outside the held-out fold, least hash first.

    The label side is cut to its bound before it meets the texts, so the
    broadcast below is of at most ``rows`` pairs of numbers.
    """
    y = labels.filter(F.col(column).isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(column).cast("int").alias("y"))
    y = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(y), "doc_id")
