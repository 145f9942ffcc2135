"""Cutting long plans into stages that survive lost executors; joins and cuts that no table's growth brings to the driver or to one task."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Planned bytes up to which a query side is broadcast; parts that a group is ordered in before it is ordered whole.
SMALL, PARTS = 256 << 10, 32
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a private folder only where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="typeahead-")
        atexit.register(shutil.rmtree, _own["dir"], True)
    return "file://" + _own["dir"]


def cut(df: DataFrame) -> DataFrame:
    """Write a stage's rows to the shared folder and read them back."""
    path = f"{shared_dir(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def planned(df: DataFrame) -> int:
    """Bytes that the planner expects of a frame: of a written stage those of its files, of rows made in Python far too many."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def meet(few: DataFrame, table: DataFrame, on: str | list[str]) -> DataFrame:
    """Inner join of rows that come from queries with an index table.

    The table is never broadcast: its files are far smaller than its rows, so the
    planner would send a large one through the driver. The other side is where
    it is small, else both are shuffled.
    """
    if planned(few) <= SMALL:
        return F.broadcast(few).join(table, on)
    return few.join(table.hint("merge"), on)


def first(rows: DataFrame, order: list[Column], most: str | Column, name: str = "r") -> DataFrame:
    """The first ``most`` rows of each qid and their places; ordered in parts by id first, so that no task orders all of a qid."""
    most = F.col(most) if isinstance(most, str) else most
    place = lambda *by: F.row_number().over(Window.partitionBy("qid", *by).orderBy(*order))
    some = rows.withColumn(name, place(F.pmod(F.xxhash64("id"), F.lit(PARTS)))).filter(F.col(name) <= most)
    return some.withColumn(name, place()).filter(F.col(name) <= most)
