"""Session helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
_OWN_DIR: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the standard tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    A private one is made only where the setting is absent and the master is local.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if "dir" not in _OWN_DIR:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")

        _OWN_DIR["dir"] = tempfile.mkdtemp(prefix="llm-shared-")
        atexit.register(shutil.rmtree, _OWN_DIR["dir"], True)
    return "file://" + _OWN_DIR["dir"]


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


_open: list[list[str]] = []


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back.

    Unlike a local checkpoint the rows outlive the executors that made them.
    Inside a ``scratch`` block the table is removed at its end unless kept.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    if _open:
        _open[-1].append(path)
    return out


class scratch:
    """Removes the intermediate tables written inside the block, but for those handed to ``keep``."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.made: list[str] = []

    def __enter__(self) -> scratch:
        _open.append(self.made)
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        """A table written inside that outlives the block; it then belongs to the block around it."""
        self.made.remove(df.written_at)
        if len(_open) > 1:
            _open[-2].append(df.written_at)
        return df

    def __exit__(self, *error) -> None:
        _open.pop()
        for path in self.made:
            drop_path(self.spark, path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove an intermediate folder that no later stage reads."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def key_bitmap(keys: DataFrame, column: str, most: int = 28) -> np.ndarray:
    """A one-probe Bloom filter of a long column: some 32 bits a key, 2**most bits at most.

    Beyond that size it passes more rows that the exact join behind it then
    discards, never fewer; where it would pass nearly all it is one full word.
    """
    n = keys.count()
    bits = min(most, max(12, (32 * n).bit_length()))
    if n > 2 << bits:
        return np.full(1, ~U64(0))
    word = F.shiftrightunsigned(F.col(column), 64 - bits + 6)
    bit = F.shiftrightunsigned(F.col(column), 64 - bits).bitwiseAND(63).cast("int")
    rows = (
        keys.select(word.cast("int").alias("w"), F.expr("1L").alias("one"), bit.alias("b"))
        .select("w", F.expr("shiftleft(one, b)").alias("v"))
        .groupBy("w")
        .agg(F.bit_or("v").alias("v"))
        .toArrow()
    )
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[rows["w"].to_numpy()] = rows["v"].to_numpy().astype(np.int64).view(np.uint64)
    return out


def in_bitmap(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which uint64 keys may be in the set (no false negatives)."""
    bits = int(len(bitmap)).bit_length() - 1 + 6
    if bits == 6:
        return np.ones(len(keys), bool)
    k = keys.view(np.uint64) >> np.uint64(64 - bits)
    return (bitmap[(k >> np.uint64(6)).astype(np.int64)] >> (k & np.uint64(63))) & np.uint64(1) != 0


def broadcast_within(df: DataFrame, size, most: int = 32 << 20) -> DataFrame:
    """Hint a broadcast if the rows measure at most ``most`` bytes; beyond it the join shuffles."""
    total = df.agg(F.sum(size)).first()[0] or 0
    return F.broadcast(df) if total <= most else df
