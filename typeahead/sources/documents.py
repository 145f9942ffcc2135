"""The document schema and everything that can be turned into it."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidInputError, unknown
from ..functions.edits import key_id, key_ids

SCHEMA = "id long, key string, text string, popularity float, synonyms array<string>, abbreviations array<string>, contexts array<string>, vector array<float>"
FIELDS = ("id", "text", "popularity", "synonyms", "abbreviations", "contexts", "vector")
_LISTS = ("synonyms", "abbreviations", "contexts")


def _array(c: Column) -> Column:
    return F.coalesce(c.cast("array<string>"), F.array().cast("array<string>"))


def to_documents(df: DataFrame, position: str | None = None) -> DataFrame:
    """Project a DataFrame with the documented fields onto the schema and check it.

    A string id is a key; its id is the hash. ``position`` orders repeated ids,
    the last of which wins; without it any one of equal copies does.
    """
    names = [c for c in df.columns if c != position]
    for c in names:
        if c not in (*FIELDS, "key"):
            raise InvalidInputError(unknown("field", c, FIELDS) + f" (fields: {', '.join(FIELDS)})")
    for c in ("id", "text"):
        if c not in names:
            raise InvalidInputError(f"field {c!r} is required")
    keyed = dict(df.dtypes)["id"] == "string"
    col = lambda c, kind: F.col(c).cast(kind) if c in names else F.lit(None).cast(kind)
    out = df.select(
        (key_ids("id") if keyed else F.col("id").cast("long")).alias("id"),
        (F.col("id") if keyed else col("key", "string")).alias("key"),
        F.col("text").cast("string").alias("text"),
        F.coalesce(col("popularity", "float"), F.lit(0).cast("float")).alias("popularity"),
        *[_array(col(c, "array<string>")).alias(c) for c in _LISTS],
        col("vector", "array<float>").alias("vector"),
        *([F.col(position).alias("position")] if position else []),
    )
    bad = F.col("id").isNull() | F.col("text").isNull() | F.isnan("popularity") | (F.abs("popularity") == float("inf"))
    if keyed:
        bad = bad | (F.col("key") == "")
    return out.withColumn("id", F.when(bad, F.raise_error(F.lit("a document needs an id or key, a text and a finite popularity"))).otherwise(F.col("id")))


def last_wins(docs: DataFrame) -> DataFrame:
    """One row per id: the one added last. Different keys under one id are an error."""
    names = [c for c in docs.columns if c != "position"]
    if "position" not in docs.columns:
        docs = docs.withColumn("position", F.monotonically_increasing_id())
    best = docs.groupBy("id").agg(
        F.max_by(F.struct(*names), "position").alias("d"), F.min(F.coalesce("key", F.lit(""))).alias("one"), F.max(F.coalesce("key", F.lit(""))).alias("two")
    )
    clash = F.col("one") != F.col("two")
    return best.select(F.when(clash, F.raise_error(F.concat(F.lit("keys "), "one", F.lit(" and "), "two", F.lit(" share an id")))).otherwise(F.col("d")).alias("d")).select("d.*")


def key_collisions(docs: DataFrame) -> DataFrame:
    """Ids under which different keys stand."""
    return docs.groupBy("id").agg(F.count_distinct(F.coalesce("key", F.lit(""))).alias("keys")).filter("keys > 1")


def check_row(d, where: str) -> tuple:
    d = d if isinstance(d, dict) else d.asDict() if hasattr(d, "asDict") else d.to_dict()
    for c in d:
        if c not in (*FIELDS, "key"):
            raise InvalidInputError(f"{where}: {unknown('field', c, FIELDS)} (fields: {', '.join(FIELDS)})")
    i, key = d.get("id"), d.get("key")
    if isinstance(i, bool) or not isinstance(i, (int, str)):
        raise InvalidInputError(f"{where}: id must be an int or a str")
    if isinstance(i, str):
        if not i:
            raise InvalidInputError(f"{where}: an empty key")
        key, i = i, key_id(i)
    if not isinstance(d.get("text"), str):
        raise InvalidInputError(f"{where}: text is required")
    lists = []
    for c in _LISTS:
        v = d.get(c)
        if isinstance(v, str):
            raise InvalidInputError(f"{where}: {c} must be a list of str, not a str")
        lists.append([] if v is None or v != v else list(v))
    p = float(d.get("popularity") or 0)
    if p != p or abs(p) == float("inf"):
        raise InvalidInputError(f"{where}: popularity must be finite")
    v = d.get("vector")
    return (i - (1 << 64) if i >> 63 else i, key, d["text"], p, *lists, None if v is None else [float(x) for x in v])


def from_rows(spark: SparkSession, source) -> DataFrame:
    """Documents from dicts, rows, or anything with ``to_pylist``, ``to_dicts`` or ``to_dict('records')``; a dict of columns too.

    Of rows with one id the last is kept, in a DataFrame by its partitions and their rows.
    """
    if isinstance(source, DataFrame):
        return last_wins(to_documents(source)).select(*[c.split()[0] for c in SCHEMA.split(", ")])
    if isinstance(source, dict):
        names = list(source)
        source = [dict(zip(names, v)) for v in zip(*source.values(), strict=True)]
    elif hasattr(source, "to_pylist"):
        source = source.to_pylist()
    elif hasattr(source, "to_dicts"):
        source = source.to_dicts()
    elif hasattr(source, "to_dict") and not isinstance(source, Iterable | dict) or hasattr(source, "iloc"):
        source = source.to_dict("records")
    rows = [(*check_row(d, f"document {k}"), k) for k, d in enumerate(source)]
    return last_wins(spark.createDataFrame(rows, SCHEMA + ", position long")).select(*[c.split()[0] for c in SCHEMA.split(", ")])


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """JSON Lines, one document a line; blank lines are skipped but counted, faults name their line."""
    rows = []
    for k, r in enumerate(spark.read.text(path, wholetext=False).toLocalIterator(), 1):
        if not r.value.strip():
            continue
        try:
            rows.append(json.loads(r.value))
        except json.JSONDecodeError as e:
            raise InvalidInputError(f"line {k}: {e.msg}") from None
    return from_rows(spark, rows)


def read_json_table(spark: SparkSession, path: str) -> DataFrame:
    """JSON Lines of any size, read and checked in parallel; last copy of an id by file position."""
    schema = "id string, text string, popularity float, synonyms array<string>, abbreviations array<string>, contexts array<string>"
    df = spark.read.schema(schema).json(path).withColumn("position", F.monotonically_increasing_id())
    number = F.expr("try_cast(id as bigint)")
    docs = to_documents(df.withColumn("key", F.when(number.isNull(), F.col("id"))).withColumn("id", F.coalesce(number, key_ids("id"))), "position")
    return last_wins(docs)
