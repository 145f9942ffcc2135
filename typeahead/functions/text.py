"""Text primitives as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that separate words (fixed values).
SPACE = r"[\t-\r\x1c-\x20\x85\p{Z}]"
#: Prefix lengths that a prefix join meets on.
RUNGS = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32)
SIGN = -(1 << 63)


def lower(c: Column) -> Column:
    return F.lower(c)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def words(c: Column) -> Column:
    return F.filter(F.split(c, f"{SPACE}+"), lambda w: w != "")


def indexed_words(c: Column, least: int = 3) -> Column:
    return F.filter(words(c), lambda w: F.length(w) >= least)


def term_key(c: Column) -> Column:
    """Sorts a text after all its extensions."""
    return F.concat(c.cast("binary"), F.lit(b"\xff"))


def unsigned(c: Column) -> Column:
    """Orders bit patterns as unsigned numbers."""
    return c.bitwiseXOR(F.lit(SIGN))


def shown_id(c: Column) -> Column:
    """The unsigned value of a bit pattern."""
    wide = c.cast("decimal(20,0)")
    return F.when(c < 0, wide + F.lit(str(1 << 64)).cast("decimal(20,0)")).otherwise(wide).cast("decimal(20,0)")


def _drop_one(c: Column) -> Column:
    return F.when(
        F.length(c) > 1,
        F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c)))),
    ).otherwise(F.array().cast("array<string>"))


def delete_variants(c: Column, distance: int = 2, head: int = 7) -> Column:
    """The first ``head`` characters and all strings that up to ``distance`` deletions leave of them."""
    level = F.array(F.substring(c, 1, head))
    out = level
    for _ in range(distance):
        level = F.array_distinct(F.flatten(F.transform(level, _drop_one)))
        out = F.array_distinct(F.concat(out, level))
    return out


def rungs(c: Column) -> Column:
    """(length, prefix) of each rung that fits in the text."""
    fits = F.filter(F.array(*map(F.lit, RUNGS)), lambda k: k <= F.length(c))
    return F.transform(fits, lambda k: F.struct(k.alias("rung"), F.substring(c, F.lit(1), k).alias("pre")))


def rung(c: Column) -> Column:
    """The longest rung not above a query's length."""
    return F.array_max(F.filter(F.array(*map(F.lit, RUNGS)), lambda k: k <= F.length(c)))
