"""Text primitives, edit distance and highlights."""

from pyspark.sql import functions as F

from typeahead.errors import InvalidInputError, closest
from typeahead.functions import edits
from typeahead.functions import text as T


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column.alias("y")).first().y


def test_normalisation(spark):
    x = F.col("x")
    assert one(spark, T.lower(x), "ΟΔΟΣ İ") == "οδος i̇"
    assert one(spark, T.strip(x), " 　a b\x1c\n") == "a b"
    assert one(spark, T.words(x), "a\x1db c\x85d") == ["a", "b", "c", "d"]
    assert one(spark, T.indexed_words(x), "ab abc  😀😀😀") == ["abc", "😀😀😀"]


def test_keys_sort_after_their_extensions(spark):
    df = spark.createDataFrame([(w,) for w in ("danc", "é", "dancing", "dance")], "x string")
    assert [r.x for r in df.orderBy(T.term_key(F.col("x"))).collect()] == ["dance", "dancing", "danc", "é"]


def test_variants(spark):
    assert set(one(spark, T.delete_variants(F.col("x")), "abc")) == {"abc", "ab", "ac", "bc", "a", "b", "c"}
    assert one(spark, T.delete_variants(F.col("x")), "a") == ["a"]
    assert max(map(len, one(spark, T.delete_variants(F.col("x")), "abcdefghij"))) == 7


def test_unsigned(spark):
    df = spark.createDataFrame([(-1,), (1,), (-(1 << 63),), ((1 << 63) - 1,)], "id long").orderBy(T.unsigned(F.col("id")))
    assert [int(r.s) for r in df.select(T.shown_id(F.col("id")).alias("s")).collect()] == [1, (1 << 63) - 1, 1 << 63, (1 << 64) - 1]


def test_osa():
    assert [edits.osa(a, b, 2) for a, b in (("ca", "abc"), ("ca", "ac"), ("abcd", "abdc"), ("", "ab"), ("abcdef", "abc"))] == [None, 1, 1, 2, None]
    assert edits.osa("ca", "abc", 3) == 3
    assert edits.closest_prefix("gzm", "gizmos", 2) == ("gizm", 1)


def test_keys(spark):
    assert edits.key_id("bridge") == 17491315868598813430
    got = spark.createDataFrame([("bridge",)], "k string").select(edits.key_ids("k").alias("i")).first().i
    assert got % (1 << 64) == 17491315868598813430


def test_highlights():
    assert edits.highlight("mach", "Machine Learning") == [(0, 4)]
    assert edits.highlight("machne lerning", "Machine Learning") == [(0, 7), (8, 16)]
    assert edits.highlight("dancingqueen", "Dancing Queen – ABBA") == [(0, 7), (8, 13)]
    assert edits.highlight("ML", "Machine Learning") == []


def test_hints():
    assert closest("documets", ["documents", "deletes"]) == "documents"
    assert closest("zzz", ["documents"]) is None
    assert issubclass(InvalidInputError, ValueError)


def test_marks_by_each_rule():
    from typeahead.functions.edits import highlight

    assert highlight("gar qui", "A Quiet Garden") == [(2, 5), (8, 11)]
    assert highlight("gadren", "A Quiet Garden") == [(8, 14)]
    assert highlight("quietgard", "A Quiet Garden") == [(2, 7), (8, 14)]
    assert highlight("a a", "a b") == [(0, 1)]
    assert highlight("zz", "a b") == []
    assert highlight("", "a") == highlight("a", "") == []
