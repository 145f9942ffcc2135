"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; all but the last return the columns of ``docs``. Near-duplicates are five-
word shingle sets with a similarity of 0.8 or more.

Edge cases are those of the operators: null and blank texts fail the base rules
of the second stage and go; rows that repeat a doc_id with a text of their own are
documents of their own; rows without doc_id stay in the near-copy stage; an empty
table gives an empty result; stages before the last keep columns they do not know.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from typeahead.llm import neardup, packing, quality, repeats, toxicity
from typeahead.llm.common import materialize, scratch, table
from typeahead.llm.tokens import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores at one half or more go."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def keep_sound(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the isolation forest go."""
    return quality.keep_sound(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return neardup.keep_one(docs, percent=80, size=5)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 35 words or more that recur are cut out; n_chars follows the text."""
    out = repeats.remove_repeats(docs, 35, layout=True)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces placed in sequences of 2048."""
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), 2048, 0)


BATCH_BYTES = 8 << 20

STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", keep_sound),
    ("minhash_near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("best_fit_packing", pack),
]

#: SQL can express neither the classifiers nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, texts going to Python in batches of at most BATCH_BYTES."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, BATCH_BYTES)
    try:
        with scratch(spark) as made:
            docs = table(spark, sf_dir, "documents")
            for k, (tag, stage) in enumerate(STAGES):
                docs = stage(spark, docs, sf_dir)
                if k < len(STAGES) - 1:
                    docs = materialize(docs, tag)
            return made.keep(docs)
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
