"""Headline queries at BENCH_SF_DIR on local[BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from typeahead import queries as Q
from typeahead.operators.complete import query_set, ranked
from typeahead.operators.index import Index

HEADLINE = ("word_freq", "postings", "prefix_topk", "infix_one", "fuzzy_words", "complete_direct", "short_query", "complete_fuzzy", "vector_topk", "hybrid_rrf", "live_segments", "etl_search_terms")
TYPED = 1000


def session(cpus: str) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def main() -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def timed(name: str, run) -> None:
        start = time.perf_counter()
        run().write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)

    Q.QUERIES["point_lookup"](spark, d).collect()  # starts the session's code paths
    for name in HEADLINE:
        timed(name, lambda: Q.QUERIES[name](spark, d))
    start = time.perf_counter()
    title = F.array_join(F.slice(F.split("text", " "), 1, 6), " ")  # the baseline's corpora are titles, not texts
    ix = Index(Q.cut(Q.title_docs(spark, d).withColumn("text", title))).cache()
    ix.max_score, ix.titles.count(), ix.dictionary.count(), ix.variants.count()
    times["build_index"] = round(time.perf_counter() - start, 3)
    typed = ix.docs.orderBy(F.xxhash64("id")).limit(TYPED).selectExpr("id qid", "left(text, 4 + cast(pmod(id, 7) as int)) query")
    timed(f"complete_{TYPED}_typed", lambda: ranked(ix, query_set(typed, 10)))
    try:
        from typeahead.llm.queries import QUERIES as LLM
    except ImportError:
        LLM = {}
    for name in sorted(LLM):
        timed(name, lambda: LLM[name](spark, d))
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(d).removeprefix("sf"), "typed_queries_per_sec": round(TYPED / times[f"complete_{TYPED}_typed"], 1)}))


if __name__ == "__main__":
    main()
