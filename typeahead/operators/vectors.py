"""Nearest vectors of a query set, and fusion with lexical hits."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidInputError
from ..functions import text as T
from ..plans.options import HybridOptions
from .index import Index

BLOCK, STEP = 16_384, 1024


def vector_search(ix: Index, queries: DataFrame, limit: int = 10) -> DataFrame:
    """(qid, id, score, rank) by exact inner product for queries(qid, vector[, contexts]).

    Queries and vectors are dealt into blocks of about BLOCK rows; each task
    compares one block of either, gives at most ``limit`` rows a query, and a
    window merges them. Nothing of either side passes through the driver but
    their counts.
    """
    dim = ix.vector_dim
    kind = dict(queries.dtypes)["qid"]
    schema = f"qid {kind}, id long, score double"
    if dim is None:
        return queries.sparkSession.createDataFrame([], schema).withColumn("rank", F.lit(0))
    wanted = F.coalesce(F.col("contexts"), F.array()) if "contexts" in queries.columns else F.array()
    asked = queries.select("qid", F.col("vector").cast("array<double>").alias("vector"), wanted.cast("array<string>").alias("contexts"))
    sound = F.expr(f"size(vector) = {dim} and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))")
    n, bad = asked.agg(F.count("*"), F.count_if(~F.coalesce(sound, F.lit(False)))).first()
    if bad:
        raise InvalidInputError(f"query vectors must have {dim} finite numbers")
    parts = queries.sparkSession.sparkContext.defaultParallelism
    q_blocks = max(1, -(-n // BLOCK))
    v_blocks = max(-(-ix.vectors.count() // BLOCK), min(parts, 64) if q_blocks == 1 else 1)
    block = lambda c, many: F.pmod(F.xxhash64(c), F.lit(many)).cast("int")
    each = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)))
    left = asked.withColumn("qb", block("qid", q_blocks)).withColumn("vb", each(v_blocks))
    right = ix.vectors.withColumn("vb", block("id", v_blocks)).withColumn("qb", each(q_blocks))
    found = left.groupBy("qb", "vb").cogroup(right.groupBy("qb", "vb")).applyInArrow(_compare(limit), schema)
    order = Window.partitionBy("qid").orderBy(F.desc("score"), T.unsigned(F.col("id")))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def _compare(limit: int):
    """The nearest vectors of a block for each query of a block, STEP queries at a time."""
    def matrix(side: pa.Table) -> np.ndarray:
        return side.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(side.num_rows, -1)

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        asked_at, ids, scores = [], [], []
        if asked.num_rows and held.num_rows:
            m, x, id_ = matrix(asked), matrix(held), held.column("id").to_numpy()
            wanted, tags = asked.column("contexts").to_pylist(), None
            by_id = np.argsort(id_.view(np.uint64), kind="stable")
            x, id_ = x[by_id], id_[by_id]
            for at in range(0, len(m), STEP):
                for k, row in enumerate(m[at : at + STEP] @ x.T, at):
                    if wanted[k]:
                        tags = tags or [set(held.column("contexts")[i].as_py() or ()) for i in by_id.tolist()]
                        row = np.where([not t.isdisjoint(wanted[k]) for t in tags], row, -np.inf)
                    best = _best(row, limit)
                    asked_at.append(np.full(len(best), k))
                    ids.append(id_[best])
                    scores.append(row[best])
        flat = lambda parts, dtype: np.concatenate(parts) if parts else np.zeros(0, dtype)
        qid = asked.column("qid").take(pa.array(flat(asked_at, np.int64)))
        return pa.table([qid, pa.array(flat(ids, np.int64)), pa.array(flat(scores, np.float64))], names=["qid", "id", "score"])

    return run


def _best(row: np.ndarray, limit: int) -> np.ndarray:
    """Places of the largest finite values, equal ones in their order."""
    if limit < len(row):
        near = np.flatnonzero(row >= np.partition(row, -limit)[-limit]) if limit > 0 else np.zeros(0, np.int64)
    else:
        near = np.arange(len(row))
    best = near[np.argsort(-row[near], kind="stable")][:limit]
    return best[np.isfinite(row[best])]


def fuse(lexical: DataFrame, semantic: DataFrame, limit: int, options: HybridOptions | None = None) -> DataFrame:
    """Full outer fusion of (qid, id, score, rank[, kind]) hits by id; equal scores go by unsigned id."""
    o = options or HybridOptions()
    lex = lexical.select("qid", "id", F.col("score").alias("lexical_score"), F.col("rank").alias("l"), "kind")
    sem = semantic.select("qid", "id", F.col("score").alias("semantic_score"), F.col("rank").alias("s"))
    both = lex.join(sem, ["qid", "id"], "full_outer")
    part = lambda c, k: F.coalesce(F.lit(1.0) / (F.lit(k) + F.col(c)), F.lit(0.0))
    score = {
        "rrf": part("l", o.k) + part("s", o.k),
        "weighted": F.lit(1.0 - o.weight) * F.coalesce("lexical_score", F.lit(0.0)) + F.lit(o.weight) * F.greatest(F.coalesce("semantic_score", F.lit(0.0)), F.lit(0.0)),
        "lexical_first": F.when(F.col("l").isNotNull(), F.lit(2.0) + F.lit(1.0) / F.col("l")).otherwise(F.lit(1.0) / F.col("s")),
    }[o.fusion]
    order = Window.partitionBy("qid").orderBy(F.desc("score"), T.unsigned(F.col("id")))
    out = both.withColumn("score", score).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    return out.select("qid", "id", "score", F.coalesce("kind", F.lit("semantic")).alias("kind"), "lexical_score", "semantic_score", "rank")


def hybrid_search(ix: Index, queries: DataFrame, limit: int = 10, options: HybridOptions | None = None) -> DataFrame:
    """Lexical and vector hits of queries(qid, query, vector[, contexts]), fused."""
    from .complete import query_set, ranked

    o = options or HybridOptions()
    n, kind = o.fetch(limit), queries.schema["qid"].dataType
    lexical = ranked(ix, query_set(queries, n)).withColumn("qid", F.col("qid").cast(kind))
    return fuse(lexical, vector_search(ix, queries, n), limit, o)
