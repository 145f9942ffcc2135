"""Layered search: later layers override earlier ones, document by document."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import LayerNotFoundError, unknown
from ..functions import text as T
from ..plans.lineage import cut, meet
from ..plans.options import HybridOptions
from .complete import query_set, ranked
from .index import Index
from .retrieve import complete_aliases
from .vectors import fuse, vector_search


@dataclass
class Layer:
    """An index and the ids it holds or deletes, which it takes from the layers before it."""

    name: str
    index: Index
    deletes: DataFrame | None = None

    @property
    def covers(self) -> DataFrame:
        ids = self.index.documents.select("id")
        return ids.unionByName(self.deletes.select("id")) if self.deletes is not None else ids


def pick(known: dict[str, Layer], names: list[str], ignore_missing: bool = False) -> list[Layer]:
    missing = [n for n in names if n not in known]
    if missing and not ignore_missing:
        raise LayerNotFoundError("; ".join(unknown("layer", n, known) for n in missing))
    return [known[n] for n in names if n in known]


def merge(layers: list[Layer], per_layer: list[DataFrame], limit: int, scaled: bool = True) -> DataFrame:
    """Merge (qid, id, score, kind, rank) hits of each layer.

    Scores are brought to the first layer's scale. A document counts as its last
    layer has it and not at all where a later layer covers it without a hit; it
    keeps the place at which it first came.
    """
    rows = None
    for k, (layer, hits) in enumerate(zip(layers, per_layer, strict=True)):
        factor = layer.index.max_score / layers[0].index.max_score if scaled and k else 1.0
        one = cut(hits).select("qid", "id", (F.col("score") * F.lit(factor)).alias("score"), "kind", F.lit(k).alias("layer"), F.struct(F.lit(k).alias("k"), F.col("rank").alias("r")).alias("pos"))
        ids = one.select("id").distinct()
        for later in layers[k + 1 :]:
            one = one.join(meet(ids, later.covers, "id").distinct().withColumn("over", F.lit(True)), "id", "left").withColumn("hidden", F.coalesce("over", F.lit(False))).drop("over")
            one = one.withColumn("was_hidden", F.col("hidden") | F.coalesce("was_hidden", F.lit(False)) if "was_hidden" in one.columns else F.col("hidden")).drop("hidden")
        one = one.withColumn("was_hidden", F.lit(False)) if "was_hidden" not in one.columns else one
        one = one.select("qid", "id", "score", "kind", "layer", "pos", "was_hidden")
        rows = one if rows is None else rows.unionByName(one)
    best = rows.groupBy("qid", "id").agg(F.max_by(F.struct("score", "kind", "layer", "was_hidden"), "layer").alias("b"), F.min("pos").alias("pos"))
    best = best.select("qid", "id", "b.*", "pos").filter("not was_hidden")
    order = Window.partitionBy("qid").orderBy(F.col("kind") == "fuzzy", F.desc("score"), "pos", T.unsigned(F.col("id")))
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).select("qid", "id", "score", "kind", "layer", "rank")


def _fetch(layers: list[Layer], listed: int | None, limit: int, overfetch: int) -> int:
    """What each layer is asked for; a listed layer that is missing counts as well."""
    return limit * overfetch if (listed or len(layers)) > 1 else limit


def complete_layers(layers: list[Layer], queries: DataFrame, limit: int = 10, overfetch: int = 2, listed: int | None = None) -> DataFrame:
    n = _fetch(layers, listed, limit, overfetch)
    return merge(layers, [ranked(x.index, query_set(queries, n)) for x in layers], limit)


def aliases_layers(layers: list[Layer], queries: DataFrame, limit: int = 10, overfetch: int = 2, listed: int | None = None) -> DataFrame:
    n = _fetch(layers, listed, limit, overfetch)
    return merge(layers, [complete_aliases(x.index, query_set(queries, n)).withColumn("kind", F.lit("synonym")) for x in layers], limit)


def vectors_layers(layers: list[Layer], queries: DataFrame, limit: int = 10, overfetch: int = 2, listed: int | None = None) -> DataFrame:
    n = _fetch(layers, listed, limit, overfetch)
    return merge(layers, [vector_search(x.index, queries, n).withColumn("kind", F.lit("semantic")) for x in layers], limit, scaled=False)


def hybrid_layers(layers: list[Layer], queries: DataFrame, limit: int = 10, overfetch: int = 2, listed: int | None = None, options: HybridOptions | None = None) -> DataFrame:
    o = options or HybridOptions()
    n = o.fetch(limit)
    kind = queries.schema["qid"].dataType
    lexical = complete_layers(layers, queries, n, overfetch, listed).withColumn("qid", F.col("qid").cast(kind))
    return fuse(lexical, vectors_layers(layers, queries, n, overfetch, listed), limit, o)


def with_synonyms(direct: DataFrame, synonyms: DataFrame, limit: int) -> DataFrame:
    """Append synonym hits that are no direct hits, scaled below the weakest of those, while there is room.

    The scale is set by the first synonym hit, be it a direct hit or not.
    """
    low = direct.groupBy("qid").agg(F.min("score").alias("low"), F.count("*").alias("have"))
    top = synonyms.groupBy("qid").agg(F.min_by("score", "rank").alias("top"))
    extra = synonyms.join(direct.select("qid", "id"), ["qid", "id"], "left_anti").join(low, "qid", "left").join(top, "qid")
    scale = F.when(F.col("low").isNull() | (F.col("top") <= 0), F.lit(1.0)).otherwise(F.least(F.lit(0.95) * F.col("low") / F.col("top"), F.lit(1.0)))
    extra = extra.select("qid", "id", (F.col("score") * scale).alias("score"), F.lit("synonym").alias("kind"), (F.coalesce("have", F.lit(0)) + F.col("rank")).alias("place"))
    rows = direct.select("qid", "id", "score", "kind", F.col("rank").alias("place")).unionByName(extra)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("place"))).filter(F.col("rank") <= limit).drop("place")
