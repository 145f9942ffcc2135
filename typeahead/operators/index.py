"""An index: live documents and the lookup tables derived from them."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidInputError
from ..functions import text as T
from ..plans.options import BuildOptions, IndexOptions
from ..sources.documents import last_wins

NO_SCORE = 750.0


def exact_raw(weight: Column, length: Column, single: Column, factor: float) -> Column:
    """The score of an exact hit before it is normalised."""
    base = F.lit(150.0) - F.lit(0.1) * length + F.when(single, 25.0).otherwise(0.0)
    return base * (F.lit(1.0) + F.greatest(weight, F.lit(0.0).cast("float")).cast("double") * F.lit(factor))


def kth_smallest(df: DataFrame, column: str, k: int, keep: int = 100_000) -> float:
    """The element at place k of the ascending order, by narrowing a histogram; nothing is sorted whole."""
    rows = df.select(F.col(column).alias("x")).filter(F.col("x").isNotNull())
    while True:
        n, low, high = rows.agg(F.count("x"), F.min("x"), F.max("x")).first()
        if n <= keep or low == high:
            return low if low == high else sorted(r.x for r in rows.collect())[k]
        width = (high - low) / 4096
        bins = rows.groupBy(F.least(F.floor((F.col("x") - low) / width), F.lit(4095)).alias("b")).count().collect()
        for b, count in sorted(bins):
            if k < count:
                break
            k -= count
        rows = rows.filter(F.least(F.floor((F.col("x") - low) / width), F.lit(4095)) == b)


def score_of_scale(docs: DataFrame, factor: float) -> float:
    """The 99th of a hundred exact scores, to which all scores are relative."""
    scores = docs.select(exact_raw(F.col("w"), F.col("len"), F.col("single"), factor).alias("x")).filter("not isnan(x)")
    n = scores.count()
    return kth_smallest(scores, "x", n * 99 // 100) if n else NO_SCORE


def live_view(segments: DataFrame, deletes: DataFrame) -> DataFrame:
    """Of rows tagged with ``seq``: the newest copy of each id, without those that a later segment deletes.

    A delete hides older segments' copies only.
    """
    names = [c for c in segments.columns if c != "seq"]
    newest = segments.groupBy("id").agg(F.max_by(F.struct(*names), "seq").alias("d"), F.max("seq").alias("seq"))
    gone = deletes.groupBy("id").agg(F.max("seq").alias("gone"))
    return newest.join(gone, "id", "left").filter("gone is null or gone <= seq").select("d.*")


class Index:
    """Lookup tables over one row per live document; all are lazy and distributed."""

    def __init__(self, documents: DataFrame, build: BuildOptions | None = None, options: IndexOptions | None = None):
        self.documents = documents
        self.build, self.options = build or BuildOptions(), options or IndexOptions()

    @classmethod
    def from_documents(cls, documents: DataFrame, build: BuildOptions | None = None, options: IndexOptions | None = None) -> Index:
        """An index of documents of any source; of rows with one id the last is kept."""
        return cls(last_wins(documents), build, options)

    def cache(self) -> Index:
        """Keep the tables that every query set reads."""
        for name in ("docs", "postings", "freq", "aliases", "titles", "dictionary", "variants"):
            self.__dict__[name] = getattr(self, name).persist()
        return self

    def stored(self) -> Index:
        """Write the tables that searches read, once, so that no pass derives them again."""
        if "_stored" not in self.__dict__ and "titles" not in self.__dict__:
            from concurrent.futures import ThreadPoolExecutor

            from ..plans.lineage import cut

            with ThreadPoolExecutor(4) as pool:
                for names in (("docs", "postings", "aliases", "freq"), ("titles", "dictionary", "variants")):  # the second are made of the first
                    made = [(n, getattr(self, n)) for n in names]
                    self.__dict__.update(zip(names, pool.map(cut, [t for _, t in made])))
            self.__dict__["_stored"] = True
        return self

    def unpersist(self) -> None:
        for name in ("docs", "postings", "freq", "aliases", "titles", "dictionary", "variants"):
            if name in self.__dict__:
                self.__dict__[name].unpersist()

    @property
    def factor(self) -> float:
        return self.options.popularity_weight * 10.0

    @cached_property
    def docs(self) -> DataFrame:
        title = T.lower(F.col("text"))
        return self.documents.select(
            "id",
            "key",
            "text",
            T.unsigned(F.col("id")).alias("uid"),
            F.col("popularity").cast("float").alias("w"),
            title.alias("title"),
            F.least(F.length(title), F.lit(65535)).alias("len"),
            (F.size(T.words(title)) == 1).alias("single"),
            "contexts",
        )

    @cached_property
    def _occurrences(self) -> DataFrame:
        return self.docs.select("id", F.explode(T.indexed_words(F.col("title"), self.build.min_word_chars)).alias("word"))

    @cached_property
    def postings(self) -> DataFrame:
        return self._occurrences.distinct()

    @property
    def entries(self) -> DataFrame:
        """(id, word) for joins that leave few: the postings where they are kept, else occurrences, repeats in a text dropped."""
        if "postings" in self.__dict__:
            return self.postings.select("id", "word")
        return self.docs.select("id", F.explode(F.array_distinct(T.indexed_words(F.col("title"), self.build.min_word_chars))).alias("word"))

    @cached_property
    def freq(self) -> DataFrame:
        return self._occurrences.groupBy("word").agg(F.count("*").alias("n"))

    @cached_property
    def dictionary(self) -> DataFrame:
        """(rung, pre, word, n): the words under each of their prefix rungs."""
        return self.freq.select("word", "n", F.explode(T.rungs(F.col("word"))).alias("r")).select("r.rung", "r.pre", "word", "n")

    @cached_property
    def titles(self) -> DataFrame:
        """(rung, pre, id, ...): the titles under each of their prefix rungs."""
        return self.docs.select("id", "uid", "w", "title", "contexts", F.explode(T.rungs(F.col("title"))).alias("r")).select("r.rung", "r.pre", "id", "uid", "w", "title", "contexts")

    @cached_property
    def variants(self) -> DataFrame:
        """(variant, head): deletions of the words' heads."""
        b = self.build
        heads = self.freq.select(F.substring("word", 1, b.fuzzy_prefix_chars).alias("head")).distinct()
        return heads.select(F.explode(T.delete_variants(F.col("head"), b.max_edit_distance, b.fuzzy_prefix_chars)).alias("variant"), "head")

    @cached_property
    def aliases(self) -> DataFrame:
        kinds = [self.documents.select("id", F.explode(c).alias("alias"), F.lit(k).alias("kind")) for k, c in enumerate(("synonyms", "abbreviations"))]
        return kinds[0].unionByName(kinds[1]).select(T.lower(F.col("alias")).alias("alias"), "kind", "id").filter("alias <> ''").distinct()

    @cached_property
    def vectors(self) -> DataFrame:
        return self.documents.filter("vector is not null").select("id", "vector", "contexts")

    @cached_property
    def max_score(self) -> float:
        found = self.options.max_score or score_of_scale(self.docs, self.factor)
        if not 0 < found < float("inf"):
            raise InvalidInputError("the maximum score must be positive and finite; texts are too long for titles")
        return found

    @cached_property
    def count(self) -> int:
        return self.documents.count()

    def __len__(self) -> int:
        return self.count

    @cached_property
    def vector_dim(self) -> int | None:
        dims = [r[0] for r in self.vectors.select(F.size("vector")).distinct().limit(2).collect()]
        if len(dims) > 1 or dims and (dims[0] <= 0 or dims[0] % 8):
            raise InvalidInputError("vectors must share one dimension, a positive multiple of 8")
        return dims[0] if dims else None

    def document(self, id: int) -> DataFrame:
        return self.documents.filter(F.col("id") == (id - (1 << 64) if id >> 63 > 0 else id))

    def document_by_key(self, key: str) -> DataFrame:
        from ..functions.edits import key_id

        return self.document(key_id(key)).filter(F.col("key") == key)

    def compact(self) -> Index:
        """The live documents as one written segment."""
        from ..plans.lineage import cut

        return Index(cut(self.documents), self.build, self.options)

    # searches over a DataFrame of queries(qid, query[, contexts][, limit]) or (qid, vector[, contexts])
    def complete(self, queries: DataFrame, limit: int = 10, marks: bool = True) -> DataFrame:
        from .complete import complete

        return complete(self, queries, limit, marks)

    def complete_aliases(self, queries: DataFrame, limit: int = 10) -> DataFrame:
        from .complete import query_set
        from .retrieve import complete_aliases

        return complete_aliases(self, query_set(queries, limit))

    def vector_search(self, queries: DataFrame, limit: int = 10) -> DataFrame:
        from .vectors import vector_search

        return vector_search(self, queries, limit)

    def hybrid_search(self, queries: DataFrame, limit: int = 10, options=None) -> DataFrame:
        from .vectors import hybrid_search

        return hybrid_search(self, queries, limit, options)
