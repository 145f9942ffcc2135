"""Published indexes by namespace, and the facades over engine and database."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .errors import InvalidInputError, NamespaceNotFoundError, NotFoundError, unknown
from .operators import layers as L
from .operators.complete import complete, query_set
from .operators.index import Index
from .operators.layers import Layer
from .operators.retrieve import complete_aliases
from .operators.vectors import hybrid_search, vector_search
from .plans.options import HybridOptions, SearchOptions
from .storage.database import Database, check_name


class Namespace:
    """One published version of a namespace; it never changes under its holder."""

    def __init__(self, name: str, version: int, layers: dict[str, Layer]):
        self.name, self.version, self._layers = name, version, layers

    def names(self) -> list[str]:
        return sorted(self._layers)

    def get(self, index: str) -> Index:
        if index not in self._layers:
            raise NotFoundError(unknown("index", index, self._layers))
        return self._layers[index].index

    def _pick(self, names: list[str], o: SearchOptions) -> list[Layer]:
        return L.pick(self._layers, names, o.ignore_missing_layers)

    def _run(self, search, names, queries: DataFrame, o: SearchOptions | None, **more) -> DataFrame:
        o = o or SearchOptions()
        names = [names] if isinstance(names, str) else list(names)
        found = self._pick(names, o)
        if o.contexts:
            queries = queries.withColumn("contexts", F.lit(list(o.contexts)))
        if not found:
            return queries.select("qid").limit(0)
        return search(found, queries, o.limit, o.overfetch, len(names), **more)

    def complete(self, names, queries: DataFrame, options: SearchOptions | None = None) -> DataFrame:
        return self._run(L.complete_layers, names, queries, options)

    def complete_aliases(self, names, queries: DataFrame, options: SearchOptions | None = None) -> DataFrame:
        return self._run(L.aliases_layers, names, queries, options)

    def vector_search(self, names, queries: DataFrame, options: SearchOptions | None = None) -> DataFrame:
        return self._run(L.vectors_layers, names, queries, options)

    def hybrid_search(self, names, queries: DataFrame, options: SearchOptions | None = None, fusion: HybridOptions | None = None) -> DataFrame:
        return self._run(L.hybrid_layers, names, queries, options, options=fusion)


class Engine:
    """Namespaces swapped as a whole; readers keep the version they hold."""

    def __init__(self):
        self._lock, self._spaces = threading.Lock(), {}
        self.source = None  # the replica that feeds an engine of a database

    def publish(self, namespace: str, layers: dict[str, Layer]) -> int:
        check_name(namespace)
        with self._lock:
            version = self._spaces[namespace].version + 1 if namespace in self._spaces else 1
            spaces = dict(self._spaces)
            if layers:
                spaces[namespace] = Namespace(namespace, version, dict(layers))
            else:
                spaces.pop(namespace, None)
            self._spaces = spaces
        return version

    def sync(self) -> int | None:
        """Load the database's newest version now; only engines of a database can."""
        if self.source is None:
            raise InvalidInputError("only an engine of a database syncs")
        self.source.sync()
        return self.source.version or None

    @property
    def sync_status(self) -> dict | None:
        """When the last sync in the background ran and how it failed, if it did; None before the first."""
        return self.source.status if self.source else None

    def close(self) -> None:
        """End the sync in the background."""
        if self.source:
            self.source.stop()

    def namespaces(self) -> list[str]:
        return sorted(self._spaces)

    def namespace(self, name: str) -> Namespace:
        if name not in self._spaces:
            raise NamespaceNotFoundError(unknown("namespace", name, self._spaces))
        return self._spaces[name]

    def layers(self, namespace: str) -> dict[str, Layer]:
        return self._spaces[namespace]._layers if namespace in self._spaces else {}

    def version(self, namespace: str = "default") -> int:
        return self.namespace(namespace).version

    def names(self, namespace: str = "default") -> list[str]:
        return self.namespace(namespace).names()

    def get(self, index: str, namespace: str = "default") -> Index:
        return self.namespace(namespace).get(index)

    def complete(self, names, queries, options=None, namespace: str = "default") -> DataFrame:
        return self.namespace(namespace).complete(names, queries, options)

    def complete_aliases(self, names, queries, options=None, namespace: str = "default") -> DataFrame:
        return self.namespace(namespace).complete_aliases(names, queries, options)

    def vector_search(self, names, queries, options=None, namespace: str = "default") -> DataFrame:
        return self.namespace(namespace).vector_search(names, queries, options)

    def hybrid_search(self, names, queries, options=None, fusion=None, namespace: str = "default") -> DataFrame:
        return self.namespace(namespace).hybrid_search(names, queries, options, fusion)


class Collection:
    """An index of a database with the everyday operations."""

    def __init__(self, db: Database, name: str, namespace: str, optimize_every: int = 8):
        self.db, self.name, self.namespace, self.optimize_every = db, name, namespace, optimize_every

    def add(self, documents) -> int:
        v = self.db.begin(self.namespace).append(self.name, documents).commit()
        if self.optimize_every and len(self.db._entry(self.namespace, self.name)["segments"]) > self.optimize_every:
            self.optimize()
        return v

    def delete(self, ids: list[int]) -> int:
        return self.db.begin(self.namespace).append(self.name, (), ids).commit()

    def optimize(self) -> int:
        """Compact as long as there is something to gain; the steps taken."""
        n = 0
        while self.db.compact(self.name, self.namespace):
            n += 1
        return n

    def stats(self) -> dict:
        e = self.db._entry(self.namespace, self.name)
        s = e["segments"]
        return {"documents": len(self.db.open_index(self.name, self.namespace)), "segments": len(s), "rows": sum(x["documents"] for x in s), "deletes": sum(x["deletes"] for x in s), "bytes": sum(x["bytes"] for x in s), "max_score": e["max_score"]}

    def complete(self, queries: DataFrame, limit: int = 10, layers: tuple[str, ...] = (), aliases: bool = False, vectors: bool = False, overfetch: int = 2) -> DataFrame:
        """Hits over this collection and further layers; with synonyms below, or fused with vectors.

        Adds the collection that each hit came from.
        """
        stack = [self.db.layer(n, self.namespace) for n in (self.name, *layers)]
        kind = queries.schema["qid"].dataType
        if vectors:
            hits = L.hybrid_layers(stack, queries, limit, overfetch, options=HybridOptions()).select("qid", "id", "score", "kind", "rank")
        else:
            hits = L.complete_layers(stack, queries, limit, overfetch)
        if aliases:
            hits = L.with_synonyms(hits, L.aliases_layers(stack, queries, limit, overfetch), limit)
        texts = None
        for k, x in enumerate(stack):
            d = x.index.documents.select("id", "key", "text", F.struct(F.lit(k).alias("k"), F.lit(x.name).alias("collection")).alias("c"))
            texts = d if texts is None else texts.unionByName(d)
        last = texts.groupBy("id").agg(F.max_by(F.struct("key", "text", "c"), "c.k").alias("d"))
        out = hits.select(F.col("qid").cast(kind).alias("qid"), "rank", "id", "score", "kind").join(last, "id")
        return out.select("qid", "rank", "id", "d.key", "d.text", "score", "kind", "d.c.collection")


class Client:
    """Collections by name in a namespace of a database."""

    def __init__(self, db: Database, namespace: str = "default"):
        self.database, self.namespace_name = db, check_name(namespace)

    def namespace(self, name: str) -> Client:
        return Client(self.database, name)

    def sync(self) -> int | None:
        """The newest version; collections always read it."""
        return self.database.latest_version() or None

    def collections(self) -> list[str]:
        return self.database.index_names(self.namespace_name)

    def collection(self, name: str) -> Collection:
        if name not in self.collections():
            raise NotFoundError(unknown("collection", name, self.collections()))
        return Collection(self.database, name, self.namespace_name)

    __getitem__ = collection

    def create_collection(self, name: str) -> Collection:
        if name in self.collections():
            raise InvalidInputError(f"collection {name!r} exists")
        self.database.begin(self.namespace_name).set_index_metadata(name, created="yes").strict().commit()
        return Collection(self.database, name, self.namespace_name)

    def get_or_create_collection(self, name: str) -> Collection:
        return self.collection(name) if name in self.collections() else self.create_collection(name)

    def drop_collection(self, name: str) -> None:
        self.collection(name)
        self.database.begin(self.namespace_name).drop_index(name).commit()


__all__ = ["Client", "Collection", "Engine", "Namespace", "complete", "complete_aliases", "hybrid_search", "query_set", "vector_search"]
