"""A versioned database of indexes: manifests, transactions, compaction, cleanup, leases.

A version is one JSON manifest, created only if its number is free; that is the
one point where writers meet. Segments are Parquet folders that never change.
"""

from __future__ import annotations

import copy
import json
import random
import re
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConflictError, CorruptionError, InvalidInputError, NamespaceNotFoundError, NotFoundError, unknown
from ..operators.index import Index, live_view
from ..operators.layers import Layer
from ..plans.options import BuildOptions, CleanupPolicy, CompactionPolicy, IndexOptions
from ..sources.documents import SCHEMA, from_rows
from .store import Store

BASE_LEVEL, ATTEMPTS = 255, 33
CLAIMS = 10_000  # applied ids kept in any case; older ones stay while their change set still lies in the inbox
NAME = re.compile(r"[A-Za-z0-9._-]{1,128}\Z")


def check_name(name: str) -> str:
    if not NAME.match(name):
        raise InvalidInputError(f"{name!r}: names are 1 to 128 of A-Z a-z 0-9 . _ -")
    return name


def compaction_run(levels: list[int], fanout: int) -> tuple[int, int] | None:
    """(start, end) of the lowest-level stretch of at least ``fanout`` (never under two) neighbours of one level."""
    runs, start, fanout = [], 0, max(2, fanout)
    for i in range(1, len(levels) + 1):
        if i == len(levels) or levels[i] != levels[start]:
            if i - start >= fanout and levels[start] != BASE_LEVEL:
                runs.append((levels[start], start, i))
            start = i
    return min(runs)[1:] if runs else None


@dataclass
class Op:
    kind: str
    namespace: str = ""
    index: str = ""
    data: dict = field(default_factory=dict)


class Transaction:
    """Collected operations, committed against the newest version; non-conflicting ones rebase."""

    def __init__(self, db: Database, namespace: str = "default"):
        self.db, self._namespace = db, check_name(namespace)
        self.read_version = db.latest_version()
        self.ops: list[Op] = []
        self._strict, self._retries = False, ATTEMPTS - 1

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            self.commit()

    def namespace(self, name: str) -> Transaction:
        """The same transaction, writing to another namespace."""
        other = copy.copy(self)
        other._namespace = check_name(name)
        return other

    def _op(self, kind: str, index: str = "", **data) -> Transaction:
        self.ops.append(Op(kind, self._namespace, check_name(index) if index else "", data))
        return self

    def append(self, index: str, documents=(), deletes=()) -> Transaction:
        return self._op("append", index, segment=self.db.write_segment(documents, deletes))

    def overwrite(self, index: str, documents=()) -> Transaction:
        return self._op("overwrite", index, segment=self.db.write_segment(documents, ()))

    def drop_index(self, index: str) -> Transaction:
        return self._op("drop", index)

    def set_max_score(self, index: str, value: float) -> Transaction:
        if not 0 < value < float("inf"):
            raise InvalidInputError("max_score must be positive and finite")
        return self._op("max_score", index, value=value)

    def set_index_metadata(self, index: str, **values: str) -> Transaction:
        return self._op("index_metadata", index, values=values)

    def set_metadata(self, **values: str) -> Transaction:
        return self._op("metadata", values=values)

    def fence(self, lease: str, generation: int) -> Transaction:
        return self._op("fence", lease=lease, generation=generation)

    def claim(self, ids: list[str]) -> Transaction:
        return self._op("claim", ids=ids)

    def replace(self, index: str, run: list[str], segment: dict) -> Transaction:
        return self._op("replace", index, run=run, segment=segment)

    def strict(self, on: bool = True) -> Transaction:
        self._strict = on
        return self

    def max_retries(self, n: int) -> Transaction:
        self._retries = n
        return self

    def commit(self) -> int:
        read = self.db.manifest(self.read_version)
        for attempt in range(self._retries + 1):
            now = self.db.latest()
            self._check(read, now)
            made = self._apply(now)
            made |= {"version": now["version"] + 1, "parent": now["version"], "timestamp_ms": Store.now_ms()}
            if self.db.store.put_if_absent(self.db.version_key(made["version"]), json.dumps(made, sort_keys=True).encode()):
                return made["version"]
            time.sleep(random.uniform(0, min(1.0, 0.01 * 2**attempt)))
        raise ConflictError(f"no free version after {self._retries + 1} attempts")

    def _check(self, read: dict, now: dict) -> None:
        entry = lambda m, o: m["namespaces"].get(o.namespace, {}).get(o.index)
        for o in self.ops:
            if o.index and (self._strict or o.kind == "overwrite") and entry(read, o) != entry(now, o):
                raise ConflictError(f"index {o.index!r} changed since version {read['version']}")
            if o.kind == "replace":
                held = [s["id"] for s in (entry(now, o) or {"segments": []})["segments"]]
                run = o.data["run"]
                if not any(held[i : i + len(run)] == run for i in range(len(held))):
                    raise ConflictError(f"segments of {o.index!r} are gone")
            if o.kind == "fence" and now["fences"].get(o.data["lease"], 0) > o.data["generation"]:
                raise ConflictError(f"lease {o.data['lease']!r} has passed on")
            if o.kind == "claim" and set(o.data["ids"]) & set(now["applied"]):
                raise ConflictError("change sets were already applied")

    def _apply(self, now: dict) -> dict:
        m = copy.deepcopy(now)
        for o in self.ops:
            space = m["namespaces"].setdefault(o.namespace, {}) if o.index else None
            blank = lambda: {"max_score": None, "segments": [], "metadata": {}}
            if o.kind == "append":
                e = space.setdefault(o.index, blank())
                first = not e["segments"]
                e["segments"].append({**o.data["segment"], "level": BASE_LEVEL if first else 0})
                if first and e["max_score"] is None:
                    e["max_score"] = o.data["segment"]["max_score"]
            elif o.kind == "overwrite":
                old = space.get(o.index, blank())
                space[o.index] = {"max_score": o.data["segment"]["max_score"], "segments": [{**o.data["segment"], "level": BASE_LEVEL}], "metadata": old["metadata"]}
            elif o.kind == "replace":
                segments, run = space[o.index]["segments"], o.data["run"]
                ids = [s["id"] for s in segments]
                at = next(i for i in range(len(ids)) if ids[i : i + len(run)] == run)
                segments[at : at + len(run)] = [o.data["segment"]]
            elif o.kind == "drop":
                space.pop(o.index, None)
            elif o.kind == "max_score":
                space.setdefault(o.index, blank())["max_score"] = o.data["value"]
            elif o.kind == "index_metadata":
                space.setdefault(o.index, blank())["metadata"].update(o.data["values"])
            elif o.kind == "metadata":
                m["metadata"].update(o.data["values"])
            elif o.kind == "fence":
                m["fences"][o.data["lease"]] = o.data["generation"]
            elif o.kind == "claim":
                waiting = {k.rpartition("/")[2].removesuffix(".json") for k in self.db.store.list("_inbox")}
                old = m["applied"][:-CLAIMS] if len(m["applied"]) > CLAIMS else []
                m["applied"] = [x for x in old if x in waiting] + m["applied"][len(old) :] + o.data["ids"]
        m["namespaces"] = {k: v for k, v in m["namespaces"].items() if v}
        return m


class Lease:
    """The right to work alone, one create-only file per generation."""

    def __init__(self, db: Database, name: str, owner: str, generation: int, seconds: float):
        self.db, self.name, self.owner, self.generation, self.seconds = db, name, owner, generation, seconds

    def _next(self, expires: int) -> bool:
        body = json.dumps({"owner": self.owner, "expires_ms": expires}).encode()
        return self.db.store.put_if_absent(f"_leases/{self.name}/{self.generation + 1:020d}.json", body)

    def renew(self) -> None:
        if not self._next(Store.now_ms() + int(self.seconds * 1000)):
            raise ConflictError(f"lease {self.name!r} has passed on")
        self.generation += 1

    def release(self) -> None:
        if self._next(0):
            self.generation += 1


class Database:
    """Indexes by namespace and name, over a store and a Spark session."""

    def __init__(self, spark: SparkSession, url: str, build: BuildOptions | None = None, options: IndexOptions | None = None, tags: dict[str, str] | None = None):
        self.spark, self.store = spark, Store(url, tags)
        self.build, self.options = build or BuildOptions(), options or IndexOptions()

    # versions
    @staticmethod
    def version_key(v: int) -> str:
        return f"_versions/{v:020d}.json"

    def versions(self, after: int = 0) -> list[int]:
        return [v for v in (int(k.rpartition("/")[2][:-5]) for k in self.store.list("_versions")) if v > after]

    def latest_version(self) -> int:
        return max(self.versions(), default=0)

    def manifest(self, version: int) -> dict:
        if version == 0:
            return {"version": 0, "parent": None, "timestamp_ms": 0, "namespaces": {}, "metadata": {}, "fences": {}, "applied": []}
        try:
            return json.loads(self.store.get(self.version_key(version)))
        except ValueError as e:
            raise CorruptionError(f"version {version}: {e}") from e

    def latest(self) -> dict:
        return self.manifest(self.latest_version())

    def begin(self, namespace: str = "default") -> Transaction:
        return Transaction(self, namespace)

    def namespaces(self) -> list[str]:
        return sorted(self.latest()["namespaces"])

    def index_names(self, namespace: str = "default") -> list[str]:
        return sorted(self.latest()["namespaces"].get(namespace, {}))

    # segments
    def write_segment(self, documents, deletes) -> dict:
        """Write an immutable batch; what the manifest says of it."""
        name = uuid.uuid4().hex
        docs = from_rows(self.spark, documents)
        gone = deletes if isinstance(deletes, DataFrame) else self.spark.createDataFrame([(d - (1 << 64) if d >> 63 > 0 else d,) for d in deletes], "id long")
        docs.write.parquet(self.store.uri(f"segments/{name}/documents"))
        gone.select("id").distinct().write.parquet(self.store.uri(f"segments/{name}/deletes"))
        return self._describe(name)

    def _describe(self, name: str) -> dict:
        docs, gone = self._read(name)
        span = docs.agg(F.count("*"), F.min("id"), F.max("id"), F.sum(F.xxhash64("id", "text").cast("decimal(38,0)")).cast("string")).first()
        size = sum(b for _, b, _ in self.store.list_objects(f"segments/{name}"))
        score = Index(docs, self.build, self.options).max_score if span[0] else None
        return {"id": name, "documents": span[0], "deletes": gone.count(), "bytes": size, "min_id": span[1], "max_id": span[2], "checksum": span[3], "max_score": score}

    def _read(self, name: str) -> tuple[DataFrame, DataFrame]:
        read = lambda part, schema: self.spark.read.schema(schema).parquet(self.store.uri(f"segments/{name}/{part}"))
        return read("documents", SCHEMA), read("deletes", "id long")

    def verify(self, segment: dict) -> None:
        """Compare a segment's files with its manifest entry."""
        found = self._describe(segment["id"])
        if any(found[k] != segment[k] for k in ("documents", "deletes", "checksum")):
            raise CorruptionError(f"segment {segment['id']} differs from its manifest")

    def _tables(self, segments: list[dict]) -> tuple[DataFrame, DataFrame]:
        docs = gone = None
        for seq, s in enumerate(segments):
            d, g = (x.withColumn("seq", F.lit(seq)) for x in self._read(s["id"]))
            docs, gone = (d, g) if docs is None else (docs.unionByName(d), gone.unionByName(g))
        return docs, gone

    def _entry(self, namespace: str, name: str, version: int | None = None) -> dict:
        m = self.manifest(self.latest_version() if version is None else version)
        if namespace not in m["namespaces"]:
            raise NamespaceNotFoundError(unknown("namespace", namespace, m["namespaces"]))
        if name not in m["namespaces"][namespace]:
            raise NotFoundError(unknown("index", name, m["namespaces"][namespace]))
        return m["namespaces"][namespace][name]

    def open_index(self, name: str, namespace: str = "default", version: int | None = None) -> Index:
        return self.layer(name, namespace, version).index

    def layer(self, name: str, namespace: str = "default", version: int | None = None) -> Layer:
        e = self._entry(namespace, name, version)
        options = IndexOptions(**{**self.options.__dict__, "max_score": e["max_score"]})
        if not e["segments"]:
            return Layer(name, Index(self.spark.createDataFrame([], SCHEMA), self.build, options))
        if len(e["segments"]) == 1:
            docs, gone = self._read(e["segments"][0]["id"])
            return Layer(name, Index(docs, self.build, options), gone)
        docs, gone = self._tables(e["segments"])
        return Layer(name, Index(live_view(docs, gone), self.build, options), docs.select("id").unionByName(gone.select("id")).distinct())

    # upkeep
    def compact(self, name: str, namespace: str = "default", policy: CompactionPolicy | None = None) -> bool:
        """One step: all segments into one if much is hidden or many pile up, else the lowest run of equal levels."""
        p, e = policy or CompactionPolicy(), self._entry(namespace, name)
        segments = e["segments"]
        if len(segments) < 2:
            return False
        docs, gone = self._tables(segments)
        total = sum(s["documents"] for s in segments)
        hidden = 1 - live_view(docs, gone).count() / total if total else 0
        run = compaction_run([s["level"] for s in segments], p.fanout)
        if hidden > p.max_hidden_fraction or len(segments) > p.max_segments and not run:
            run = (0, len(segments))
        if not run:
            return False
        a, b = run
        docs, gone = self._tables(segments[a:b])
        alive = live_view(docs, gone)
        keep = gone.select("id").distinct().join(alive.select("id"), "id", "left_anti") if a else gone.select("id").limit(0)
        made = self.write_segment(alive.drop("seq"), keep)
        made["level"] = BASE_LEVEL if a == 0 else min(segments[a]["level"] + 1, BASE_LEVEL - 1)
        self.begin(namespace).replace(name, [s["id"] for s in segments[a:b]], made).commit()
        return True

    def cleanup(self, policy: CleanupPolicy | None = None) -> dict[str, int]:
        """Drop old versions and the segments that only they used."""
        p, versions = policy or CleanupPolicy(), self.versions()
        before = Store.now_ms() - p.older_than_seconds * 1000
        old = [v for v in (versions[: -p.keep_versions] if p.keep_versions else versions[:-1]) if self.manifest(v)["timestamp_ms"] < before]
        used = {s["id"] for v in versions if v not in old for n in self.manifest(v)["namespaces"].values() for e in n.values() for s in e["segments"]}
        self.store.delete_many([self.version_key(v) for v in old])
        newest: dict[str, float] = {}
        size: dict[str, int] = {}
        for k, b, t in self.store.list_objects("segments"):
            name = k.split("/")[1]
            newest[name], size[name] = max(t, newest.get(name, 0)), size.get(name, 0) + b
        gone = [n for n, t in newest.items() if n not in used and t * 1000 < before]
        self.store.delete_many([f"segments/{n}" for n in gone])
        return {"versions": len(old), "segments": len(gone), "bytes": sum(size[n] for n in gone)}

    def acquire_lease(self, name: str, owner: str, seconds: float = 30.0) -> Lease | None:
        """The lease, or None while another owner holds it."""
        keys = self.store.list(f"_leases/{check_name(name)}")
        generation = 0
        if keys:
            last = json.loads(self.store.get(keys[-1]))
            generation = int(keys[-1].rpartition("/")[2][:-5])
            if last["expires_ms"] > Store.now_ms() and last["owner"] != owner:
                return None
        lease = Lease(self, name, owner, generation, seconds)
        try:
            lease.renew()
        except ConflictError:
            return None
        return lease

    def namespace(self, name: str = "default"):
        """The indexes of a namespace as of now; they never change under their holder."""
        from ..engine import Namespace

        m = self.latest()
        if name not in m["namespaces"]:
            raise NamespaceNotFoundError(unknown("namespace", name, m["namespaces"]))
        return Namespace(name, m["version"], {n: self.layer(n, name, m["version"]) for n in m["namespaces"][name]})

    def engine(self, sync_every: float | None = None):
        """An engine that holds the newest version, and follows later ones every so many seconds."""
        from ..streaming.inbox import Replica

        replica = Replica(self)
        replica.engine.source = replica
        replica.sync()
        if sync_every:
            replica.follow(sync_every)
        return replica.engine

    def submit(self, changes) -> str:
        """Put a change set in the inbox; its id."""
        from ..streaming.inbox import submit

        return submit(self, changes)

    def pending_change_sets(self) -> int:
        """How many change sets wait in the inbox."""
        from ..streaming.inbox import pending

        return len(pending(self))


def connect(spark: SparkSession, url: str, **options) -> Database:
    return Database(spark, url, **options)
