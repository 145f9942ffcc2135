"""Change sets from many producers, folded into indexes exactly once, and replicas that follow."""

from __future__ import annotations

import json
import threading
import uuid

from pyspark.sql import DataFrame

from ..errors import ConflictError
from ..sources.documents import check_row
from ..storage.database import Database, Lease, check_name
from ..storage.store import Store

_sequence = iter(range(1 << 62))


class ChangeSet:
    """Upserts and deletes for any number of indexes, submitted as one file."""

    def __init__(self, namespace: str = "default"):
        self._namespace, self.changes = check_name(namespace), []

    def namespace(self, name: str) -> ChangeSet:
        other = ChangeSet(name)
        other.changes = self.changes
        return other

    def upsert(self, index: str, documents: list[dict]) -> ChangeSet:
        self.changes += [{"namespace": self._namespace, "index": check_name(index), "document": d} for d in documents]
        return self

    def delete(self, index: str, ids: list[int]) -> ChangeSet:
        self.changes += [{"namespace": self._namespace, "index": check_name(index), "delete": i} for i in ids]
        return self


def submit(db: Database, changes: ChangeSet) -> str:
    """Write a change set under a sortable name."""
    name = f"{Store.now_ms():015d}-{next(_sequence):08d}-{uuid.uuid4().hex}"
    db.store.put_if_absent(f"_inbox/{name}.json", "\n".join(json.dumps(c) for c in changes.changes).encode())
    return name


def pending(db: Database) -> list[str]:
    return sorted(k for k in db.store.list("_inbox"))


class Ingestor:
    """Applies pending change sets under a lease; ids already applied are never applied again."""

    def __init__(self, db: Database, owner: str, batch: int = 1000, lease_seconds: float = 30.0):
        self.db, self.owner, self.batch, self.seconds = db, owner, batch, lease_seconds
        self.lease: Lease | None = None

    @property
    def is_active(self) -> bool:
        return self.lease is not None

    def release(self) -> None:
        if self.lease:
            self.lease.release()
        self.lease = None

    def run_once(self) -> int:
        """Change sets applied, 0 if another ingestor is at work."""
        try:
            if self.lease:
                self.lease.renew()
            else:
                self.lease = self.db.acquire_lease("ingest", self.owner, self.seconds)
        except ConflictError:
            self.lease = None
        if not self.lease:
            return 0
        done = set(self.db.latest()["applied"])
        keys = pending(self.db)
        self.db.store.delete_many([k for k in keys if _id(k) in done])
        return self.apply([k for k in keys if _id(k) not in done][: self.batch])

    def apply(self, keys: list[str]) -> int:
        """Fold change sets in order: the last word on an id counts; then commit with claim and fence."""
        folded: dict[tuple[str, str], dict] = {}
        good = []
        for key in keys:
            raw = self.db.store.get(key)
            try:
                rows = [json.loads(x) for x in raw.decode().splitlines() if x.strip()]
                for r in rows:
                    check_name(r["namespace"]), check_name(r["index"])
                    if "document" in r:
                        check_row(r["document"], key)
            except (ValueError, KeyError, TypeError):
                self.db.store.put(f"_rejected/{key.rpartition('/')[2]}", raw)
                self.db.store.delete(key)
                continue
            good.append(key)
            for r in rows:
                last = folded.setdefault((r["namespace"], r["index"]), {})
                if "delete" in r:
                    last[r["delete"]] = None
                else:
                    last[r["document"]["id"]] = r["document"]
        if not good:
            return 0
        txn = self.db.begin()
        for (space, index), last in folded.items():
            txn.namespace(space).append(index, [d for d in last.values() if d], [i for i, d in last.items() if d is None])
        txn.claim([_id(k) for k in good])
        if self.lease:
            txn.fence("ingest", self.lease.generation)
        txn.commit()
        self.db.store.delete_many(good)
        for space, index in folded:
            while self.db.compact(index, space):
                pass
        return len(good)

    def stream(self, checkpoint: str):
        """The same as a Structured Streaming query over the inbox folder, run until it is empty.

        The lease is renewed for every batch; where it has passed on the query fails.
        """
        self.db.store.path("_inbox").mkdir(parents=True, exist_ok=True)
        if not self.lease:
            self.lease = self.db.acquire_lease("ingest", self.owner, self.seconds)
        if not self.lease:
            raise ConflictError("another ingestor holds the lease")

        def each(batch: DataFrame, _: int) -> None:
            self.lease.renew()
            names = sorted(r.file_name for r in batch.distinct().collect())  # names of one bounded batch of files
            done = set(self.db.latest()["applied"])
            self.apply([f"_inbox/{n}" for n in names if n[:-5] not in done and self.db.store.path(f"_inbox/{n}").exists()])

        source = self.db.spark.readStream.option("maxFilesPerTrigger", self.batch).format("text").load(self.db.store.uri("_inbox")).select("_metadata.file_name")
        return source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _id(key: str) -> str:
    return key.rpartition("/")[2].removesuffix(".json")


class Replica:
    """Follows a database: an engine with the indexes of the newest version it has seen."""

    def __init__(self, db: Database):
        from ..engine import Engine

        self.db, self.engine, self.version = db, Engine(), 0
        self._entries: dict[tuple[str, str], dict] = {}
        self._stop: threading.Event | None = None
        self._turn = threading.Lock()
        self.status: dict | None = None

    def sync(self) -> bool:
        """Publish what changed; True if anything did."""
        with self._turn:
            return self._sync()

    def _sync(self) -> bool:
        v = self.db.latest_version()
        if v == self.version:
            return False
        m = self.db.manifest(v)
        for space in set(self.engine.namespaces()) | set(m["namespaces"]):
            entries = m["namespaces"].get(space, {})
            have = {n: e for (s, n), e in self._entries.items() if s == space}
            if entries == have:
                continue
            old = self.engine.layers(space)
            layers = {n: old[n] if n in old and have.get(n) == e else self.db.layer(n, space, v) for n, e in entries.items()}
            self.engine.publish(space, layers)
            self._entries = {k: e for k, e in self._entries.items() if k[0] != space} | {(space, n): e for n, e in entries.items()}
        self.version = v
        return True

    def follow(self, seconds: float) -> None:
        """Sync in the background until ``stop``; a failure is kept in ``status`` and the next turn tries again."""
        self.stop()
        stop = self._stop = threading.Event()

        def loop() -> None:
            while not stop.wait(seconds):
                error = None
                try:
                    self.sync()
                except Exception as e:  # whatever it is, the thread must live on
                    error = f"{type(e).__name__}: {e}"
                self.status = {"synced_at": Store.now_ms() if error is None else (self.status or {}).get("synced_at"), "error": error}

        threading.Thread(target=loop, daemon=True).start()

    def stop(self) -> None:
        if self._stop:
            self._stop.set()


def replay(db: Database, events: DataFrame, index: str, order: str, batch: int = 500) -> int:
    """Submit a table of documents as change sets in the order of a column."""
    rows, n = [], 0
    for r in events.orderBy(order).toLocalIterator():
        rows.append({k: v for k, v in r.asDict().items() if k != order})
        if len(rows) == batch:
            submit(db, ChangeSet().upsert(index, rows))
            rows, n = [], n + 1
    if rows:
        submit(db, ChangeSet().upsert(index, rows))
        n += 1
    return n
