"""Versions, conflicts, compaction, cleanup, leases, change sets, replicas, facades."""

import asyncio
import io
import time

import pytest

from typeahead import aio, cli
from typeahead.engine import Client, Engine
from typeahead.errors import ConflictError, InvalidInputError, NotFoundError
from typeahead.plans.options import CleanupPolicy, CompactionPolicy
from typeahead.storage import database
from typeahead.storage.database import Database, compaction_run, connect
from typeahead.streaming.inbox import ChangeSet, Ingestor, Replica, pending, submit


def rows(a, b, tag="item"):
    return [{"id": i, "text": f"{tag} {i}", "popularity": i % 10 / 10} for i in range(a, b)]


@pytest.fixture
def db(spark, tmp_path):
    return Database(spark, str(tmp_path / "db"))


def texts(ix):
    return {r.id: r.text for r in ix.documents.collect()}


def test_commits_rebase_and_conflict(db):
    db.begin().append("a", rows(0, 5)).commit()
    one, two = db.begin(), db.begin()
    one.append("a", rows(5, 8)).commit()
    two.append("a", rows(3, 4, "new"), [0]).commit()
    assert db.versions() == [1, 2, 3]
    assert texts(db.open_index("a")) == {**{i: f"item {i}" for i in (1, 2, 4, 5, 6, 7)}, 3: "new 3"}
    assert len(texts(db.open_index("a", version=1))) == 5
    late = db.begin()
    db.begin().append("a", rows(9, 10)).commit()
    with pytest.raises(ConflictError):
        late.overwrite("a", rows(0, 1)).commit()
    with pytest.raises(InvalidInputError):
        db.begin().append("no/slash", [])
    with pytest.raises(NotFoundError, match="did you mean"):
        db.open_index("aa")
    segment = db._entry("default", "a")["segments"][0]
    db.verify(segment)


def test_compaction_keeps_results_and_cleanup_drops_files(db):
    for k in range(5):
        db.begin().append("a", rows(k * 2, k * 2 + 3, f"v{k}"), [0] if k == 3 else []).commit()
    before = texts(db.open_index("a"))
    while db.compact("a", policy=CompactionPolicy(fanout=2)):
        pass
    assert texts(db.open_index("a")) == before
    assert len(db._entry("default", "a")["segments"]) == 1
    got = db.cleanup(CleanupPolicy(1, 0))
    assert got["versions"] > 3
    assert got["segments"] >= 5
    assert texts(db.open_index("a")) == before


def test_run_choice():
    assert compaction_run([255, 0, 0, 0, 0], 4) == (1, 5)
    assert compaction_run([255, 1, 1, 0], 2) == (1, 3)
    assert compaction_run([255, 0, 0], 4) is None


def test_leases(db):
    a = db.acquire_lease("x", "a", 0.2)
    assert (a.generation, db.acquire_lease("x", "b")) == (1, None)
    time.sleep(0.3)
    b = db.acquire_lease("x", "b")
    assert b.generation == 2
    with pytest.raises(ConflictError):
        a.renew()
    b.release()
    assert db.acquire_lease("x", "a").generation == 4


def test_change_sets_apply_once(db, tmp_path):
    submit(db, ChangeSet().upsert("a", rows(0, 4)).namespace("t").upsert("b", rows(0, 1)))
    submit(db, ChangeSet().upsert("a", rows(2, 3, "new")).delete("a", [0]))
    db.store.put("_inbox/zzz.json", b"not json")
    first, second = Ingestor(db, "one"), Ingestor(db, "two")
    assert first.run_once() == 2
    assert second.run_once() == 0
    assert texts(db.open_index("a")) == {1: "item 1", 2: "new 2", 3: "item 3"}
    assert db.index_names("t") == ["b"]
    assert db.store.list("_rejected") == ["_rejected/zzz.json"]
    version = db.latest_version()
    assert first.run_once() == 0
    assert db.latest_version() == version
    submit(db, ChangeSet().upsert("a", rows(7, 8)))
    first.stream(str(tmp_path / "ck")).awaitTermination(60)
    assert 7 in texts(db.open_index("a"))
    assert pending(db) == []


def test_replica_pins_versions(db):
    db.begin().append("a", rows(0, 2)).commit()
    replica = Replica(db)
    assert replica.sync()
    held = replica.engine.namespace("default")
    db.begin().append("a", rows(2, 3)).append("b", rows(0, 1)).commit()
    assert not replica.engine.names() == ["a", "b"]
    assert replica.sync()
    assert not replica.sync()
    assert (len(held.get("a")), len(replica.engine.get("a")), replica.engine.names(), replica.engine.version()) == (2, 3, ["a", "b"], 2)


def test_collections_async_and_command_line(spark, db, tmp_path):
    c = Client(db).create_collection("songs")
    c.add([{"id": 1, "text": "Dancing Queen", "popularity": 0.9, "synonyms": ["abba hit"]}, {"id": 2, "text": "Dark Horse"}])
    c.delete([2])
    assert c.stats()["documents"] == 1
    assert Client(db).collections() == ["songs"]
    got = c.complete(spark.createDataFrame([(1, "danc"), (2, "abba h")], "qid long, query string"), aliases=True).collect()
    assert {(r.qid, r.id, r.kind, r.collection) for r in got} == {(1, 1, "prefix", "songs"), (2, 1, "synonym", "songs")}
    assert asyncio.run(aio.AsyncDatabase(db).latest_version()) == db.latest_version()
    f, out = tmp_path / "d.jsonl", io.StringIO()
    f.write_text('{"id": 5, "text": "Road trip"}\n')
    url = str(tmp_path / "db")
    for args in (["import", url, "songs", str(f)], ["inspect", url], ["complete", url, "songs", "road"], ["compact", url, "songs"], ["cleanup", url], ["ingest", url, "--once"]):
        assert cli.main(args, spark, out) == 0
    assert "Road trip" in out.getvalue()
    Client(db).drop_collection("songs")
    assert Client(db).collections() == []


def test_change_sets_wait_in_the_inbox(spark, tmp_path):
    db = connect(spark, str(tmp_path / "db"))
    db.submit(ChangeSet().upsert("songs", [{"id": 1, "text": "a"}]))
    assert db.pending_change_sets() == 1
    one, two = Ingestor(db, "one"), Ingestor(db, "two")
    one.stream(str(tmp_path / "check")).awaitTermination()
    assert db.pending_change_sets() == 0
    assert [r.id for r in db.open_index("songs").documents.collect()] == [1]
    with pytest.raises(ConflictError, match="holds the lease"):
        two.stream(str(tmp_path / "other"))


def test_claims_last_while_their_change_set_lies_in_the_inbox(db, monkeypatch):
    """A change set whose file could not be deleted is not applied again, however many came after it."""
    monkeypatch.setattr(database, "CLAIMS", 2)
    lingers = submit(db, ChangeSet().upsert("a", rows(0, 1)))
    body = db.store.get(f"_inbox/{lingers}.json")
    worker = Ingestor(db, "one")
    assert worker.run_once() == 1
    db.store.put(f"_inbox/{lingers}.json", body)
    for k in range(5):
        db.begin().claim([f"other-{k}"]).commit()
    assert db.latest()["applied"] == [lingers, "other-2", "other-3", "other-4"]
    version = db.latest_version()
    assert worker.run_once() == 0
    assert (db.latest_version(), pending(db)) == (version, [])


def test_engine_of_a_database_follows_and_reports(db, monkeypatch):
    db.begin().append("a", rows(0, 2)).commit()
    held = db.namespace()
    engine = db.engine()
    assert (engine.names(), engine.sync_status, engine.sync()) == (["a"], None, 1)
    db.begin().append("b", rows(0, 1)).commit()
    assert (engine.names(), engine.sync(), engine.names(), held.names()) == (["a"], 2, ["a", "b"], ["a"])
    with pytest.raises(InvalidInputError):
        Engine().sync()
    with pytest.raises(NotFoundError):
        db.namespace("none")

    def until(done):
        end = time.time() + 20
        while not done(engine.sync_status or {}) and time.time() < end:
            time.sleep(0.05)
        return done(engine.sync_status or {})

    with monkeypatch.context() as broken:
        broken.setattr(Database, "latest_version", lambda self: 1 // 0)
        engine.source.follow(0.05)
        assert until(lambda s: "ZeroDivisionError" in (s.get("error") or ""))
    assert until(lambda s: s.get("synced_at") and s["error"] is None)
    db.begin().append("c", rows(0, 1)).commit()
    assert until(lambda s: engine.names() == ["a", "b", "c"])
    engine.close()


def test_a_collection_fuses_with_vectors(spark, db):
    c = Client(db).create_collection("songs")
    pad = lambda *v: [float(x) for x in v] + [0.0] * (8 - len(v))
    c.add([{"id": 1, "text": "Dancing Queen", "vector": pad(1)}, {"id": 2, "text": "Purple Rain", "vector": pad(0, 1)}])
    asked = spark.createDataFrame([(7, "danc", pad(0, 1))], "qid long, query string, vector array<double>")
    got = {(r.qid, r.id, r.kind) for r in c.complete(asked, vectors=True).collect()}
    assert got == {(7, 1, "prefix"), (7, 2, "semantic")}
