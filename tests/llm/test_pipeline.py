"""The pipeline stage by stage, each judged on its own input."""

import corpus_pipeline as P
from tests.llm.test_neardup import brute as near
from tests.llm.test_repeats import brute as repeats


def test_stages_and_run(spark):
    path = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, seen = docs.columns, [docs.collect()]
    for name, stage in P.STAGES:
        docs = stage(spark, docs, path)
        rows = docs.collect()
        if name != P.STAGES[-1][0]:
            assert docs.columns == columns
            docs = spark.createDataFrame(rows, docs.schema)
        seen.append(rows)
    ids = [{r.doc_id for r in s} for s in seen]
    assert ids[0] >= ids[1] >= ids[2] >= ids[3] == ids[4] == ids[5]
    want, _ = near([(r.doc_id, r.text) for r in seen[2]], 80)
    assert ids[3] == {i for i, (_, c) in want.items() if c == i}
    cut = {r.doc_id: b for r, b in zip(seen[3], repeats([r.text for r in seen[3]], 35))}
    before = {r.doc_id: r.text for r in seen[3]}
    for r in seen[4]:
        _, gone, kept = cut[r.doc_id]
        assert r.text == (kept if gone else before[r.doc_id])
        assert r.n_chars == len(r.text)
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, P.run(spark, path).collect())) == sorted(map(key, seen[5]))


def test_hard_cases(spark, hard_docs):
    docs = hard_docs.select("doc_id", "text", "lang", "source", "n_chars", "part")
    path, n = "/root/testdata/sf0.001", hard_docs.count()
    rows = docs.collect()
    for name, stage in P.STAGES:
        out = stage(spark, docs, path)
        assert stage(spark, docs.limit(0), path).count() == 0
        got = out.collect()
        if name == "toxicity":
            assert sorted(got, key=str) == sorted(rows, key=str)  # nothing toxic among them
        elif name == "quality_rules":
            assert all(len((r.text or "").split()) >= 50 for r in got)
        elif name == "minhash_near_dedup":
            by = {}
            for i, t in sorted({(r.doc_id, r.text) for r in rows}, key=str):
                by.setdefault(i, t)
            want, _ = near(list(by.items()), 80)
            assert sorted(r.doc_id for r in got) == sorted(i for i, (_, c) in want.items() if c == i)
        elif name == "substring_dedup":
            assert len(got) == n
        else:
            assert {r.doc_id for r in got} == {r.doc_id for r in rows}


def test_session_is_left_as_it_was_and_tables_are_removed(spark, monkeypatch):
    import os

    from typeahead.llm import common

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    held = lambda: set(os.listdir(common.shared_dir(spark).removeprefix("file://")))
    was = held()
    assert P.run(spark, "/root/testdata/sf0.001").count() > 0
    assert spark.conf.get(name, None) == before
    assert len(held() - was) == 1
