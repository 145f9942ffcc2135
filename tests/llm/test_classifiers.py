"""Toxicity, language and quality by held-out labels and brute-force counts."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa

from typeahead.llm import langid, quality, toxicity
from typeahead.llm.queries import QUERIES

PATH = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def labelled(spark, n=400):
    """Toxic if an insult and a group are named together: neither alone tells."""
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        w = [f"word{rng.randrange(300)}" for _ in range(40)]
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        for hit, k in ((insult, "stoopid"), (group, "martians")):
            if hit:
                w[rng.randrange(40)] = k
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(insult and group)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_machine_learns_pairs(spark):
    docs, labels = labelled(spark)
    machine = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, machine).collect()}
    want = {r.doc_id: r.toxic for r in labels.collect()}
    right = [got[i].predicted == y for i, y in want.items() if held(i)]
    assert sum(right) / len(right) > 0.9
    kept = {r.doc_id for r in toxicity.drop_toxic(docs.withColumn("score", docs.doc_id), machine).collect()}
    assert kept == {i for i, r in got.items() if not r.predicted}


def test_op4_held_out(spark):
    path = "/root/testdata/sf0.1"  # the smaller tables have six toxic rows held out, and few to learn from
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{path}/labels.parquet").collect()}
    rows = QUERIES["op4_toxicity"](spark, path).collect()
    assert len(rows) == spark.read.parquet(f"{path}/documents.parquet").count()
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    tested = [r for r in rows if r.held_out and r.doc_id in labels]
    toxic, found = [r for r in tested if labels[r.doc_id] == 1], [r for r in tested if r.predicted]
    assert len(toxic) >= 20
    assert sum(r.predicted for r in toxic) / len(toxic) >= 0.8  # recall
    assert sum(labels[r.doc_id] for r in found) / len(found) >= 0.8  # precision


def test_margins_equal_the_sum_over_pairs():
    """Scores against the machine's formula, pair by pair."""
    rng = np.random.default_rng(0)
    m = toxicity.Machine(np.arange(6), 0.3, rng.normal(size=6), rng.normal(size=(6, 3)))
    held = [[0, 2, 5], [], [1], [0, 1, 2, 3, 4, 5]]
    row, f = np.repeat(np.arange(4), [len(x) for x in held]), np.array([i for x in held for i in x])
    want = [0.3 + sum(m.weight[x]) + sum(m.factor[a] @ m.factor[b] for k, a in enumerate(x) for b in x[k + 1 :]) for x in held]
    assert np.allclose(m.margin(row, f, 4), want)


def test_nearest_centroid_by_brute_force():
    """Predictions against a loop over all centroids."""
    rng = np.random.default_rng(1)
    counts = rng.poisson(0.3, (60, langid.DIM)).astype(np.float32)
    counts[:30, :200] += 3
    model = langid.train(counts, ["aa"] * 30 + ["bb"] * 30)
    who, score, _ = model.predict(counts)
    for c, w, s in zip(counts, who, score):
        x = np.log1p(c) * model.idf
        sims = [(float(x @ y / np.linalg.norm(x)), int(k)) for y, k in zip(model.centre, model.language)]
        assert w == max(sims)[1] and 0 <= s <= 1


def test_paths_by_a_walk_of_each_tree():
    """Mean path lengths against a walk row by row."""
    x = np.random.default_rng(2).normal(size=(80, 4))
    forest = quality.Forest.grow(x)
    for row, got in zip(x[:15], forest.path(x[:15])):
        total = 0.0
        for node in forest.roots():
            while forest.feature[node] >= 0:
                node = forest.left[node] + (row[forest.feature[node]] >= forest.split[node])
            total += forest.depth[node]
        assert abs(total / quality.TREES - got) < 1e-9


def test_op5_held_out(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{PATH}/documents.parquet").collect()}
    rows = QUERIES["op5_language_id"](spark, PATH).collect()
    assert len(rows) == len(lang)
    tested = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in tested) / len(tested) > 0.97
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in rows)


def test_gram_counts():
    texts = ["abcabc", "", None, "AB", "ab\ncd", "É"]
    counts, has = langid.gram_counts(pa.record_batch([pa.array(texts)], names=["text"]))
    assert counts.sum(1).tolist() == [max(0, len((t or "").encode()) - 2) for t in texts]
    assert counts[0].max() == 2
    assert has.tolist() == [True, False, False, True, True, True]


def brute_counts(t):
    t = t or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    return [len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(often)]


def test_op8_counts_and_verdicts(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{PATH}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{PATH}/labels.parquet").collect()}
    rows = QUERIES["op8_quality_rules"](spark, PATH).collect()
    assert len(rows) == len(docs)
    for r in rows:
        if len(docs[r.doc_id]) < 6000:
            base = [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words]
            assert base == brute_counts(docs[r.doc_id])
            assert r.base_failed == (base[0] < 50 or 100 * base[4] > 50 * base[0])
            assert not (r.base_failed and r.kept)
    judged = [r for r in rows if r.doc_id in labels and not r.base_failed]
    assert sum(r.kept for r in judged if labels[r.doc_id] == 1) >= 0.98 * sum(labels[r.doc_id] == 1 for r in judged)
    assert sum(not r.kept for r in judged if labels[r.doc_id] == 0) >= 0.9 * sum(labels[r.doc_id] == 0 for r in judged)


def test_counts_of_hard_texts(hard_texts):
    short = [t for t in hard_texts if len(t or "") < 5000] + ["a\na\n\na b\r\na b\r\n", "x x x x", "p q r s p q r"]
    base, rules = quality.statistics(pa.record_batch([pa.array(short, pa.string())], names=["text"]))
    assert base.tolist() == [brute_counts(t) for t in short]
    assert np.isfinite(rules).all()


def test_forest_isolates_outliers():
    x = np.random.default_rng(1).normal(size=(500, 3))
    forest = quality.Forest.grow(x)
    far = forest.path(np.array([[9.0, 0, 0], [0, -9, 9]]))
    assert far.max() < np.quantile(forest.path(x), 0.05)


def test_forest_counts_every_labelled_row(spark):
    """Unsound rows that come after 20,000 others by hash, or whose id is in the fold of op4 and op5, set the threshold too."""
    words = "concat_ws(' ', transform(sequence(1, 60), k -> concat('w', k, 'x', doc_id % 11, if({bad}, '##', ''))))"
    for n, bad in ((2_000, "crc32(cast(doc_id as string)) % 5 = 0 and doc_id < 200"), (26_000, "rank > 21500")):
        rows = spark.range(n).withColumnRenamed("id", "doc_id").selectExpr("doc_id", "row_number() over (order by crc32(cast(doc_id as string)) % 5 = 0, xxhash64(doc_id)) rank")
        rows = rows.selectExpr("doc_id", f"int({bad}) bad").selectExpr("doc_id", words.format(bad="bad = 1") + " text", "1 - bad quality").cache()
        forest = quality.fit(rows.select("doc_id", "text"), rows.select("doc_id", "quality"))
        judged = quality.judge(rows, forest).join(rows.select("doc_id", "quality"), "doc_id")
        kept = {(r.quality, r.kept): r["count"] for r in judged.groupBy("quality", "kept").count().collect()}
        assert kept.keys() == {(1, True), (0, False)} and sum(kept.values()) == n


def test_threshold_by_brute_force(spark):
    """The cut of most gain against a loop over all cuts between different paths, with ties and repeated rows."""
    rng = np.random.default_rng(5)
    for size, digits in ((4000, 3), (4000, 12), (3000, 0), (900, 1)):
        good = rng.random(size) < 0.8
        path = np.round(np.where(good, rng.normal(9, 0.7, size), rng.normal(7, 1, size)), digits)
        n = rng.integers(1, 4, size)
        best, want = 0, -np.inf
        steps = np.unique(path)
        for low, high in zip(steps, steps[1:]):
            lost, caught = n[good & (path <= low)].sum(), n[~good & (path <= low)].sum()
            if lost <= quality.MAX_WRONG * n[good].sum() and caught - lost > best:
                best, want = caught - lost, (low + high) / 2
        rows = spark.createDataFrame(zip(path.tolist(), good.tolist(), n.tolist()), "path double, good boolean, n long")
        assert quality.calibrate(rows) == want
    assert quality.calibrate(rows.filter("good")) == quality.calibrate(rows.filter("not good")) == quality.calibrate(rows.limit(0)) == -np.inf


def test_hard_cases(spark, hard_docs):
    docs, labels = labelled(spark, 60)
    n, none = hard_docs.count(), labels.limit(0)
    for machine in (toxicity.fit(docs, labels), toxicity.fit(docs, none), toxicity.fit(docs.limit(0), labels)):
        assert toxicity.score(hard_docs, machine).count() == n
        assert toxicity.drop_toxic(hard_docs, machine).columns == hard_docs.columns
    for forest in (quality.fit(docs, labels), quality.fit(docs, none)):
        assert quality.judge(hard_docs, forest).count() == n
        assert quality.keep_sound(hard_docs, forest).columns == hard_docs.columns
    model = langid.fit(hard_docs)
    rows = langid.identify(hard_docs, model).collect()
    assert len(rows) == n
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in (t or ""))) for r, t in zip(sorted(rows, key=lambda r: r.doc_id), [x.text for x in sorted(hard_docs.collect(), key=lambda r: r.doc_id)]))
    assert {r.lang_pred for r in langid.identify(hard_docs, langid.fit(hard_docs.limit(0))).collect()} == {"und"}
    empty = hard_docs.limit(0)
    assert toxicity.score(empty, machine).count() == quality.judge(empty, forest).count() == langid.identify(empty, model).count() == 0
    assert toxicity.drop_toxic(empty, machine).count() == quality.keep_sound(empty, forest).count() == 0
    missing = spark.createDataFrame([(None, "some words here"), (None, None)], "doc_id long, text string")
    assert [r.doc_id for r in toxicity.score(missing, machine).collect()] == [None, None]
    assert [r.doc_id for r in quality.judge(missing, forest).collect()] == [None, None]
    assert [r.held_out for r in langid.identify(missing.withColumn("lang", missing.text), model).collect()] == [True, True]
