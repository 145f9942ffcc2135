"""Cover-tree links against all pairs."""

import numpy as np
import pytest

from tests.llm.test_neardup import roots
from typeahead.llm import covertree
from typeahead.llm.queries import QUERIES


def brute(rows, cosine):
    ok = {}
    for i, v, label in rows:
        if label is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v):
            ok[i] = (np.array(v) / np.linalg.norm(v), label)
    ids = sorted(ok)
    edges = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if ok[a][1] == ok[b][1] and len(ok[a][0]) == len(ok[b][0]) and ok[a][0] @ ok[b][0] >= cosine]
    root = roots([r[0] for r in rows], edges)
    n = dict.fromkeys(root, 0)
    for a, b in edges:
        n[a] += 1
        n[b] += 1
    return {i: (n[i], root[i], root[i] == i) for i in root}


def as_dict(df):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in df.collect()}


def test_op10_equals_all_pairs(spark):
    path = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()]
    assert as_dict(QUERIES["op10_embedding_near_dedup"](spark, path)) == brute(rows, 0.98)
    want = brute(rows, 0.35)
    assert sum(n > 0 for n, _, _ in want.values()) > 50
    assert as_dict(covertree.links(spark.read.parquet(f"{path}/embeddings.parquet"), 0.35)) == want


@pytest.mark.parametrize("block", [4096, 9])
def test_clusters_copies_and_bad_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(covertree, "BLOCK", block)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(4, 8))
    rows = [(i, (centres[i % 4] + rng.normal(size=8) * rng.choice([0.05, 0.2, 0.4])).tolist(), int(i % 3 == 0)) for i in range(90)]
    rows += [(100 + i, rows[5][1], rows[5][2]) for i in range(6)] + [(110, [2 * c for c in rows[5][1]], rows[5][2])]
    rows += [(120, None, 1), (121, [0.0] * 8, 1), (122, [1.0, None], 1), (123, [float("nan")] * 8, 0), (124, [float("inf")] * 8, 0), (125, rows[5][1], None), (126, [], 1), (127, [1.0], 1), (128, [3.0], 1)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<double>, label int, n int")
    want = brute(rows, 0.95)
    assert as_dict(covertree.links(df, 0.95)) == want
    assert covertree.links(df.limit(0)).count() == 0


def test_tree_covers_its_points():
    x = np.random.default_rng(2).normal(size=(200, 5))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = covertree.CoverTree(x)
    assert sorted(tree.centres[-1].tolist()) == list(range(200))
    pairs = {(i, j) for a, b in covertree.dual_walk(tree, tree, 0.9) for i, j in zip(a.tolist(), b.tolist())}
    assert pairs == {(i, j) for i, j in zip(*np.nonzero(x @ x.T >= 0.9))}
