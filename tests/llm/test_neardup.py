"""Near-duplicates against brute force on full sets, and components against union-find."""

import random
import re

import pytest

from typeahead.llm import neardup
from typeahead.llm.components import components
from typeahead.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def roots(nodes, edges):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {n: find(n) for n in nodes}


def brute(rows, percent):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    by, edges = {}, set()
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    for near in by.values():
        edges |= {(a, b) for k, a in enumerate(near) for b in near[k + 1 :]}
    links = [(a, b) for a, b in edges if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return {i: (len(sets[i]), c) for i, c in roots(sets, links).items()}, len(links)


def test_op6_equals_brute_force(spark):
    path = "/root/testdata/sf0.01"
    want, n = brute([(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect()], 85)
    assert n > 30
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op6_minhash_near_dedup"](spark, path).collect()}
    assert got == want


@pytest.mark.parametrize("block", [512, 7])
def test_chains_and_large_groups(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "STAR", block)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        w = list(base)
        for k in rng.sample(range(120), rng.choice([0, 1, 2, 3, 5])):
            w[k] = f"x{rng.randrange(9)}"
        rows.append((100 - i, " ".join(w).title() if i % 3 else " ".join(w)))
    rows += [(200 + i, "one two three") for i in range(3)] + [(300, "one two"), (301, None), (302, ""), (303, "  "), (304, "a b c d e"), (305, "A b\nc d e")]
    want, n = brute(rows, 85)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, 85).collect()}
    assert n > 50
    assert got == want


def test_hard_cases(spark, hard_docs):
    rows = neardup.near_duplicates(hard_docs).collect()
    assert len(rows) == hard_docs.count()
    want, _ = brute([(r.doc_id, r.text) for r in hard_docs.collect()], 80)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want
    assert neardup.near_duplicates(hard_docs.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(50)] + [(500, i) for i in range(501, 560)]
    want = roots({x for e in edges for x in e}, edges)
    got = {r.u: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: r for n, r in want.items() if n != r}


def test_a_chain_of_five_thousand(spark):
    """Each text is its neighbour's near copy and far from the others; all are one component."""
    w = [f"w{i}" for i in range(5000 * 3 + 120)]
    rows = [(9000 - i, " ".join(w[3 * i : 3 * i + 120])) for i in range(5000)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 85)
    assert {(r.n_shingles, r.component_id) for r in got.select("n_shingles", "component_id").distinct().collect()} == {(116, 4001)}
    assert got.filter("kept").count() == 1


def test_family_of_members_that_hardly_link(spark, monkeypatch):
    """One bucket family of several clusters and sizes, compared block by block."""
    monkeypatch.setattr(neardup, "BLOCK", 5)
    monkeypatch.setattr(neardup, "STAR", 5)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for c in range(12):
        own = list(base)
        for k in rng.sample(range(150), 4):
            own[k] = f"c{c}"
        for j in range(8):
            one = list(own)
            one[rng.randrange(150)] = f"m{j}"
            rows.append((len(rows), " ".join(one + [f"t{k}" for k in range(rng.choice([0, 0, 20, 40]))])))
    want, n = brute(rows, 85)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()}
    assert got == want and n > 50


def test_repeated_ids(spark):
    """A repeated id with another text is a document of its own, and none is lost."""
    a, b, c = ("".join(f"{x}{i} " for i in range(60)) for x in "abc")
    rows = [(5, a, 1), (5, b, 2), (3, b, 3), (5, a, 1), (7, c, 4), (7, c.upper(), 5), (None, a, 6), (None, a, 6), (9, "", 7), (9, None, 8), (9, "", 9), (4, a + "x", 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int")
    got = sorted((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(docs).filter("doc_id is not null and n_shingles > 0").collect())
    assert got == [(3, 3, True), (4, 4, True), (5, 3, False), (5, 4, False), (5, 4, False), (7, 7, True), (7, 7, True)]
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    texts = sorted(str((r.doc_id, (r.text or "")[:4].lower())) for r in kept.collect())
    assert texts == sorted(map(str, [(3, "b0 b"), (4, "a0 a"), (7, "c0 c"), (9, ""), (None, "a0 a"), (None, "a0 a")]))
