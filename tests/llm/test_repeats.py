"""Substring dedup against brute force over all windows."""

import hashlib
import re
from collections import Counter

from typeahead.llm import repeats
from typeahead.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(texts, size):
    """(words, removed, kept) of each text."""
    lists = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + size]) for w in lists for i in range(len(w) - size + 1))
    out = []
    for w in lists:
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                gone[i : i + size] = [True] * size
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def test_op3_equals_brute_force(spark):
    path = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{path}/documents.parquet").collect()
    want = {d.doc_id: b for d, b in zip(docs, brute([d.text for d in docs], 35))}
    got = QUERIES["op3_substring_dedup"](spark, path).collect()
    assert len(got) == len(docs)
    assert sum(w[1] > 0 for w in want.values()) > 50
    for r in got:
        n, gone, kept = want[r.doc_id]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (n, gone, hashlib.sha256(kept.encode()).hexdigest())


def test_parts_of_passages_periods_and_repeats(spark):
    w = [f"w{i}" for i in range(400)]
    texts = [
        " ".join(w[:200]), " ".join(w[50:120]), " ".join(["x"] + w[30:80] + ["y"]), " ".join(w[160:200] + ["z"] * 120), " ".join(["z"] * 50),
        " ".join(["p", "q", "r"] * 60), " ".join(w[300:334]), " ".join(w[300:334]), " ".join(w[200:235] + ["m"] + w[200:235]), None, "", "same", "same",
        " ".join(w[:200]),
    ]
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)] + [(0, texts[0], 7)], "doc_id long, text string, n_words int")
    out = repeats.remove_repeats(docs)
    assert out.columns == ["doc_id", "text", "n_words", "n_removed"]
    want = sorted((i, t, n, g) for i, (n, g, t) in zip([*range(len(texts)), 0], brute([*texts, texts[0]], 35)))
    assert sorted((r.doc_id, r.text, r.n_words, r.n_removed) for r in out.collect()) == want


def test_hard_cases(spark, hard_docs):
    rows = hard_docs.collect()
    want = sorted((r.doc_id, t) for r, (_, _, t) in zip(rows, brute([r.text for r in rows], 35)))
    assert sorted((r.doc_id, r.text) for r in repeats.remove_repeats(hard_docs).collect()) == want
    assert repeats.remove_repeats(hard_docs.limit(0)).count() == 0
