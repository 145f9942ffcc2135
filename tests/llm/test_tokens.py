"""Packing, BPE and token files against the public libraries and brute force."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from typeahead.llm import bpe, packing, tokenfile
from typeahead.llm.queries import QUERIES
from typeahead.llm.textvec import column_bytes
from typeahead.llm.tokens import encoder, tokenizer_path

public_tokenizers = pytest.importorskip("public_tokenizers")


def library(name):
    t = Tokenizer.from_file(tokenizer_path(name))
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def tik():
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(tokenizer_path("byte_bpe_50k.tiktoken")), special_tokens={})
    return e.encode_ordinary


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize(("name", "spaced"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_units_give_the_ids_of_whole_texts(hard_texts, name, spaced):
    enc, want = encoder(tokenizer_path(name), spaced), library(name)
    ids, at = enc.encode(*column_bytes(pa.array(hard_texts, pa.string())))
    for i, t in enumerate(hard_texts):
        assert ids[at[i] : at[i + 1]].tolist() == want(t), repr(t)[:60]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("aA 'stdlre.,#é  　\n\t1\x1c漢") ), max_size=14), min_size=1, max_size=5))
def test_units_on_generated_texts(texts):
    want, tk = library("byte_bpe_50k.json"), tik()
    for enc, f in ((encoder(tokenizer_path("byte_bpe_50k.json"), True), want), (bpe.codec(tokenizer_path("byte_bpe_50k.tiktoken")), tk), (encoder(tokenizer_path("word_bpe_49k.json"), False), library("word_bpe_49k.json"))):
        ids, at = enc.encode(*column_bytes(pa.array(texts)))
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [f(t) for t in texts]


def test_eviction_keeps_ids_right(hard_texts):
    enc = encoder(tokenizer_path("byte_bpe_50k.json"), True)
    small = type(enc)(enc.units, enc.encode_units, limit=8)
    want = library("byte_bpe_50k.json")
    for t in [*hard_texts, *hard_texts]:
        ids, _ = small.encode(*column_bytes(pa.array([t], pa.string())))
        assert ids.tolist() == want(t)


def test_perfect_hash_is_minimal():
    keys = [f"k{i}".encode() for i in range(5000)]
    h = bpe.PerfectHash(keys, list(range(5000)))
    assert sorted(h.key) == sorted(keys)
    data, off = bpe._joined(keys + [b"other", b""])
    slots = h.find(bpe.span_hash(data, off[:-1], off[1:]))
    assert [h.key[s] for s in slots[:5000]] == keys
    assert (slots[5000:] == -1).all()


def test_op2_equals_tiktoken(spark, small, hard_docs):
    path, f = tokenizer_path("byte_bpe_50k.tiktoken"), tik()
    got = {r.doc_id: r for r in QUERIES["op2_byte_bpe"](spark, small).collect()}
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids, r = f(d.text or ""), got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()
    assert bpe.round_trip(hard_docs, path).count() == hard_docs.count()
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(hard_docs, path), path).collect()}
    assert all(back[d.doc_id] == (d.text or "") for d in hard_docs.collect())
    assert bpe.round_trip(hard_docs.limit(0), path).count() == 0


def check_packing(rows, docs, f, capacity):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for d in docs:
        ids = f(d.text) + [0]
        pieces = sorted(by_doc[d.doc_id], key=lambda r: r.piece)
        assert [p.length for p in pieces] == packing.cut(len(ids), capacity)
        assert [p.piece for p in pieces] == list(range(len(pieces)))
        for p in pieces:
            assert p.ids_crc32 == crc(ids[p.start : p.start + p.length])
    for s in by_seq.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_seq), packing.lower_bound(np.array([r.length for r in rows]), capacity)


def test_op1_packs_all(spark, small):
    rows = QUERIES["op1_best_fit_packing"](spark, small).collect()
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    n, least = check_packing(rows, docs, library("byte_bpe_50k.json"), 2048)
    assert n <= least + 1


def test_packing_exchanges_between_partitions(spark, small):
    pieces = packing.token_pieces(spark.read.parquet(f"{small}/documents.parquet"), tokenizer_path("byte_bpe_50k.json"))
    split = packing.pack(pieces, 2048, per_part=20, rounds=0)
    better = packing.pack(pieces, 2048, per_part=20, rounds=3)
    count = lambda df: df.select("sequence_id").distinct().count()
    assert count(better) <= count(split)
    assert better.count() == split.count()


def test_packing_hard_cases(spark, hard_docs):
    path = tokenizer_path("byte_bpe_50k.json")
    rows = packing.pack_documents(hard_docs.dropDuplicates(), path, 64).collect()
    check_packing(rows, hard_docs.dropDuplicates().collect(), library("byte_bpe_50k.json"), 64)
    assert packing.pack_documents(hard_docs, path, 64).count() == len(rows) + 1
    assert packing.pack_documents(hard_docs.limit(0), path).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=7))
def test_bounds_never_exceed_the_optimum(lengths):
    def fits(k):
        def place(i, rooms):
            if i == len(lengths):
                return True
            return any(r >= lengths[i] and place(i + 1, rooms[:j] + [r - lengths[i]] + rooms[j + 1 :]) for j, r in enumerate(rooms))

        return place(0, [12] * k)

    best = next(k for k in range(1, 8) if fits(k))
    assert packing.lower_bound(np.array(lengths), 12) <= best
    assert int(packing.best_fit_decreasing(np.array(lengths), 12).max()) + 1 >= best


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 32), st.integers(0, 50), st.randoms())
def test_bits_round_trip(bits, n, rnd):
    ids = np.array([rnd.randrange(1 << bits) for _ in range(n)], np.uint32)
    raw = tokenfile.pack_bits(ids, bits)
    assert tokenfile.unpack_bits(raw, bits, 0, n).tolist() == ids.tolist()
    assert tokenfile.unpack_bits(raw, bits, n // 3, n).tolist() == ids[n // 3 :].tolist()


def test_op7_reads_back_what_it_wrote(spark, small, hard_docs):
    f = library("word_bpe_49k.json")
    rows = sorted(QUERIES["op7_token_files"](spark, small).collect())
    docs = sorted(spark.read.parquet(f"{small}/documents.parquet").collect())
    at = 0
    for d, r in zip(docs, rows, strict=True):
        ids = f(d.text) + [1]
        assert tuple(r) == (d.doc_id, at, len(ids), crc(ids))
        at += len(ids)
    path = tokenizer_path("word_bpe_49k.json")
    more = hard_docs.select("doc_id", "text").unionByName(spark.createDataFrame([(None, "no id"), (None, None), (-5, "first")], "doc_id long, text string"))
    got = sorted((r.start, -1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_crc32) for r in tokenfile.write_and_read(more, path, 49408, 1).collect())
    ids = {(-1 if r.doc_id is None else r.doc_id, len(f(r.text)) + 1, crc(f(r.text) + [1])) for r in more.collect()}
    assert {g[1:] for g in got} == ids and len(got) == more.count()
    assert [g[0] for g in got] == np.cumsum([0] + [g[2] for g in got[:-1]]).tolist()
    assert [g[1] for g in got] == [-1, -1, -5] + sorted(g[1] for g in got[3:])
    assert tokenfile.write_and_read(hard_docs.limit(0), path, 49408, 1).count() == 0


def test_random_access(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    files = tokenfile.write_files(docs, str(tmp_path), tokenizer_path("word_bpe_49k.json"), 49408, 1, 3)
    f, texts = library("word_bpe_49k.json"), {d.doc_id: d.text for d in docs.collect()}
    for name, n in files:
        r = tokenfile.Reader(name)
        assert r.n_ids == n
        for i in range(0, r.n_docs, 7):
            assert r.document(i).tolist() == f(texts[int(r.docs[i])]) + [1]
