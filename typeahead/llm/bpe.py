"""Byte-level BPE encoding and decoding from a rank file.

Two-tier lookup: a minimal perfect hash resolves pre-tokens that are whole
vocabulary entries; the others are merged with a heap of candidate pairs over a
linked list of bytes.

Edge cases: null text counts as empty; empty texts have no ids; an empty table gives an
empty result; rows without doc_id are encoded as well; a long text is one slice; the bytes of
any text survive the round trip; extra columns are dropped and repeated rows
are encoded row by row.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from .textvec import U64, chunks, column_bytes, first_of, give_back, mix, span_hash
from .tokens import PRETOKEN, CachedEncoder, spaced_units

RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a ``.tiktoken`` file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _joined(items: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    off = np.zeros(len(items) + 1, np.int64)
    np.cumsum([len(x) for x in items], out=off[1:])
    return np.frombuffer(b"".join(items), np.uint8), off


class PerfectHash:
    """A minimal perfect hash of byte strings: n keys in n slots, by displaced buckets.

    Buckets are placed from the largest on; each keeps the first displacement
    that sends its keys to free slots. Buckets of one key keep their slot itself
    (as -1 - slot). A key of the set is confirmed by comparing its bytes.
    """

    def __init__(self, keys: list[bytes], values: list[int]):
        n = self.n = len(keys)
        data, off = _joined(keys)
        h = span_hash(data, off[:-1], off[1:])
        self.buckets = max(1, n // 3)
        bucket = self._bucket(h)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=self.buckets)
        begin = np.cumsum(sizes) - sizes
        self.shift = np.zeros(self.buckets, np.int64)
        slot_of = np.empty(n, np.int64)
        free = np.ones(n, bool)
        for b in np.argsort(-sizes, kind="stable").tolist():
            size = int(sizes[b])
            if size < 2:
                break
            members = order[begin[b] : begin[b] + size]
            d = 0
            while True:
                tries = np.arange(d, d + 64)
                at = self._slot(h[members][None, :], tries[:, None])
                ok = free[at].all(1)
                ok &= (np.diff(np.sort(at, 1), axis=1) > 0).all(1)
                if ok.any():
                    k = int(np.argmax(ok))
                    break
                d += 64
            self.shift[b] = d + k
            slot_of[members] = at[k]
            free[at[k]] = False
        single = np.flatnonzero(sizes == 1)
        rest = np.flatnonzero(free)
        slot_of[order[begin[single]]] = rest
        self.shift[single] = -1 - rest
        self.value = np.empty(n, np.int64)
        self.value[slot_of] = values
        self.print = np.empty(n, U64)
        self.print[slot_of] = h
        self.key: list[bytes] = [b""] * n
        for i, s in enumerate(slot_of.tolist()):
            self.key[s] = keys[i]

    def _bucket(self, h: np.ndarray) -> np.ndarray:
        return ((h >> U64(32)) % U64(self.buckets)).astype(np.int64)

    def _slot(self, h: np.ndarray, d: np.ndarray) -> np.ndarray:
        return (mix(h ^ (d.astype(U64) * U64(0x9E3779B97F4A7C15))) % U64(self.n)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The only slot each hash can have, or -1 where its fingerprint differs."""
        d = self.shift[self._bucket(h)]
        slot = np.where(d < 0, -1 - d, self._slot(h, np.maximum(d, 0)))
        return np.where(self.print[slot] == h, slot, -1)


class BytePairCodec:
    """Ranks, the perfect hash over them, and the table of mergeable pairs."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {v: k for k, v in ranks.items()}
        self.base = [ranks[bytes([i])] for i in range(256)]
        self.whole = PerfectHash(list(ranks), list(ranks.values()))
        self.pair: dict[int, int] = {}
        for text, rank in ranks.items():
            for c in range(1, len(text)):
                a, b = ranks.get(text[:c]), ranks.get(text[c:])
                if a is not None and b is not None:
                    self.pair[a << 32 | b] = rank

    def merge(self, word: bytes) -> list[int]:
        """Ids of one pre-token: the pair of least rank, leftmost first, until none is left."""
        ids = [self.base[c] for c in word]
        n, get = len(ids), self.pair.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r << 32) | i for i in range(n - 1) if (r := get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            top = heapq.heappop(heap)
            i, rank = top & 0xFFFFFFFF, top >> 32
            j = after[i]
            if ids[i] < 0 or j >= n or get(ids[i] << 32 | ids[j]) != rank:
                continue  # a neighbour was merged meanwhile
            ids[i], ids[j] = rank, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := get(rank << 32 | ids[k])) is not None:
                    heapq.heappush(heap, r << 32 | i)
            p = before[i]
            if p >= 0 and (r := get(ids[p] << 32 | rank)) is not None:
                heapq.heappush(heap, r << 32 | p)
        return [x for x in ids if x >= 0]

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of text units, each split by the pattern."""
        split = [PRETOKEN.findall(u) for u in units]
        per_unit = np.fromiter(map(len, split), np.int64, len(split))
        tokens = [t.encode() for x in split for t in x]
        data, off = _joined(tokens)
        codes, uniq = pd.factorize(span_hash(data, off[:-1], off[1:]))
        first = first_of(codes, len(uniq)).tolist()
        slots = self.whole.find(uniq).tolist()
        out: list[list[int]] = []
        for at, slot in zip(first, slots):
            word = tokens[at]
            if slot >= 0 and self.whole.key[slot] == word:
                out.append([int(self.whole.value[slot])])
            else:
                out.append(self.merge(word))
        lens = np.fromiter(map(len, out), np.int64, len(out))[codes]
        flat = np.array([i for c in codes.tolist() for i in out[c]], np.uint32)
        ends = np.concatenate([[0], np.cumsum(lens)])[np.concatenate([[0], np.cumsum(per_unit)])]
        return flat, np.diff(ends)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


_codecs: dict[str, CachedEncoder] = {}


def codec(path: str) -> CachedEncoder:
    """One codec, with its unit cache, per worker process and rank file."""
    if path not in _codecs:
        made = BytePairCodec(read_ranks(path))
        cached = CachedEncoder(spaced_units, made.encode_units)
        cached.codec = made
        _codecs[path] = cached
    return _codecs[path]


def encode(docs: DataFrame, ranks: str) -> DataFrame:
    """(doc_id, text) -> (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = codec(ranks)
        for batch in batches:
            for part in chunks(batch, "text"):
                ids, at = enc.encode(*column_bytes(part.column("text")))
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.record_batch([part.column("doc_id"), lists], names=["doc_id", "ids"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, ranks: str) -> DataFrame:
    """(doc_id, ids) -> (doc_id, text); bytes that are no UTF-8 become U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = codec(ranks).codec
        for batch in batches:
            texts = [made.decode(x or []).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return tokens.selectExpr("cast(doc_id as long) doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, ranks: str) -> DataFrame:
    """Encode and decode each text, and digest both sides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = codec(ranks)
        made = enc.codec
        for batch in batches:
            for part in chunks(batch, "text"):
                ids, at = enc.encode(*column_bytes(part.column("text")))
                raw = memoryview(ids.astype("<u4").tobytes())
                one, two = [], []
                for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                    one.append(hashlib.sha256(raw[4 * a : 4 * b]).hexdigest())
                    two.append(hashlib.sha256(made.decode(ids[a:b].tolist())).hexdigest())
                yield pa.record_batch([part.column("doc_id"), pa.array(np.diff(at)), pa.array(one, pa.string()), pa.array(two, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        give_back()

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, RESULT)
