"""Removal of passages that recur anywhere in the corpus.

A window is ``size`` consecutive words of one document; a word is removed if a
window that covers it also starts elsewhere, in the same document or another.

1. Anchors: in each window the phrase of ``PHRASE`` words with the least hash
   (equal windows choose the same one). Phrases that occur once rule out their
   windows; a bitmap sized by their number carries the others to the next pass.
   Where it passes too much, the count in step 2 discards it.
2. Confirmation: the remaining windows meet by anchor and are counted by anchor
   and window hash, 128 bits together, over all documents. Recurring ones go to
   each shard (a hash of the row) that holds them.
3. Location: a shard takes one place of each of its recurring windows; phrases at
   every (size + 1) // 2 words of such a passage, at least one whole one in each
   of its windows, go into an Aho-Corasick automaton; all documents of the shard
   stream through it; each hit is extended word by word against its passage,
   and stretches of at least ``size`` words are removed.

A window seen twice in one slice of text recurs for certain: it goes to its
shards under a key of its own and only one signal a task meets the others, so
that no task gathers the occurrences of a frequent passage.

Edge cases: null and blank texts have no words and stay as they are but for
their text, which becomes empty; repeated rows count as occurrences of each
other; an empty table gives an empty result; other columns pass through. Texts
are never cut, so a shard is at least as large as its longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_bitmap, key_bitmap, materialize, parts, scratch
from .textvec import U64, chunks, column_bytes, give_back, gram_sums, grams, mix, span_hash, spread, words

PHRASE, SHARD_BYTES, RADIX, SIGNALS, SHARDS_A_TASK = 8, 6 << 20, 32, 200_000, 16
ROW, SHARD = "repeat_row_key", "repeat_shard"


def _batch_words(part: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    data, off = column_bytes(part.column(column))
    s, e, first = words(data, off)
    return span_hash(data, s, e), first


def anchors(h: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window starts, place of each window's anchor phrase, its hash): the phrase of least hash, the first of equal ones."""
    k = np.diff(first)
    starts = spread(first[:-1], np.maximum(k - size + 1, 0))
    if not len(starts):
        return starts, starts, np.zeros(0, U64)
    at = np.arange(len(h) - PHRASE + 1)
    best, span, reach = grams(gram_sums(h), at, at + PHRASE), size - PHRASE + 1, 1
    while reach < span:
        step = min(reach, span - reach)  # of two overlapping stretches
        n = len(best) - step
        left = best[:n] <= best[step:]
        best, at = np.where(left, best[:n], best[step:]), np.where(left, at[:n], at[step:])
        reach += step
    return starts, at[starts], best[starts]


def _phrase_counts(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                _, at, phrase = anchors(*_batch_words(part, "text"), size)
                if len(at):
                    once = np.concatenate([[True], at[1:] != at[:-1]])
                    h, n = np.unique(phrase[once].view(np.int64), return_counts=True)
                    yield pa.record_batch([pa.array(h), pa.array(n)], names=["h", "n"])
        give_back()

    return run


WINDOWS = "p long, h long, shard int, n int, w array<long>"


def _window_lists(h: np.ndarray, w: np.ndarray, shard: np.ndarray, signalled: set) -> Iterator[pa.RecordBatch]:
    """Windows of one slice as rows of WINDOWS, one for each anchor and shard.

    p is what rows meet by: the anchor, but for windows that recur for certain,
    whose rows pass through. A signal has no shard.
    """
    code = pd.factorize(w)[0]
    sure = np.bincount(code)[code] > 1

    def lists(h, w, shard, n, by):
        order = np.lexsort([w, shard, h])
        h, w, shard = h[order], w[order], shard[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (w[1:] != w[:-1]) | (shard[1:] != shard[:-1])
        h, w, shard = h[new], w[new], shard[new]
        head = np.ones(len(h), bool)
        head[1:] = (h[1:] != h[:-1]) | (shard[1:] != shard[:-1])
        begin = np.flatnonzero(head)
        held = pa.ListArray.from_arrays(np.append(begin, len(h)).astype(np.int32), pa.array(w.view(np.int64)))
        h, shard = h[begin], shard[begin]
        p = h if by is None else mix(h + by * (shard.astype(U64) + U64(1)))
        return pa.record_batch([pa.array(p.view(np.int64)), pa.array(h.view(np.int64)), pa.array(shard.astype(np.int32)), pa.array(np.full(len(h), n, np.int32)), held], names=["p", "h", "shard", "n", "w"])

    if not sure.all():
        yield lists(h[~sure], w[~sure], shard[~sure], 1, None)
    if sure.any():
        h, w, shard, code = h[sure], w[sure], shard[sure], code[sure]
        yield lists(h, w, shard, 2, U64(0x9E3779B97F4A7C15))
        one = np.unique(code, return_index=True)[1]
        one = one[[x not in signalled for x in w[one].tolist()]]
        if len(signalled) > SIGNALS:
            signalled.clear()
        signalled.update(w[one].tolist())
        if len(one):
            yield lists(h[one], w[one], np.full(len(one), -1), 2, None)


def _window_rows(size: int, bitmap, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signalled: set[int] = set()
        for batch in batches:
            for part in chunks(batch, "text"):
                words_, first = _batch_words(part, "text")
                starts, at, h = anchors(words_, first, size)
                if not len(starts):
                    continue
                edge = np.concatenate([[True], at[1:] != at[:-1]])
                may = in_bitmap(bitmap.value, h[edge])[np.cumsum(edge) - 1]
                starts, h = starts[may], h[may]
                if not len(starts):
                    continue
                w = grams(gram_sums(words_), starts, starts + size)
                key = part.column("k").to_numpy()[np.searchsorted(first, starts, "right") - 1]
                yield from _window_lists(h, w, key % shards, signalled)
        give_back()

    return run


def recurring(docs: DataFrame, size: int, shards: int) -> DataFrame:
    """(shard, h, w): anchor and hash of each recurring window in each shard that holds it, some more than once."""
    spark, text = docs.sparkSession, docs.select(F.col(ROW).alias("k"), "text")
    phrases = text.select("text").mapInArrow(_phrase_counts(size), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1").select("h")
    with scratch(spark):
        bitmap = spark.sparkContext.broadcast(key_bitmap(materialize(phrases, "phrases"), "h"))
    rows = text.mapInArrow(_window_rows(size, bitmap, shards), WINDOWS).repartition(max(parts(spark), shards // SHARDS_A_TASK), "p")
    rows = rows.select("p", "h", "shard", "n", F.explode("w").alias("w"))
    rows = rows.withColumn("total", F.sum("n").over(Window.partitionBy("p", "h", "w")))
    return rows.filter("total > 1 and shard >= 0").select("shard", "h", "w")


def places(h: np.ndarray, first: np.ndarray, known: np.ndarray, size: int) -> np.ndarray:
    """One place of each recurring window in a shard's words; ``known`` has their anchors and hashes as columns."""
    starts, _, anchor = anchors(h, first, size)
    if not len(starts) or not len(known):
        return np.zeros(0, np.int64)
    w = grams(gram_sums(h), starts, starts + size)
    at = np.flatnonzero(np.isin(w, known[:, 1]))
    code = pd.factorize(np.concatenate([known[:, 1], w[at]]))[0].astype(U64) * U64(0x9E3779B97F4A7C15)
    at = at[np.isin(mix(anchor[at] + code[len(known) :]), mix(known[:, 0] + code[: len(known)]))]
    return starts[at[np.unique(w[at], return_index=True)[1]]]


def _spelled(code: np.ndarray, used: np.ndarray) -> tuple[str, int]:
    """Word codes as one string of ``width`` characters a word.

    Each place in a word has its own RADIX characters, so that a node of the
    automaton has few children and a match can only begin at a word. Words that
    no pattern has are all spelled alike.
    """
    width = 1
    while RADIX**width < len(used):
        width += 1
    at = np.minimum(np.searchsorted(used, code), len(used) - 1)
    out = np.full((len(code), width), 7 * RADIX + 1, np.uint8)
    known = used[at] == code
    for k in range(width):
        out[known, k] = k * RADIX + at[known] // RADIX**k % RADIX
    return out.tobytes().decode("latin-1"), width


def locate(h: np.ndarray, first: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Which words of a shard's documents are covered by the recurring windows of the places ``at``, wherever they stand."""
    n = len(h)
    covered = np.zeros(n + 1, np.int64)
    if not len(at):
        return np.zeros(n, bool)
    code = pd.factorize(h)[0].astype(np.int64)
    at = np.sort(at)
    doc_of = np.searchsorted(first, at, "right")
    fresh = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (doc_of[1:] != doc_of[:-1])])
    begin = at[fresh]
    end = at[np.append(np.flatnonzero(fresh)[1:] - 1, len(at) - 1)] + size
    np.add.at(covered, begin, 1)
    np.add.at(covered, end, -1)
    tile, seed = (size + 1) // 2, min(PHRASE, (size + 1) // 2)
    tiles = (end - begin) // tile
    owner = np.repeat(np.arange(len(begin)), tiles)
    into = spread(np.zeros(len(begin), np.int64), tiles) * tile
    heads = begin[owner] + into
    text, width = _spelled(code, np.unique(code[(heads[:, None] + np.arange(seed)).reshape(-1)]))
    patterns: dict[str, list[tuple[int, int]]] = {}
    for p, j, t in zip(heads.tolist(), owner.tolist(), into.tolist()):
        patterns.setdefault(text[p * width : (p + seed) * width], []).append((j, t))
    automaton = ahocorasick.Automaton()
    for phrase, where in patterns.items():
        automaton.add_word(phrase, where)
    automaton.make_automaton()
    begin_l, end_l = begin.tolist(), end.tolist()
    for ws, we in zip(first[:-1].tolist(), first[1:].tolist()):
        if we - ws < size:
            continue
        seen = set()
        for stop, where in automaton.iter(text[ws * width : we * width]):
            for j, t in where:
                shift = ws + (stop + 1) // width - seed - t  # where the passage would begin
                a, b = begin_l[j], end_l[j]
                if shift == a or (j, shift) in seen:
                    continue
                seen.add((j, shift))
                lo, hi = max(ws, shift), min(we, shift + b - a)
                same = code[lo:hi] == code[a + lo - shift : a + hi - shift]
                if same.all():
                    if hi - lo >= size:
                        covered[lo] += 1
                        covered[hi] -= 1
                    continue
                flips = np.flatnonzero(np.diff(np.concatenate([[0], same.view(np.int8), [0]])))
                for x, y in zip(flips[::2].tolist(), flips[1::2].tolist()):
                    if y - x >= size:
                        covered[lo + x] += 1
                        covered[lo + y] -= 1
    return np.cumsum(covered[:-1]) > 0


def _apply(size: int, names: list[str], text: str, layout: bool):
    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        docs = docs.combine_chunks()
        data, off = column_bytes(docs.column(text))
        s, e, first = words(data, off)
        h = span_hash(data, s, e)
        known = np.stack([found.column(c).to_numpy().view(U64) for c in ("h", "w")], 1)
        gone = locate(h, first, places(h, first, known, size), size)
        lost = np.concatenate([[0], np.cumsum(gone)])[first]
        lost = np.diff(lost)
        kept, as_was = [], docs.column(text).to_pylist() if layout else []
        for i, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
            if layout and not lost[i]:
                kept.append(as_was[i])
                continue
            w = data[a:b].tobytes().split()
            if lost[i]:
                w = compress(w, (~gone[first[i] : first[i + 1]]).tolist())
            kept.append(b" ".join(w).decode())
        cols = [pa.array(kept, pa.string()) if c == text else docs.column(c) for c in names]
        return pa.table([*cols, pa.array(np.diff(first)), pa.array(lost.astype(np.int64))], names=[*names, "n_words", "n_removed"])

    return run


def remove_repeats(docs: DataFrame, size: int = 35, layout: bool = False) -> DataFrame:
    """Documents with recurring passages cut out of ``text``, kept words joined by one space.

    With ``layout`` a text that loses nothing stays exactly as it was.
    Adds n_words (before) and n_removed; a clashing input column is replaced.
    """
    names = [c for c in docs.columns if c not in ("n_words", "n_removed")]
    docs = docs.select(*names)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(parts(docs.sparkSession), -(-total // SHARD_BYTES))
    keyed = docs.withColumn(ROW, F.xxhash64(*[c for c in ("doc_id", "text") if c in names]))
    found = recurring(keyed, size, shards).withColumnRenamed("shard", SHARD)
    dealt = keyed.withColumn(SHARD, F.pmod(ROW, F.lit(shards)).cast("int"))
    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    return dealt.groupBy(SHARD).cogroup(found.groupBy(SHARD)).applyInArrow(_apply(size, names, "text", layout), schema)
