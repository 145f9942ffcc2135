"""Best-fit packing of token pieces into sequences of fixed capacity.

Bound-certified repacking: pieces are dealt to partitions, each packed by
best-fit decreasing and given a lower bound from dual feasible functions. A
partition whose bin count meets its bound is certified optimal. From the others
the bins that have room, and from all the bins at most half full, are pooled
(documents exchange partitions), packed again, and the better of old and new
packing is kept, until a round saves less than one sequence in SAVING.

Edge cases: null text is an empty document (it still gets its end id); an empty
table gives an empty result; repeated rows and ids, and rows without doc_id, are
packed row by row; pieces of equal length go in order of doc_id and piece; a
long text gives as many pieces as it needs; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, scratch
from .textvec import chunks, column_bytes, give_back
from .tokens import encoder

SAVING = 100_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long, load long, gap long"


def cut(n: int, capacity: int) -> list[int]:
    """Piece lengths of a document of n tokens: all full but the first."""
    if n <= capacity:
        return [n]
    k = -(-n // capacity)
    return [n - (k - 1) * capacity] + [capacity] * (k - 1)


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Tokenise (doc_id, text), add the end id, and cut what is longer than the capacity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, True)
        for batch in batches:
            for part in chunks(batch, "text"):
                ids, at = enc.encode(*column_bytes(part.column("text")))
                doc, piece, start, length, crc = [], [], [], [], []
                tail = np.array([end_id], "<u4").tobytes()
                raw = memoryview(ids.astype("<u4").tobytes())
                for d, a, b in zip(part.column("doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                    n, s = b - a + 1, 0
                    for i, m in enumerate(cut(n, capacity)):
                        c = zlib.crc32(raw[4 * (a + s) : 4 * min(a + s + m, b)])
                        s += m
                        doc.append(d)
                        piece.append(i)
                        start.append(s - m)
                        length.append(m)
                        crc.append(zlib.crc32(tail, c) if s == n else c)
                yield pa.record_batch([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        give_back()

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The best bin bound over three families of dual feasible functions.

    Identity; the threshold family (items beyond capacity - e count a whole bin,
    those under e nothing); and the rounding families of thresholds e and
    divisors k, all taken over the histogram of lengths.
    """
    c = capacity
    hist = np.bincount(lengths, minlength=c + 1)[: c + 1].astype(np.int64)
    x = np.arange(c + 1)
    best = -(-int((hist * x).sum()) // c)
    count, mass = np.cumsum(hist), np.cumsum(hist * x)
    e = np.arange(1, c // 2 + 1)
    best = max(best, int((-(-(c * (count[c] - count[c - e]) + mass[c - e] - mass[e - 1]) // c)).max(initial=0)))
    held = np.flatnonzero(hist)
    h = hist[held]
    for k in range(1, 33):
        num = (k + 1) * held
        f = np.where(num % c == 0, held * k, num // c * c)  # k * c * u_k(x / c)
        best = max(best, -(-int((h * f).sum()) // (k * c)))
    for t in np.unique(np.concatenate([c // np.arange(2, 65), c // np.arange(2, 65) + 1])):
        if 1 <= t <= c // 2:
            k = c // t
            f = np.where(2 * held > c, k - (c - held) // t, np.where(held >= t, 1, 0))
            best = max(best, -(-int((h * f).sum()) // k))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item; equal lengths go in input order."""
    order = np.argsort(-lengths, kind="stable")
    out = np.empty(len(lengths), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by room left
    rooms, n = 0, 0  # bit r of rooms: some bin has room r
    for i, m in zip(order.tolist(), lengths[order].tolist()):
        fits = rooms >> m
        if fits:
            room = m + (fits & -fits).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                rooms ^= 1 << room
        else:
            b, room = n, capacity
            n += 1
        out[i] = b
        if room > m:
            if not open_bins[room - m]:
                rooms |= 1 << (room - m)
            open_bins[room - m].append(b)
    return out


def _pack_group(capacity: int, again: int):
    def run(group: pa.Table) -> pa.Table:
        part = group.column("part")[0].as_py()
        order = np.lexsort([group.column(c).to_numpy() if not group.column(c).null_count else group.column(c).fill_null(-1).to_numpy() for c in ("piece", "doc_id")])
        group = group.take(pa.array(order))
        length = group.column("length").to_numpy()
        bins = best_fit_decreasing(length, capacity)
        n, least = int(bins.max()) + 1, lower_bound(length, capacity)
        seq = (np.int64(again) << 56) | (np.int64(part) << 20) | bins
        if again:
            old = group.column("sequence_id").to_numpy()
            names, codes = np.unique(old, return_inverse=True)
            if len(names) <= n:
                bins, seq, n = codes, old, len(names)
        load = np.bincount(bins, length, n).astype(np.int64)[bins]
        by = np.argsort(bins, kind="stable")
        before = np.cumsum(length[by]) - length[by]
        first = np.ones(len(by), bool)
        first[1:] = bins[by][1:] != bins[by][:-1]
        offset = np.empty_like(length)
        offset[by] = before - np.repeat(before[first], np.diff(np.append(np.flatnonzero(first), len(by))))
        cols = [group.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
        return pa.table([*cols, seq, offset, load, np.full(len(seq), n - least)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "load", "gap"])

    return run


def pack(pieces: DataFrame, capacity: int = 2048, per_part: int = 20_000, rounds: int = 100) -> DataFrame:
    """Place each piece (length 1..capacity) in a sequence, at a gapless offset.

    ``per_part`` (under 2**20) bounds the pieces that one task packs; ``rounds``
    (under 128) the exchanges, which end by themselves when they stop paying.
    ``gap`` is the distance from the bound of the group that packed the row
    last; 0 certifies that group.
    """
    spark = pieces.sparkSession
    with scratch(spark) as made:
        pieces = materialize(pieces, "pieces")
        n = max(1, -(-pieces.count() // per_part))
        dealt = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(n)))
        packed = materialize(dealt.groupBy("part").applyInArrow(_pack_group(capacity, 0), PACKED), "packed")
        loose = ((F.col("gap") > 0) & (F.col("load") < capacity)) | (2 * F.col("load") <= capacity)
        used = None
        for again in range(1, rounds + 1):
            before, used = used, packed.filter("offset = 0").count()
            left = packed.filter(loose).count()
            if not left or (before is not None and before - used <= used // SAVING):
                break
            m = max(1, -(-left // per_part))
            regroup = packed.filter(loose).withColumn("part", F.pmod(F.xxhash64("sequence_id", F.lit(again)), F.lit(m)))
            better = regroup.groupBy("part").applyInArrow(_pack_group(capacity, again), PACKED)
            packed = materialize(packed.filter(~loose).unionByName(better), "packed")
        return made.keep(packed)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Tokenise, cut and pack whole documents."""
    return pack(token_pieces(docs, tokenizer, capacity, end_id), capacity)


def assemble(packed: DataFrame, tokens: DataFrame) -> DataFrame:
    """The sequences themselves: ``tokens`` has doc_id and ids (with end ids), one row per document."""
    part = packed.join(tokens, "doc_id").select(
        "sequence_id", "offset", F.expr("slice(ids, cast(start + 1 as int), cast(length as int))").alias("ids")
    )
    return part.groupBy("sequence_id").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids")
    )
