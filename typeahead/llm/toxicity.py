"""Toxicity by a factorization machine over hashed terms.

Terms are runs of letters and digits, lower-cased, and their first PREFIXES
bytes, hashed to BUCKETS. The buckets whose presence depends most on the label
(chi-square over the training sample) become features; the machine learns their
weights and low-rank pair interactions, so that a pair such as an insult and a
group term can count for more than its parts.

Edge cases: null and empty texts have no term and get the score of the bias
alone; rows without doc_id are held out; repeated rows score alike; a text of any length is
scored whole, ties go to 1 (score >= 0.5); an empty table gives an empty result; with no
labelled rows of both kinds every score is the share of toxic labels (0 if
there are none); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import TRAIN_ROWS, held_out, sample
from .textvec import BASE, BYTE_VALUE, U64, chunks, column_bytes, give_back, mix, running, shifted

BUCKETS, FEATURES, FACTORS, PREFIXES, CHI_SQUARE = 1 << 20, 2048, 4, (4, 5, 6), 15.0
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
TERM = np.zeros(256, bool)
TERM[48:58] = TERM[97:123] = TERM[128:] = True


def terms(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of all terms of a chunk, with repeats."""
    data, off = column_bytes(part.column("text"))
    data = LOWER[data]
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z
    solid = TERM[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    start, end = solid.copy(), solid.copy()
    start[1:] &= ~solid[:-1] | edge[1:n]
    end[:-1] &= ~solid[1:] | edge[1:n]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    run = running(data, BASE, BYTE_VALUE)
    row = np.searchsorted(off, s, "right") - 1
    rows, out = [row], [mix(shifted(run[e] - run[s], s, BASE)) % U64(BUCKETS)]
    for k in PREFIXES:
        long = np.flatnonzero(e - s > k)
        a = s[long]
        rows.append(row[long])
        out.append(mix(shifted(run[a + k] - run[a], a, BASE) + U64(k)) % U64(BUCKETS))
    return np.concatenate(rows), np.concatenate(out).astype(np.int64)


def _distinct(row: np.ndarray, item: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique(row * width + item)
    return both // width, both % width


@dataclass
class Machine:
    """Bias, weights and factors over chosen buckets."""

    place: np.ndarray  # bucket -> feature or -1
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def features(self, part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        row, bucket = terms(part)
        f = self.place[bucket]
        keep = f >= 0
        return _distinct(row[keep], f[keep].astype(np.int64), max(1, len(self.weight)))

    def margin(self, row: np.ndarray, f: np.ndarray, n: int) -> np.ndarray:
        out = np.full(n, self.bias) + np.bincount(row, self.weight[f], n)
        for k in range(self.factor.shape[1]):
            v = self.factor[f, k]
            out += 0.5 * (np.bincount(row, v, n) ** 2 - np.bincount(row, v * v, n))
        return out

    def score(self, part: pa.RecordBatch) -> np.ndarray:
        m = self.margin(*self.features(part), part.num_rows)
        return 1 / (1 + np.exp(-np.clip(m, -30, 30)))


def train(place: np.ndarray, row: np.ndarray, f: np.ndarray, y: np.ndarray, epochs: int = 30, seed: int = 1) -> Machine:
    """Logistic loss by Adam over minibatches; weights decay, factors start small."""
    m, rng = int(place.max(initial=-1)) + 1, np.random.default_rng(seed)
    share = float(y.mean()) if len(y) else 0.0
    machine = Machine(place, float(np.log((share + 1e-6) / (1 - share + 1e-6))), np.zeros(m), rng.normal(0, 0.02, (m, FACTORS)))
    if not m:
        return machine
    order = np.argsort(row, kind="stable")
    row, f = row[order], f[order]
    begin = np.searchsorted(row, np.arange(len(y) + 1))
    theta = np.concatenate([machine.weight[:, None], machine.factor], 1)
    bias, first, second, step = np.array([machine.bias]), np.zeros_like(theta), np.zeros_like(theta), 0
    for epoch in range(epochs):
        rate = 0.05 * 0.9**epoch
        for part in np.array_split(rng.permutation(len(y)), max(1, len(y) // 512)):
            step += 1
            size = begin[part + 1] - begin[part]
            at = np.repeat(begin[part] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            r, g = np.repeat(np.arange(len(part)), size), f[at]
            machine.bias, machine.weight, machine.factor = float(bias[0]), theta[:, 0], theta[:, 1:]
            d = (1 / (1 + np.exp(-np.clip(machine.margin(r, g, len(part)), -30, 30))) - y[part]) / len(part)
            grad = 1e-5 * theta
            grad[:, 0] += np.bincount(g, d[r], m)
            for k in range(FACTORS):
                v = theta[g, k + 1]
                grad[:, k + 1] += np.bincount(g, d[r] * (np.bincount(r, v, len(part))[r] - v), m)
            first = 0.9 * first + 0.1 * grad
            second = 0.999 * second + 0.001 * grad * grad
            theta = theta - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
            bias = bias - rate * d.sum() * 4
    machine.bias, machine.weight, machine.factor = float(bias[0]), theta[:, 0].copy(), theta[:, 1:].copy()
    return machine


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        y = batch.column("y").to_numpy()
        at = 0
        for part in chunks(batch, "text"):
            row, bucket = _distinct(*terms(part), BUCKETS)
            toxic = y[at + row]
            at += part.num_rows
            hit, inverse = np.unique(bucket, return_inverse=True)
            yield pa.record_batch([pa.array(hit), pa.array(np.bincount(inverse, minlength=len(hit))), pa.array(np.bincount(inverse, toxic, len(hit)).astype(np.int64))], names=["b", "n", "t"])


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Machine:
    """Learn from at most ``rows`` labelled documents; what reaches the driver is bounded by that and FEATURES."""
    train_rows = sample(docs, labels, "toxic", rows)
    total, toxic = train_rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    place = np.full(BUCKETS, -1, np.int32)
    if not 0 < toxic < total:
        return Machine(place, 30.0 if toxic else -30.0, np.zeros(0), np.zeros((0, FACTORS)))
    counts = train_rows.select("text", "y").mapInArrow(_term_counts, "b long, n long, t long").groupBy("b").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    a, b = F.col("t").cast("double"), (F.col("n") - F.col("t")).cast("double")
    p, q = float(toxic), float(total - toxic)
    chi = (a * (q - b) - b * (p - a)) ** 2 * (p + q) / (p * q * (a + b) * (p + q - a - b + 1e-9))
    best = counts.filter("n > 2").select("b", chi.alias("chi")).filter(F.col("chi") > CHI_SQUARE).orderBy(F.desc("chi"), "b").limit(FEATURES).collect()
    place[[r.b for r in best]] = np.arange(len(best))
    chooser = Machine(place, 0.0, np.zeros(len(best)), np.zeros((len(best), FACTORS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                row, f = chooser.features(part)
                lists = pa.ListArray.from_arrays(np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32), pa.array(f.astype(np.int32)))
                yield pa.record_batch([part.column("doc_id"), part.column("y"), lists], names=["doc_id", "y", "f"])

    got = train_rows.mapInArrow(run, "doc_id long, y int, f array<int>").toArrow().sort_by("doc_id").combine_chunks()
    f = got.column("f").combine_chunks() if isinstance(got.column("f"), pa.ChunkedArray) else got.column("f")
    size = f.value_lengths().to_numpy()
    return train(place, np.repeat(np.arange(len(size)), size), f.flatten().to_numpy().astype(np.int64), got.column("y").to_numpy().astype(float))


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """(doc_id, held_out, score, predicted)."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # BUCKETS small integers and FEATURES rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                s = shared.value.score(part)
                yield pa.record_batch([part.column("doc_id"), part.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, machine: Machine) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is under one half."""
    shared, names = docs.sparkSession.sparkContext.broadcast(machine), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                yield part.filter(pa.array(shared.value.score(part) < 0.5)).select(names)
        give_back()

    return docs.mapInArrow(run, docs.schema)
