"""Language identification by nearest centroid.

A text is the TF-IDF vector of its byte 3-grams (lower-cased, hashed to DIM
buckets), scaled to length one. Each language has several centroids, from
spherical k-means over its training rows; the language of the most similar
centroid (cosine) wins. A text further from its centroid than nearly all
training members is marked as rejected.

Edge cases: null texts and texts without a letter are ``und`` with score 0;
rows without doc_id are held out; texts are read whole, however long; of
equally near languages the first by name wins; an empty table gives an empty result;
with no labelled row every text is ``und``;
repeated rows are predicted alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_within, materialize
from .labelled import held_out
from .textvec import chunks, column_bytes

DIM, CENTROIDS, PER_LANGUAGE, TRAIN_ROWS, BATCH = 4096, 4, 500, 8000, 256
SHARPNESS, REJECT_SHARE = 20.0, 0.002
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER[[9, 10, 11, 12, 13]] = 32
ASCII_LETTER = np.zeros(256, bool)
ASCII_LETTER[65:91] = ASCII_LETTER[97:123] = True


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Chunks of bounded text and rows."""
    for part in chunks(batch, "text"):
        for k in range(0, part.num_rows, BATCH):
            yield part.slice(k, BATCH)


def gram_counts(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(rows x DIM counts, whether a row has a letter)."""
    data, off = column_bytes(part.column("text"))
    n = len(off) - 1
    low = LOWER[data]
    letters = np.zeros(len(data) + 1, np.int64)
    np.cumsum(ASCII_LETTER[data], out=letters[1:])
    has = np.diff(letters[off]) > 0
    for i in np.flatnonzero(~has & (np.diff(off) > 0)).tolist():
        has[i] = any(c.isalpha() for c in data[off[i] : off[i + 1]].tobytes().decode())
    if len(low) < 3:
        return np.zeros((n, DIM), np.float32), has
    code = (low[:-2].astype(np.uint32) << 16) | (low[1:-1].astype(np.uint32) << 8) | low[2:]
    bucket = (code * np.uint32(0x9E3779B1)) >> np.uint32(20)
    row = np.repeat(np.arange(n), np.diff(off))[: len(bucket)]
    inside = np.ones(len(bucket), bool)
    for back in (1, 2):
        at = off[1:-1] - back
        inside[at[(at >= 0) & (at < len(bucket))]] = False
    cell = row[inside] * DIM + bucket[inside]
    return np.bincount(cell, minlength=n * DIM).reshape(n, DIM).astype(np.float32), has


@dataclass
class Centroids:
    languages: list[str]
    idf: np.ndarray
    centre: np.ndarray  # one row each
    language: np.ndarray  # of each centre
    least: np.ndarray  # similarity below which a text is rejected, of each centre

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        return _unit(np.log1p(counts) * self.idf)

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language index, score, rejected) of each row."""
        sim = self.vectors(counts) @ self.centre.T
        best = np.stack([sim[:, self.language == k].max(1) for k in range(len(self.languages))], 1)
        who = best.argmax(1)
        odds = np.exp(SHARPNESS * (best - best.max(1, keepdims=True)))
        near = np.where(self.language[None, :] == who[:, None], sim, -1).argmax(1)
        return who, 1 / odds.sum(1), best.max(1) < self.least[near]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Spherical k-means; an emptied centre is left out."""
    rng = np.random.default_rng(seed)
    centre = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = (x @ centre.T).argmax(1)
        centre = _unit(np.stack([x[own == j].sum(0) for j in range(len(centre)) if (own == j).any()]))
    return centre


def train(counts: np.ndarray, lang: list[str]) -> Centroids:
    languages = sorted(set(lang))
    idf = (np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))) + 1).astype(np.float32)
    x, y = _unit(np.log1p(counts) * idf), np.array([languages.index(v) for v in lang])
    centre, language, least = [], [], []
    for k in range(len(languages)):
        own = x[y == k]
        c = k_means(own, CENTROIDS)
        sim = own @ c.T
        near = sim.argmax(1)
        centre.append(c)
        language += [k] * len(c)
        least += [float(np.quantile(sim[near == j, j], REJECT_SHARE)) if (near == j).any() else -1.0 for j in range(len(c))]
    return Centroids(languages, idf, np.concatenate(centre).astype(np.float32), np.array(language), np.array(least))


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, rows: int = TRAIN_ROWS) -> Centroids | None:
    """Learn from at most ``per_language`` texts of each language and ``rows`` in all, least hash first.

    Languages are counted first; a share of their hash range that holds some
    four times the wanted texts goes on to be ranked, so that no task ranks a
    whole language.
    """
    order = Window.partitionBy("lang").orderBy("h", "doc_id")
    rated = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("doc_id", "lang", F.xxhash64("doc_id").alias("h"))
    share = rated.groupBy("lang").agg((F.lit(4.0 * per_language) / F.count("*")).alias("share"))
    ids = (
        rated.join(broadcast_within(materialize(share, "languages"), F.length("lang") + 8), "lang")
        .filter(F.col("h") / F.lit(2.0**64) + 0.5 <= F.col("share"))
        .withColumn("k", F.row_number().over(order))
        .filter(F.col("k") <= per_language)
        .orderBy("k", "lang")
        .limit(rows)
        .select("doc_id", "lang")
        .distinct()
    )
    texts = docs.select("doc_id", "text", "lang").join(F.broadcast(ids), ["doc_id", "lang"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                counts, has = gram_counts(part)
                part, counts = part.filter(pa.array(has)), counts[has]
                row, col = np.nonzero(counts)
                begin = np.searchsorted(row, np.arange(len(counts) + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(begin, pa.array(v)) for v in (col.astype(np.int16), counts[row, col])]
                yield pa.record_batch([part.column("doc_id"), part.column("lang"), *lists], names=["doc_id", "lang", "b", "n"])

    got = texts.mapInArrow(run, "doc_id long, lang string, b array<short>, n array<float>").toArrow().sort_by("doc_id").combine_chunks()
    if not got.num_rows:
        return None
    b, n = (got.column(c).combine_chunks() for c in ("b", "n"))
    b, n = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in (b, n))
    counts = np.zeros((got.num_rows, DIM), np.float32)
    counts[np.repeat(np.arange(got.num_rows), b.value_lengths().to_numpy()), b.flatten().to_numpy()] = n.flatten().to_numpy()
    return train(counts, got.column("lang").to_pylist())


def identify(docs: DataFrame, model: Centroids | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # CENTROIDS rows of DIM numbers a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in slices(batch):
                counts, has = gram_counts(part)
                if m:
                    who, score, rejected = m.predict(counts)
                    names = [m.languages[k] if ok else "und" for k, ok in zip(who.tolist(), has.tolist())]
                else:
                    names, score, rejected = ["und"] * len(has), np.zeros(len(has)), ~has
                yield pa.record_batch([part.column("doc_id"), part.column("held_out"), pa.array(names, pa.string()), pa.array(np.where(has, score, 0.0).astype(float)), pa.array(rejected | ~has)], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")
