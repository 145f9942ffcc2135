"""Quality rules, judged together by an isolation forest.

Each document gets counts of its words, symbols, repeated lines and repeated
word windows. The forest, grown on the statistics of sound labelled rows,
isolates documents with unusual statistics in few random splits; the path
length below which a document is an anomaly is calibrated on all labelled rows
of both kinds. Each tree has SUBSAMPLE points of its own, as isolation trees do,
drawn from all sound labelled rows by hash.

Edge cases: null counts as empty; empty and blank texts have no words and fail
the base rules; an empty table gives an empty
result; texts of any length are judged whole; a path equal to the threshold is kept;
rows without doc_id are judged as well; with no labelled rows the base rules
alone decide; repeated
rows are judged alike, count as often as they stand there for the threshold and
once for the draws; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, scratch
from .textvec import U64, chunks, column_bytes, give_back, gram_sums, grams, mix, span_hash, spread, words

TREES, SUBSAMPLE, MAX_WRONG, RULES = 100, 256, 0.002, 9
#: Ranges of path lengths that are summed apart.
CELLS = 1 << 12
BASE_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _lut(chars: str | range) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) if isinstance(c, str) else c for c in chars]] = True
    return out


SYMBOL, UPPER, DIGIT, LETTER = _lut("#*$%&|<>"), _lut(range(65, 91)), _lut(range(48, 58)), _lut([*range(65, 91), *range(97, 123), *range(128, 256)])
MARK = _lut([c for c in range(33, 127) if not chr(c).isalnum()])


def _per_row(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    run = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=run[1:])
    return np.diff(run[off])


def statistics(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(base counts as integers, rule statistics) of each row."""
    data, off = column_bytes(part.column("text"))
    n_rows = len(off) - 1
    s, e, first = words(data, off)
    h = span_hash(data, s, e)
    n = np.diff(first)
    chars = _per_row((data & 0xC0) != 0x80, off)
    solid = np.zeros(len(data) + 1, np.int64)
    np.add.at(solid, s, 1)
    np.add.at(solid, e, -1)
    word_chars = _per_row(((data & 0xC0) != 0x80) & (np.cumsum(solid)[:-1] > 0), off)
    # lines
    breaks = np.flatnonzero(data == 10)
    ls = np.sort(np.concatenate([off[:-1], breaks + 1]))
    le = np.sort(np.concatenate([breaks, off[1:]]))
    row = np.searchsorted(off, ls, "right") - 1
    held = (np.searchsorted(s, le) > np.searchsorted(s, ls)) & (le > ls)
    ls, le, row = ls[held], le[held], row[held]
    same = pd.factorize(span_hash(data, ls, le) ^ mix(row.astype(U64) + U64(1)))[0]
    fresh = np.zeros(len(same), bool)
    fresh[np.unique(same, return_index=True)[1]] = True
    lines, dup_lines = np.bincount(row, minlength=n_rows), np.bincount(row[~fresh], minlength=n_rows)
    # windows of three words
    at = spread(first[:-1], np.maximum(n - 2, 0))
    doc = np.repeat(np.arange(n_rows), np.maximum(n - 2, 0))
    codes = pd.factorize(grams(gram_sums(h), at, at + 3) ^ mix(doc.astype(U64) + U64(1)))[0]
    often = at[np.bincount(codes)[codes] > 1] if len(codes) else at
    cover = np.zeros(len(h) + 3, np.int64)
    np.add.at(cover, often, 1)
    np.add.at(cover, often + 3, -1)
    repeats = _per_row(np.cumsum(cover)[: len(h)] > 0, first)
    # the same word twice running, and distinct words
    twin = np.zeros(len(h), bool)
    twin[1:] = h[1:] == h[:-1]
    twin[first[:-1][n > 0]] = False
    base = np.stack([n, word_chars, _per_row(SYMBOL[data], off), dup_lines, repeats], 1).astype(np.int64)
    w, c, ln = np.maximum(n, 1), np.maximum(chars, 1), np.maximum(lines, 1)
    rules = np.stack(
        [
            base[:, 2] / w,
            repeats / w,
            dup_lines / ln,
            _per_row(twin, first) / w,
            _per_row(UPPER[data], off) / c,
            _per_row(DIGIT[data], off) / c,
            _per_row(MARK[data], off) / w,
            _per_row(LETTER[data], off) / np.maximum(off[1:] - off[:-1], 1),
            word_chars / w,
        ],
        1,
    )
    return base, rules


def base_failed(base: np.ndarray) -> np.ndarray:
    return (base[:, 0] < 50) | (100 * base[:, 4] > 50 * base[:, 0])


def _average_path(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search among n points."""
    n = np.maximum(n, 1).astype(float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / n, np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Isolation trees in flat arrays: feature (-1: leaf), split, left child (right is next), adjusted depth of leaves.

    Splits are drawn over the sample's range widened by half on either side, so
    that points beyond all samples are cut off as well.
    """

    feature: np.ndarray
    split: np.ndarray
    left: np.ndarray
    depth: np.ndarray
    least: float = -np.inf

    @staticmethod
    def grow(x: np.ndarray, seed: int = 7) -> Forest:
        """Trees over points drawn from ``x``."""
        rng = np.random.default_rng(seed)
        return Forest.over((x[rng.choice(len(x), min(SUBSAMPLE, len(x)), replace=False)] for _ in range(TREES)), rng)

    @staticmethod
    def over(drawn: Iterable[np.ndarray], rng: np.random.Generator) -> Forest:
        """One tree over each set of points."""
        feature, split, left, depth = [], [], [], []

        def new() -> None:
            feature.append(-1), split.append(0.0), left.append(-1), depth.append(0.0)

        for x in drawn:
            limit = int(np.ceil(np.log2(max(len(x), 2)))) + 2
            new()
            wait = [(len(feature) - 1, x, 0)]
            while wait:
                node, points, d = wait.pop()
                low, high = points.min(0), points.max(0)
                if len(points) < 2 or d >= limit:
                    depth[node] = d + float(_average_path(np.array([len(points)]))[0])
                    continue
                f = int(rng.integers(x.shape[1]))
                pad = 0.5 * (high[f] - low[f]) + 1e-3
                cut = rng.uniform(low[f] - pad, high[f] + pad)
                feature[node], split[node], left[node] = f, cut, len(feature)
                side = points[:, f] < cut
                new(), new()
                for child, sub in ((left[node], points[side]), (left[node] + 1, points[~side])):
                    if len(sub):
                        wait.append((child, sub, d + 1))
                    else:
                        depth[child] = d + 1.0
        return Forest(np.array(feature), np.array(split), np.array(left), np.array(depth))

    def roots(self) -> np.ndarray:
        inner = self.feature >= 0
        child = np.zeros(len(self.feature), bool)
        child[self.left[inner]] = child[self.left[inner] + 1] = True
        return np.flatnonzero(~child)

    def path(self, x: np.ndarray) -> np.ndarray:
        """Mean path length of each row; short means anomalous."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for root in self.roots().tolist():
            node = np.full(len(x), root)
            while True:
                f = self.feature[node]
                go = f >= 0
                if not go.any():
                    break
                right = x[rows[go], f[go]] >= self.split[node[go]]
                node[go] = self.left[node[go]] + right
            total += self.depth[node]
        return total / TREES


def calibrate(paths: DataFrame) -> float:
    """The threshold of most correct rows of (path, good, n) that rejects at most MAX_WRONG of the sound ones.

    Rows of one path are rejected together. Sums before each of CELLS ranges of
    paths reach the driver; running sums are taken inside the ranges.
    """
    count = lambda kind: F.coalesce(F.sum(F.when(kind, F.col("n"))), F.lit(0))
    steps = materialize(paths.groupBy("path").agg(count(F.col("good")).alias("lost"), count(~F.col("good")).alias("caught")), "paths")
    low, high, good, wrong = steps.agg(F.min("path"), F.max("path"), F.sum("lost"), F.sum("caught")).first()
    if not good or not wrong:
        return -np.inf
    steps = steps.withColumn("cell", F.floor((F.col("path") - low) * (CELLS / (high - low) if high > low else 0.0)))
    sums = steps.groupBy("cell").agg(F.sum("lost"), F.sum("caught"), F.min("path")).orderBy("cell").collect()
    before, lost, caught = [], 0, 0
    for k, (cell, more_lost, more_caught, _) in enumerate(sums):
        before.append((cell, lost, caught, sums[k + 1][3] if k + 1 < len(sums) else None))
        lost, caught = lost + more_lost, caught + more_caught
        if lost > MAX_WRONG * good:
            break
    before = steps.sparkSession.createDataFrame(before, "cell long, lost_before long, caught_before long, next double")
    order = Window.partitionBy("cell").orderBy("path")
    run = steps.join(F.broadcast(before), "cell").select(
        "path",
        (F.col("lost_before") + F.sum("lost").over(order)).alias("lost"),
        (F.col("caught_before") + F.sum("caught").over(order)).alias("caught"),
        F.coalesce(F.lead("path").over(order), "next").alias("next"),
    )
    best = run.filter(F.col("lost") <= MAX_WRONG * good).withColumn("gain", F.col("caught") - F.col("lost")).orderBy(F.desc("gain"), "path").first()
    if not best or best.gain <= 0:
        return -np.inf
    middle = (best.path + best.next) / 2  # there is a next one, as not all sound rows are lost
    return middle if middle > best.path else best.next


def _points(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
    x = batch.column("x")
    x = x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
    return x.flatten().to_numpy().reshape(batch.num_rows, RULES)


def _drawn(sound: DataFrame, n: int) -> list[np.ndarray]:
    """SUBSAMPLE of the ``n`` rows of (h, x) for each tree: those of least hash.

    Hashes up to a bound that some twice as many stay under go to the driver.
    """
    most = U64(min((1 << 64) - 1, (2 * SUBSAMPLE << 64) // n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = mix(batch.column("h").to_numpy().view(U64)[:, None] ^ mix(np.arange(1, TREES + 1, dtype=U64)))
            at, tree = np.nonzero(key <= most)
            yield pa.record_batch([pa.array(tree.astype(np.int32)), pa.array(key[at, tree].view(np.int64)), batch.column("x").take(pa.array(at))], names=["tree", "key", "x"])

    got = sound.select("h", "x").mapInArrow(run, "tree int, key long, x array<double>").toArrow()
    x, tree, key = _points(got), got.column("tree").to_numpy(), got.column("key").to_numpy().view(U64)
    order = np.lexsort([key, tree])
    first = np.searchsorted(tree[order], np.arange(TREES + 1))
    return [x[order[a : min(b, a + SUBSAMPLE)]] for a, b in zip(first, first[1:])]


def measure(docs: DataFrame) -> DataFrame:
    """(doc_id, base counts, base_failed, x) of each document; x are its rule statistics."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                base, x = statistics(part)
                lists = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * RULES, pa.array(x.reshape(-1)))
                yield pa.record_batch([part.column("doc_id"), *map(pa.array, base.T), pa.array(base_failed(base)), lists], names=["doc_id", *BASE_COUNTS, "base_failed", "x"])

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in BASE_COUNTS) + ", base_failed boolean, x array<double>"
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame) -> Forest | None:
    """Grow and calibrate on all labelled documents; None without sound ones."""
    return fit_measured(measure(docs), labels)


def fit_measured(measured: DataFrame, labels: DataFrame) -> Forest | None:
    """``fit`` by the statistics of the documents. What reaches the driver is bounded by TREES, SUBSAMPLE and CELLS."""
    spark = measured.sparkSession
    with scratch(spark):
        y = labels.filter("quality is not null").groupBy("doc_id").agg(F.max("quality").alias("y"))
        rows = measured.filter("not base_failed").groupBy("doc_id", "x").agg(F.count("*").alias("n")).join(y, "doc_id")
        rows = materialize(rows.select(F.xxhash64("doc_id", "x").alias("h"), (F.col("y") == 1).alias("good"), "n", "x"), "labelled")
        sound = rows.filter("good")
        n = sound.count()
        if not n:
            return None
        forest = Forest.over(_drawn(sound, n), np.random.default_rng(7))
        shared = spark.sparkContext.broadcast(forest)

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.record_batch([pa.array(shared.value.path(_points(batch))), batch.column("good"), batch.column("n")], names=["path", "good", "n"])

        forest.least = calibrate(rows.select("good", "n", "x").mapInArrow(walk, "path double, good boolean, n long"))
        return forest


def _verdict(forest: Forest | None, failed: np.ndarray, x: np.ndarray) -> np.ndarray:
    return ~failed & (forest.path(x) >= forest.least) if forest else ~failed


def judge(docs: DataFrame, forest: Forest | None) -> DataFrame:
    """(doc_id, base counts, base_failed, kept) of each document."""
    return judge_measured(measure(docs), forest)


def judge_measured(measured: DataFrame, forest: Forest | None) -> DataFrame:
    """``judge`` by the statistics of the documents."""
    shared = measured.sparkSession.sparkContext.broadcast(forest)  # TREES trees over SUBSAMPLE points

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            failed = batch.column("base_failed").to_numpy(zero_copy_only=False)
            kept = pa.array(_verdict(shared.value, failed, _points(batch)))
            yield pa.record_batch([*(batch.column(c) for c in ("doc_id", *BASE_COUNTS, "base_failed")), kept], names=["doc_id", *BASE_COUNTS, "base_failed", "kept"])

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in BASE_COUNTS) + ", base_failed boolean, kept boolean"
    return measured.mapInArrow(run, schema)


def fit_and_judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``judge`` of the documents that the forest is fitted on, each text read once."""
    measured = materialize(measure(docs), "measured")
    return judge_measured(measured, fit_measured(measured, labels))


def keep_sound(docs: DataFrame, forest: Forest | None) -> DataFrame:
    """The rows of ``docs``, all columns, that pass."""
    shared, names = docs.sparkSession.sparkContext.broadcast(forest), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                base, x = statistics(part)
                yield part.filter(pa.array(_verdict(shared.value, base_failed(base), x))).select(names)
        give_back()

    return docs.mapInArrow(run, docs.schema)
