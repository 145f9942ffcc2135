"""Near-duplicate documents by MinHash, confirmed on full shingle sets.

1. One pass hashes each document's distinct shingles: size and 128-bit digest of
   the set, and one-permutation MinHash with optimal densification, in bands.
2. Equal sets fall into one class with one representative.
3. Representatives that share a band bucket hang on its least id as a star: a
   bucket of m rows gives m - 1 candidate edges. Edges whose set sizes rule the
   threshold out go; the others are confirmed on full sets, hub by hub, in
   groups of about STAR members.
4. A bucket whose members all hang together needs nothing more, however large.
   Members of the others are compared within their hub's group: in blocks of
   about BLOCK rows, by range of set size and by whether they hang on the hub,
   so that only block pairs meet which can link and are not linked yet.
5. Components of all confirmed links, carried over to the copies.

A pair that meets the threshold exactly shares no band with probability
(1 - threshold**rows)**BANDS; rows is the largest number that keeps this under
MISS.

Edge cases: documents with fewer words than a shingle have their whole sequence
as the one shingle; those without words or text, and rows without doc_id, link
with nothing; equal rows link with each other; an empty table gives an empty
result. Rows that repeat a doc_id are one node if their shingle sets are equal,
else nodes of their own. A text is never cut: a long one is a group's only
company if its set is as large as the group may be. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_bitmap, key_bitmap, materialize, scratch
from .components import components
from .textvec import U64, chunks, column_bytes, give_back, gram_sums, grams, mix, span_hash, spread, words

BANDS, MISS, STAR, BLOCK, ITEMS = 40, 1e-5, 128, 256, 1 << 21
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def band_rows(percent: int) -> int:
    """Rows of a band: as many as keep the chance to miss a pair at the threshold under MISS."""
    rows = 1
    while (1 - (percent / 100) ** (rows + 1)) ** BANDS <= MISS:
        rows += 1
    return rows


def shingle_sets(part: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows, and where each row's begin (n + 1 long)."""
    data, off = column_bytes(part.column("text"))
    data = LOWER[data]
    s, e, first = words(data, off)
    run = gram_sums(span_hash(data, s, e))
    n = np.diff(first)
    count = np.where(n > 0, np.maximum(n - size + 1, 1), 0)
    at = spread(first[:-1], count)
    end = np.minimum(at + size, np.repeat(first[1:], count))
    h = grams(run, at, end)
    cut = np.concatenate([[0], np.cumsum(count)])
    each = [np.unique(h[a:b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
    begin = np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)
    return (np.concatenate(each) if each else h), begin


def signatures(h: np.ndarray, begin: np.ndarray, bins: int) -> np.ndarray:
    """One-permutation MinHash of rows with at least one shingle, no bin empty.

    The hash range is cut into bins; the least hash of each is its value. An
    empty bin takes the value of a filled bin that a hash of its own number and
    the attempt picks, the same for every set.
    """
    n = len(begin) - 1
    size = np.diff(begin)
    row = np.repeat(np.arange(n), size)
    bin_ = ((h >> U64(40)) * U64(bins) >> U64(24)).astype(np.int64)
    cell = row * bins + bin_
    first = np.concatenate([[True], cell[1:] != cell[:-1]])
    out = np.zeros(n * bins, U64)
    full = np.zeros(n * bins, bool)
    out[cell[first]] = h[first]
    full[cell[first]] = True
    empty, attempt = np.flatnonzero(~full), 0
    while len(empty):
        attempt += 1
        b = (empty % bins).astype(U64)
        pick = (mix(b * U64(1 << 20) + U64(attempt)) % U64(bins)).astype(np.int64)
        donor = empty - empty % bins + pick
        ok = full[donor]
        out[empty[ok]] = out[donor[ok]]
        empty = empty[~ok]
    return out.reshape(n, bins)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band, different bands having different keys."""
    out = np.repeat(np.arange(BANDS, dtype=U64)[None, :], len(sig), 0)
    cube = sig.reshape(len(sig), BANDS, -1)
    for j in range(cube.shape[2]):
        out = mix(out * U64(0x9E3779B97F4A7C15) + cube[:, :, j])
    return out


def digests(h: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and two digests of each row's set."""
    n = np.diff(begin)
    has = np.flatnonzero(n > 0)
    one, two = np.zeros(len(n), U64), np.zeros(len(n), U64)
    if len(has):
        one[has] = np.add.reduceat(mix(h + U64(1)), begin[has])
        two[has] = np.add.reduceat(mix(h ^ U64(0x5851F42D4C957F2D)), begin[has])
    return n, one, two


def _sketch(size: int, bins: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                h, begin = shingle_sets(part, size)
                n, one, two = digests(h, begin)
                has = np.flatnonzero(n > 0)
                keys = band_keys(signatures(h, np.append(begin[has], begin[-1]), bins)) if len(has) else np.zeros((0, BANDS), U64)
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum((n > 0) * BANDS)]).astype(np.int32), pa.array(keys.reshape(-1).view(np.int64)))
                yield pa.record_batch([part.column("doc_id"), part.column("t"), pa.array(n), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), lists], names=["doc_id", "t", "n", "d1", "d2", "bands"])
        give_back()

    return run


def _member_sets(size: int, bitmap):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(in_bitmap(bitmap.value, batch.column("k").to_numpy())))
            for part in chunks(batch, "text"):
                h, begin = shingle_sets(part, size)
                n, one, two = digests(h, begin)
                raw = memoryview(h.tobytes())
                at = (8 * begin).tolist()
                yield pa.record_batch(
                    [part.column("doc_id"), pa.array(n), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array([bytes(raw[a:b]) for a, b in zip(at, at[1:])], pa.binary())],
                    names=["doc_id", "n", "d1", "d2", "items"],
                )
        give_back()

    return run


def star_links(hub: np.ndarray, sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which sets meet the threshold with the hub's set."""
    size = np.array([len(x) for x in sets])
    every = np.concatenate(sets)
    at = np.minimum(np.searchsorted(hub, every), len(hub) - 1)
    same = np.add.reduceat((hub[at] == every).astype(np.int64), np.cumsum(size) - size)
    return 100 * same >= percent * (size + len(hub) - same)


def link_block(ids: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Spanning edges of the rows' links: pairs of a left and a right row over the threshold."""
    size = np.array([len(x) for x in sets])
    m = len(ids)
    shared = np.zeros((m, m), np.float32)
    codes, uniq = pd.factorize(np.concatenate(sets))
    row = np.repeat(np.arange(m), size)
    often = np.bincount(codes, minlength=len(uniq)) > 1
    new = np.cumsum(often) - 1
    keep = often[codes]
    codes, row = new[codes[keep]], row[keep]
    order = np.argsort(codes, kind="stable")
    codes, row = codes[order], row[order]
    for a in range(0, int(often.sum()), 4096):
        lo, hi = np.searchsorted(codes, [a, a + 4096])
        x = np.zeros((m, 4096), np.float32)
        x[row[lo:hi], codes[lo:hi] - a] = 1
        shared += x @ x.T
    same = np.rint(shared).astype(np.int64)
    linked = 100 * same >= percent * (size[:, None] + size[None, :] - same)
    linked &= left[:, None] & right[None, :]
    linked |= linked.T
    np.fill_diagonal(linked, False)
    out, free = [], np.ones(m, bool)
    for i in range(m):
        if free[i]:
            free[i] = False
            wave = [i]
            while wave:
                u = wave.pop()
                near = np.flatnonzero(linked[u] & free)
                free[near] = False
                out += [(int(ids[u]), int(ids[v])) for v in near.tolist()]
                wave += near.tolist()
    return out


def _sets_of(group: pa.Table) -> tuple[np.ndarray, pa.Table, list[np.ndarray]]:
    """Ids of a group, each once, with its rows and sets."""
    _, one = np.unique(group.column("u").to_numpy(), return_index=True)
    group = group.take(pa.array(one))
    return group.column("u").to_numpy(), group, [np.frombuffer(x, U64) for x in group.column("items").to_pylist()]


def _edges(edges: list[tuple[int, int]]) -> pa.Table:
    return pa.table([pa.array([x for x, _ in edges], pa.int64()), pa.array([y for _, y in edges], pa.int64())], names=["u", "v"])


def _confirm(percent: int):
    def run(group: pa.Table) -> pa.Table:
        hub = group.column("hub")[0].as_py()
        ids, _, sets = _sets_of(group)
        at = int(np.searchsorted(ids, hub))
        members = [i for i in range(len(ids)) if i != at]
        if not members:
            return _edges([])
        ok = star_links(sets[at], [sets[i] for i in members], percent)
        return _edges([(int(ids[i]), hub) for i, yes in zip(members, ok.tolist()) if yes])

    return run


def _link(percent: int):
    def run(group: pa.Table) -> pa.Table:
        ids, group, sets = _sets_of(group)
        block, a, b = (group.column(c).to_numpy() for c in ("block", "a", "b"))
        return _edges(link_block(ids, sets, block == a, block == b, percent))

    return run


def _identified(rows: DataFrame, repeated: DataFrame | None) -> DataFrame:
    """Rows with ``id``: the doc_id, or beyond 2**62 for the other sets of a repeated doc_id."""
    if repeated is None:
        return rows.withColumn("id", F.col("doc_id"))
    own = F.xxhash64("doc_id", "n", "d1", "d2").bitwiseAND((1 << 62) - 1) + F.lit(1 << 62)
    first = F.struct("n", "d1", "d2").eqNullSafe(F.col("least"))
    return rows.join(repeated, "doc_id", "left").withColumn("id", F.when(F.col("least").isNull() | first, F.col("doc_id")).otherwise(own)).drop("least")


def _hung(classes: DataFrame) -> DataFrame:
    """(b, u, n, hub, hub_n, m): members of every bucket of two or more."""
    buckets = classes.select(F.explode("bands").alias("b"), "u", "n")
    hubs = buckets.groupBy("b").agg(F.min("u").alias("hub"), F.min_by("n", "u").alias("hub_n"), F.count("*").alias("m")).filter("m > 1")
    return materialize(buckets.join(materialize(hubs, "hubs"), "b"), "buckets")  # a join of its own, which Spark splits where a bucket is hot


def _parts(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """In how many groups of bounded rows and shingles each key's rows go."""
    share = F.greatest(F.count("*") / most, F.sum("n") / ITEMS)
    return rows.groupBy(*keys).agg(F.ceil(share).cast("int").alias("nb"))


def _star_groups(hung: DataFrame, percent: int) -> DataFrame:
    """(u, hub, part) of candidate edges that set sizes allow, the hub itself in each part of its star."""
    can = F.least("n", "hub_n") * 100 >= F.greatest("n", "hub_n") * percent
    stars = hung.filter((F.col("u") != F.col("hub")) & can).select("u", "n", "hub").distinct()
    stars = materialize(stars, "candidates")
    parts = materialize(_parts(stars, ["hub"], STAR), "parts")
    members = stars.join(parts, "hub").select("u", "hub", F.pmod(F.xxhash64("u"), F.col("nb")).cast("int").alias("part"))
    return members.unionByName(parts.select(F.col("hub").alias("u"), "hub", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("part")))


def _open_groups(hung: DataFrame, joined: DataFrame, percent: int) -> DataFrame:
    """(u, hub, block, a, b): members of buckets that do not hang together, once for each block pair they are in."""
    root = lambda c: joined.select(F.col("u").alias(c), F.col("root").alias(c + "_root"))
    rows = hung.filter("m > 2").join(root("u"), "u", "left").withColumn("u_root", F.coalesce("u_root", "u"))
    apart = rows.groupBy("b").agg(F.min("u_root").alias("x"), F.max("u_root").alias("y")).filter("x <> y").select("b")
    apart = materialize(apart, "apart")
    level = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent))).cast("int")
    rows = rows.join(apart, "b").select("hub", "u", "n", "u_root").distinct().join(root("hub"), "hub", "left")
    rows = rows.select("hub", "u", "n", (F.col("u_root") == F.coalesce("hub_root", "hub")).cast("int").alias("main"), level.alias("level"))
    rows = materialize(rows, "open")
    kinds = _parts(rows, ["hub", "main", "level"], BLOCK)
    whole = _parts(rows, ["hub"], BLOCK).withColumnRenamed("nb", "all")
    kinds = kinds.groupBy("hub").agg(F.collect_list(F.struct("main", "level", "nb")).alias("kinds")).join(whole, "hub")
    kinds = materialize(kinds, "kinds")
    rows = rows.join(kinds, "hub").withColumn("nb", F.expr("filter(kinds, k -> k.main = main and k.level = level)[0].nb"))
    number = "shiftleft(cast({0} * 4096 + {1} as long), 40) + {2}".format
    near = "filter(kinds, k -> k.main + main < 2 and abs(k.level - level) <= 1)"
    others = f"flatten(transform({near}, k -> transform(sequence(0, k.nb - 1), i -> {number('k.main', 'k.level', 'i')})))"
    rows = rows.withColumn("block", F.when(F.col("all") > 1, F.expr(number("main", "level", "pmod(xxhash64(u), nb)"))).otherwise(0).cast("long"))
    rows = rows.withColumn("other", F.explode(F.when(F.col("all") > 1, F.expr(others)).otherwise(F.array("block"))))
    return rows.select("u", "hub", "block", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"))


def _rows(docs: DataFrame, percent: int, size: int) -> tuple[DataFrame, bool]:
    """(doc_id, t, id, n, root) of each row, and whether any doc_id is repeated; t is a hash of the text."""
    spark = docs.sparkSession
    text = docs.selectExpr("cast(doc_id as long) doc_id", "text", "xxhash64(text) t")
    sketch = materialize(text.mapInArrow(_sketch(size, BANDS * band_rows(percent)), "doc_id long, t long, n long, d1 long, d2 long, bands array<long>"), "sketch")
    digest = F.struct("n", "d1", "d2")
    repeated = sketch.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows"), F.min(digest).alias("least")).filter("rows > 1").drop("rows")
    repeated = materialize(repeated, "repeated")
    repeats = not repeated.isEmpty()
    named = lambda df: _identified(df, repeated if repeats else None)
    one = F.min(F.struct(F.col("id").alias("u"), "bands")).alias("x")
    classes = materialize(named(sketch).filter("n > 0 and doc_id is not null").groupBy("n", "d1", "d2").agg(one).select("n", "d1", "d2", "x.*"), "classes")
    hung = _hung(classes)
    groups = materialize(_star_groups(hung, percent), "stars")
    needed = hung.select(F.col("u").alias("id")).distinct()
    if repeats:
        needed = named(sketch.drop("bands")).join(needed, "id", "left_semi").select(F.col("doc_id").alias("id"))
    bitmap = spark.sparkContext.broadcast(key_bitmap(materialize(needed.select(F.xxhash64("id").alias("k")), "needed"), "k"))
    sets = text.withColumn("k", F.xxhash64("doc_id")).mapInArrow(_member_sets(size, bitmap), "doc_id long, n long, d1 long, d2 long, items binary")
    sets = materialize(named(sets).select(F.col("id").alias("u"), "items"), "sets")
    links = materialize(groups.join(sets, "u").groupBy("hub", "part").applyInArrow(_confirm(percent), "u long, v long"), "links")
    joined = components(links)
    apart = materialize(_open_groups(hung, joined, percent), "apart")
    if not apart.isEmpty():
        more = apart.join(sets, "u").groupBy("hub", "a", "b").applyInArrow(_link(percent), "u long, v long")
        joined = components(more.unionByName(joined.withColumnRenamed("root", "v")))
    label = classes.select("u", "n", "d1", "d2").join(joined, "u", "left").select("n", "d1", "d2", F.coalesce("root", "u").alias("root"))
    rows = named(sketch.drop("bands")).join(label, ["n", "d1", "d2"], "left")
    return rows.withColumn("root", F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "id"))).select("doc_id", "t", "id", "n", "root"), repeats


def near_duplicates(docs: DataFrame, percent: int = 80, size: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): links at 100 * intersection >= percent * union."""
    spark = docs.sparkSession
    with scratch(spark) as made:
        rows, repeats = _rows(docs, percent, size)
        out, component = rows, F.coalesce("root", "doc_id")
        if repeats:  # the least id of a component may be on a row that is not its node of least number
            least = rows.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"))
            out, component = rows.join(least, "root", "left"), F.coalesce("least", "doc_id")
        out = out.withColumnRenamed("n", "n_shingles")
        out = out.select("doc_id", "n_shingles", component.alias("component_id"), (component == F.col("doc_id")).alias("kept"))
        return made.keep(materialize(out, "near"))


def keep_one(docs: DataFrame, percent: int = 80, size: int = 5) -> DataFrame:
    """``docs`` with one row of each group, the one with the least doc_id; rows without doc_id stay.

    A row that repeats a doc_id with a text of its own is judged by that text.
    """
    spark = docs.sparkSession
    with scratch(spark) as made:
        rows, repeats = _rows(docs, percent, size)
        if not repeats:
            gone = made.keep(materialize(rows.filter("id <> root").select("doc_id"), "gone"))
            return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
        stay = rows.filter("id = root").groupBy("id").agg(F.min(F.struct("doc_id", F.coalesce("t", F.lit(0)).alias("t"))).alias("x")).select("x.*")
        stay = made.keep(materialize(stay.select(F.col("doc_id").alias("stay_id"), F.col("t").alias("stay_text")).distinct(), "stay"))
    same = (F.col("doc_id").cast("long") == F.col("stay_id")) & (F.col("near_dup_text") == F.col("stay_text"))
    kept = docs.withColumn("near_dup_text", F.coalesce(F.xxhash64("text"), F.lit(0))).join(stay, same, "left_semi")
    return kept.dropDuplicates(["doc_id", "near_dup_text"]).select(docs.columns).unionByName(docs.filter("doc_id is null"))
