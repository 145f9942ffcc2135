"""Exact cosine-threshold links between embeddings of one label, by cover trees.

Equal vectors fall into one representative first. Some representatives of a label
are its top-level centres, one for about BLOCK rows; each row lives in the cell
of its nearest centre and visits those other cells, of lower number, that a
partner of it can live in: as both are within the threshold's distance, the row
can be no further than that from the plane between the two centres. A cell is
one task, or, where it is large, blocks by distance from its centre of which
only neighbours meet. A task builds cover trees (nested levels, radii halving
from 1) and walks two trees together, dropping node pairs that the covering
radii prove too far apart. What reaches the leaves is checked by the exact
cosine in double precision. Tasks give link counts and spanning edges, never the
pairs.

For unit vectors cosine >= c means a distance of at most sqrt(2 - 2c).

Edge cases: rows without label, and null, empty or zero vectors or vectors with
a null, NaN or infinite component link with nothing; vectors of different
lengths are not compared; an empty table gives an empty result; other columns
are ignored; ``vec_id`` names a row, and a repeated one has the links of all its
rows' vectors counted row by row.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, scratch
from .components import components
from .textvec import spread

BLOCK, CENTRES, TOP, LEVELS, PAIRS, BATCH = 4096, 1024, 1.0, 6, 1 << 16, 256
SLACK = 1e-7  # rounding of distances (the root of that of products); pruning must stay on the safe side


def reach_of(cosine: float) -> float:
    """The largest distance of two unit vectors at the threshold."""
    return math.sqrt(max(0.0, 2 - 2 * cosine)) + SLACK


def unit_rows(column, n: int) -> np.ndarray:
    """List column -> matrix of unit rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = np.array(column.flatten().to_numpy(), np.float64).reshape(n, -1)
    x /= np.abs(x).max(1, keepdims=True, initial=1e-300)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class CoverTree:
    """Levels of nodes; a node has a centre point, its covering radius, and a run of nodes one level down.

    The nodes of the last level are single points.
    """

    def __init__(self, x: np.ndarray):
        self.x = x
        runs = [np.arange(len(x))]
        centres, radii, counts = [], [], []
        for level in range(LEVELS):
            reach = TOP / 2**level
            made, centre, radius, count = [], [], [], []
            for run in runs:
                if len(run) == 1:
                    made.append(run)
                    centre.append(run[0])
                    radius.append(0.0)
                    count.append(1)
                    continue
                before = len(made)
                for own, far in self._split(run, reach):
                    made.append(own)
                    centre.append(own[0])
                    radius.append(far)
                count.append(len(made) - before)
            centres.append(np.array(centre, np.int64))
            radii.append(np.array(radius))
            counts.append(np.array(count, np.int64))
            runs = made
        order = np.concatenate(runs) if runs else np.zeros(0, np.int64)
        centres.append(order)
        radii.append(np.zeros(len(order)))
        counts.append(np.array([len(r) for r in runs], np.int64))
        self.centres, self.radii = centres, radii
        self.counts = counts  # of level k: children of each node of level k - 1
        self.starts = [np.cumsum(c) - c for c in counts]

    def _split(self, left: np.ndarray, reach: float):
        """Points within reach of the first, of the first that is left, and so on, with the largest distance."""
        while len(left):
            head = min(BATCH, len(left))
            far = np.sqrt(np.maximum(0, 2 - 2 * (self.x[left[:head]] @ self.x[left].T)))
            near = far <= reach
            free = np.ones(len(left), bool)
            for i in range(head):
                if free[i]:
                    own = near[i] & free
                    own[i] = True
                    free &= ~own
                    own[i] = False
                    rest = np.flatnonzero(own)
                    yield np.append(left[i], left[rest]), float(far[i, rest].max(initial=0.0))
            left = left[free]


def dual_walk(a: CoverTree, b: CoverTree, cosine: float):
    """Arrays (i, j) of points of a and b with x_i . y_j >= cosine, in bounded batches."""
    reach = reach_of(cosine)

    def near(level: int, i: np.ndarray, j: np.ndarray):
        dot = np.einsum("ij,ij->i", a.x[a.centres[level][i]], b.x[b.centres[level][j]])
        if level == LEVELS:
            ok = dot >= cosine
        else:
            ok = np.sqrt(np.maximum(0, 2 - 2 * dot)) <= a.radii[level][i] + b.radii[level][j] + reach
        return i[ok], j[ok]

    def down(level: int, i: np.ndarray, j: np.ndarray):
        if level == LEVELS:
            yield a.centres[level][i], b.centres[level][j]
            return
        ca, cb = a.counts[level + 1][i], b.counts[level + 1][j]
        sizes = ca * cb
        at = 0
        ends = np.cumsum(sizes)
        while at < len(i):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
            n = sizes[at:to]
            inner = spread(np.zeros(to - at, np.int64), n)
            width = np.repeat(cb[at:to], n)
            left = np.repeat(a.starts[level + 1][i[at:to]], n) + inner // width
            right = np.repeat(b.starts[level + 1][j[at:to]], n) + inner % width
            yield from down(level + 1, *near(level + 1, left, right))
            at = to

    top_b = len(b.centres[0])
    step = max(1, PAIRS * 16 // max(1, top_b))
    for k in range(0, len(a.centres[0]), step):
        dots = a.x[a.centres[0][k : k + step]] @ b.x[b.centres[0]].T
        far = np.sqrt(np.maximum(0, 2 - 2 * dots))
        i, j = np.nonzero(far <= a.radii[0][k : k + step, None] + b.radii[0][None, :] + reach)
        yield from down(0, i + k, j)


def _spanning(n: int, pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    up = list(range(n))

    def root(v: int) -> int:
        while up[v] != v:
            up[v] = up[up[v]]
            v = up[v]
        return v

    out = []
    for i, j in pairs:
        for u, v in zip(i.tolist(), j.tolist()):
            p, q = root(u), root(v)
            if p != q:
                up[p] = q
                out.append((u, v))
    return out


def _deal(cosine: float, names: list[str]):
    """Rows of a label with the cell they live in (home) and those they visit."""
    reach = reach_of(cosine)

    def run(group: pa.Table, centres: pa.Table) -> pa.Table:
        n = group.num_rows
        if not n:
            return pa.table([group.column(c) for c in names] + [pa.array([], t) for t in (pa.int32(), pa.int32(), pa.int32())], names=[*names, "cell", "home", "shell"])
        row, cell, far = np.arange(n), np.zeros(n, np.int64), np.zeros(n)
        home = np.ones(n, bool)
        if centres.num_rows:
            x = unit_rows(group.column("v"), n)
            order = np.argsort(centres.column("rep").to_numpy(), kind="stable")
            c = unit_rows(centres.column("v"), len(order))[order]
            dots = x @ c.T
            own = dots.argmax(1)
            apart = np.sqrt(np.maximum(0, 2 - 2 * (c @ c.T)))
            may = dots[np.arange(n), own][:, None] - dots <= reach * apart[own] + SLACK
            may &= np.arange(len(c))[None, :] <= own[:, None]
            row, cell = np.nonzero(may)
            home = cell == own[row]
            far = np.sqrt(np.maximum(0, 2 - 2 * dots[row, cell]))
        out = group.select(names).take(pa.array(row))
        for name, values in (("cell", cell), ("home", home), ("shell", far / reach)):
            out = out.append_column(name, pa.array(values.astype(np.int32)))
        return out

    return run


def _compare(cosine: float):
    def run(group: pa.Table) -> pa.Table:
        rep, copies, block, one, two, home = (group.column(c).to_numpy() for c in ("rep", "copies", "block", "one", "two", "home"))
        x = unit_rows(group.column("v"), len(rep))
        links, pairs = np.zeros(len(rep), np.int64), []

        def cross(left: np.ndarray, right: np.ndarray, a: CoverTree, b: CoverTree) -> None:
            for i, j in dual_walk(a, b, cosine):
                i, j = left[i], right[j]
                if a is b:
                    once = i < j
                    i, j = i[once], j[once]
                np.add.at(links, i, copies[j])
                np.add.at(links, j, copies[i])
                pairs.append((i, j))

        if one[0] == two[0]:
            left, right = np.flatnonzero(home == 1), np.flatnonzero(home == 0)
            a = CoverTree(x[left])
            cross(left, left, a, a)
        else:
            left, right = np.flatnonzero(block == one), np.flatnonzero(block == two)
            a = CoverTree(x[left])
        if len(left) and len(right):
            cross(left, right, a, CoverTree(x[right]))
        edges = _spanning(len(rep), pairs)
        held = np.flatnonzero(links)
        # a row of one kind has the other kind's columns empty
        u = [int(rep[p]) for p, _ in edges] + rep[held].tolist()
        v = [int(rep[q]) for _, q in edges] + [None] * len(held)
        n = [0] * len(edges) + links[held].tolist()
        return pa.table([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(n, pa.int64())], names=["u", "v", "n"])

    return run


def _cells(reps: DataFrame, cosine: float) -> DataFrame:
    """(label, dim, cell, home, shell, rep, copies, v) of every cell that a row lives in or visits."""
    key = ["label", "dim"]
    sizes = reps.groupBy(*key).agg(F.count("*").alias("rows"))
    sizes = sizes.select(*key, F.ceil(F.col("rows") / BLOCK).cast("int").alias("nb"), F.greatest(F.lit(BLOCK), F.ceil(F.col("rows") / CENTRES)).alias("every"))
    reps = reps.join(sizes, key)
    centres = reps.filter((F.col("nb") > 1) & (F.pmod(F.xxhash64("rep", F.lit(1)), F.col("every")) == 0))
    centres = materialize(centres.select(*key, "nb", "rep", "v"), "centres").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    dealt = reps.withColumn("part", F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int"))
    names = ["label", "dim", "rep", "copies", "v"]
    schema = T.StructType([dealt.schema[c] for c in names] + [T.StructField(c, T.IntegerType()) for c in ("cell", "home", "shell")])
    return dealt.select(*names, "part").groupBy(*key, "part").cogroup(centres.groupBy(*key, "part")).applyInArrow(_deal(cosine, names), schema)


def _meetings(cells: DataFrame) -> DataFrame:
    """Rows of cells once for each pair of blocks (one, two) they are in."""
    key = ["label", "dim", "cell"]
    count = lambda name, *by: cells.groupBy(*key, *by).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    kinds = count("nb", "home", "shell").groupBy(*key).agg(F.collect_list(F.struct("home", "shell", "nb")).alias("kinds")).join(count("all"), key)
    rows = cells.join(kinds, key).withColumn("nb", F.expr("filter(kinds, k -> k.home = home and k.shell = shell)[0].nb"))
    number = "shiftleft(cast({0} * 4096 + {1} as long), 40) + {2}".format
    near = "filter(kinds, k -> k.home + home > 0 and abs(k.shell - shell) <= 1)"
    others = f"flatten(transform({near}, k -> transform(sequence(0, k.nb - 1), i -> {number('k.home', 'k.shell', 'i')})))"
    rows = rows.withColumn("block", F.when(F.col("all") > 1, F.expr(number("home", "shell", "pmod(xxhash64(rep), nb)"))).otherwise(0).cast("long"))
    rows = rows.withColumn("other", F.explode(F.when(F.col("all") > 1, F.expr(others)).otherwise(F.array("block"))))
    return rows.select(*key, "home", "rep", "copies", "v", "block", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"))


def links(vectors: DataFrame, cosine: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    rows = vectors.selectExpr("cast(vec_id as long) vec_id", "cast(embedding as array<double>) v", "label")
    good = F.col("label").isNotNull() & F.coalesce(
        F.expr("size(v) > 0 and forall(v, c -> c is not null and not isnan(c) and abs(c) < double('Infinity')) and exists(v, c -> c <> 0)"), F.lit(False)
    )
    print_ = ["label", "dim", "d1", "d2"]
    rows = rows.withColumn("v", F.when(good, F.transform("v", lambda c: c + 0.0)))
    rows = rows.select("vec_id", "label", "v", F.size("v").alias("dim"), F.xxhash64("v").alias("d1"), F.xxhash64(F.reverse("v"), F.lit(1)).alias("d2"))
    with scratch(spark) as made:
        same = rows.filter("v is not null and vec_id is not null").groupBy(*print_).agg(F.min(F.struct(F.col("vec_id").alias("rep"), "v")).alias("x"), F.count("*").alias("copies"))
        reps = materialize(same.select(*print_, "copies", "x.*"), "reps")
        cells = materialize(_cells(reps.select("label", "dim", "rep", "copies", "v"), cosine), "cells")
        found = materialize(_meetings(cells).groupBy("label", "dim", "cell", "one", "two").applyInArrow(_compare(cosine), "u long, v long, n long"), "links")
        count = found.filter("v is null").groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("n"))
        joined = components(found.filter("v is not null").select("u", "v")).withColumnRenamed("u", "rep")
        of_rep = reps.select(*print_, "rep", "copies").join(count, "rep", "left").join(joined, "rep", "left")
        of_rep = of_rep.select(*print_, (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "rep").alias("root"))
        out = rows.select("vec_id", *[F.when(F.col("v").isNotNull() & F.col("vec_id").isNotNull(), F.col(c)).alias(c) for c in print_]).join(of_rep, print_, "left")
        component = F.coalesce("root", "vec_id")
        out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (component == F.col("vec_id")).alias("kept"))
        return made.keep(materialize(out, "vectors"))
