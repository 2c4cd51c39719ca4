"""Exact cosine threshold join of embeddings by dual traversal of cover trees.

On unit vectors a cosine of at least ``c`` is a distance of at most sqrt(2 - 2c). Vectors of a label go to
the nearest of some pivots (the top level), cells are cut into chunks of bounded size, and two chunks only meet when
their pivots' distance is within their covering radii plus the threshold. Where two chunks meet, both
have a tree of nested levels whose radii halve; pairs of nodes are descended together and pruned by the
same bound, down to pairs of vectors, whose cosine is computed in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablelens.llm.common import components, grouped, stored

CHUNK = 2048
PIVOTS = 256  # at most, in a label
RADII = (1.0, 0.5, 0.25)  # of the levels below the root, whose radius of 2 covers every unit vector
SLACK = 1e-9  # of computed distances
STEP = 100_000  # pairs of nodes whose distance is computed at once


def clean(column: pa.Array) -> list[bytes | None]:
    """Vectors as float64 bytes; None for null, empty or zero ones and those with null or non-finite components."""
    out = []
    for v in column.to_pylist():
        v = None if v is None or None in v else np.array(v, np.float64)
        out.append(v.tobytes() if v is not None and len(v) and np.isfinite(v).all() and v.any() else None)
    return out


def unit(vectors: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(vectors), np.float64).reshape(len(vectors), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square leaves the range of a double
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * (x @ y.T)))


class CoverTree:
    """Nested nets of unit vectors: a level's centres stay centres below; each node lists its children."""

    def __init__(self, x: np.ndarray):
        self.x, n = x, len(x)
        centres = np.zeros(1, np.int64)
        self.levels = []
        parents = np.zeros(n, np.int64)  # of each vector: the centre (by place) that covers it
        for radius in RADII:
            chosen, cover, near = list(centres), np.full(n, -1, np.int64), np.full(n, np.inf)
            for k, c in enumerate(chosen):
                self._reach(c, k, radius, cover, near)
            while (left := np.flatnonzero(cover < 0)).size:
                chosen.append(int(left[0]))
                self._reach(int(left[0]), len(chosen) - 1, radius, cover, near)
            centres = np.array(chosen, np.int64)
            self.levels.append([centres, parents[centres], None, None])
            parents = cover
        self.levels.append([np.arange(n), parents, np.zeros(n), None])
        # covering radii from below, and the children of each node
        for k in range(len(self.levels) - 1, 0, -1):
            at, parent, radius, _ = self.levels[k]
            above = self.levels[k - 1]
            reach = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ij,ij->i", x[at], x[above[0][parent]]))) + radius
            above[2] = np.zeros(len(above[0]))
            np.maximum.at(above[2], parent, reach)
            order = np.argsort(parent, kind="stable")
            above[3] = order, np.searchsorted(parent[order], np.arange(len(above[0]) + 1))

    def _reach(self, c: int, k: int, radius: float, cover: np.ndarray, near: np.ndarray) -> None:
        d = np.sqrt(np.maximum(0, 2 - 2 * (self.x @ self.x[c])))
        take = (d <= radius) & (d < near)
        cover[take], near[take] = k, d[take]


def expand(pairs: tuple[np.ndarray, np.ndarray], left: tuple, right: tuple) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Children of the left node with children of the right one, for each pair; in steps of bounded size."""
    (lo, ls), (ro, rs) = left, right
    a, b = pairs
    na, nb = ls[a + 1] - ls[a], rs[b + 1] - rs[b]
    ends = np.cumsum(na * nb)
    start = 0
    while start < len(a):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + STEP, "right")))
        n, width = (na * nb)[start:stop], nb[start:stop]
        which = np.repeat(np.arange(start, stop), n)
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        width = np.repeat(width, n)
        yield lo[ls[a[which]] + place // width], ro[rs[b[which]] + place % width]
        start = stop


def dual(one: CoverTree, two: CoverTree, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (in one, in two) of all vector pairs with at least this cosine; each once where the trees are the same."""
    reach = math.sqrt(2 - 2 * cosine) + SLACK
    same = one is two
    (ca, _, ra, _), (cb, _, rb, _) = one.levels[0], two.levels[0]
    alive = distances(one.x[ca], two.x[cb]) <= ra[:, None] + rb[None, :] + reach
    pairs = np.nonzero(np.triu(alive) if same else alive)
    for k in range(1, len(one.levels)):
        (ca, _, ra, _), (cb, _, rb, _) = one.levels[k], two.levels[k]
        kept = []
        for a, b in expand(pairs, one.levels[k - 1][3], two.levels[k - 1][3]):
            if same:  # a pair of different parents stands once already; below one parent, keep half
                stay = (a <= b) | (one.levels[k][1][a] != one.levels[k][1][b])
                a, b = a[stay], b[stay]
            dot = np.einsum("ij,ij->i", one.x[ca[a]], two.x[cb[b]])
            if k == len(one.levels) - 1:
                ok = (dot >= cosine) & ((a != b) if same else True)
                yield a[ok], b[ok]
            else:
                ok = np.sqrt(np.maximum(0, 2 - 2 * dot)) <= ra[a] + rb[b] + reach
                kept.append((a[ok], b[ok]))
        if kept or k < len(one.levels) - 1:
            pairs = tuple(np.concatenate([p[i] for p in kept]) if kept else np.empty(0, np.int64) for i in (0, 1))


def joined(key, rows, cosine: float) -> Iterator[pa.RecordBatch]:
    """Two chunks (or one with itself): per linked vector, the copies it links to and its component's least id."""
    own = list(rows)
    *_, i, a, j, b = key
    node, copies = (np.array([r[c] for r in own], np.int64) for c in (6, 7))
    x = unit([r[8] for r in own])
    first = np.array([r[9:11] == (i, a) for r in own])
    sides = [np.flatnonzero(first), np.flatnonzero(~first)] if (i, a) != (j, b) else [np.arange(len(own))] * 2
    if not len(sides[0]) or not len(sides[1]):
        return
    one = CoverTree(x[sides[0]])
    two = one if (i, a) == (j, b) else CoverTree(x[sides[1]])
    links, root = np.zeros(len(own), np.int64), np.arange(len(own))

    def top(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for p, q in dual(one, two, cosine):
        p, q = sides[0][p], sides[1][q]
        np.add.at(links, p, copies[q])
        np.add.at(links, q, copies[p])
        for u, v in zip(p.tolist(), q.tolist()):
            u, v = top(u), top(v)
            if u != v:
                root[max(u, v, key=lambda k: node[k])] = min(u, v, key=lambda k: node[k])
    linked = np.flatnonzero(links)
    yield pa.RecordBatch.from_arrays([pa.array(node[linked]), pa.array(links[linked]),
                                      pa.array(node[[top(int(k)) for k in linked]])], ["node", "links", "root"])


def threshold_components(vectors: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding",
                         label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row; vectors link within a label at ``cosine`` or above.

    Null, empty or zero vectors, null or non-finite components and null labels link with nothing, nor do
    vectors of different lengths. Equal vectors are compared once; a row counts all other rows that
    it links with. A null id takes no part (its component is null and ``kept`` false); an empty table gives no rows.
    """
    def tidy(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(clean(b.column(1)), pa.binary())], ["vec_id", "label", "vector"])

    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"),
                          F.col(label_col).cast("string").alias("label")).mapInArrow(tidy, "vec_id long, label string, vector binary")
    usable = F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    rows = stored(rows.withColumn("vector", F.when(usable, F.col("vector"))), "vectors")
    nodes = stored(rows.where("vector is not null").groupBy("label", "vector").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"))
                   .withColumn("dim", F.length("vector")).select("label", "dim", "node", "copies", "vector"), "nodes")
    space = ["label", "dim"]

    # top level: a bounded number of pivots for each label; rows meet them in parts of bounded size
    sizes = nodes.groupBy(*space).agg(F.count("*").alias("n"))
    ranked = nodes.withColumn("cell", F.row_number().over(Window.partitionBy(*space).orderBy(F.xxhash64("node"), "node"))).where(F.col("cell") <= PIVOTS)
    pivots = stored(ranked.join(sizes, space).where(F.col("cell") <= F.ceil(F.col("n") / CHUNK)), "pivots")
    salts = F.ceil(F.col("n") / (8 * CHUNK)).cast("int")
    dealt = nodes.join(sizes, space).select(*space, F.pmod(F.xxhash64("node", F.lit(1)), salts).cast("int").alias("salt"),
                                            F.lit(1).alias("kind"), "node", "copies", "vector", F.lit(0).alias("cell"))
    offered = pivots.select(*space, F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit(0).alias("kind"),
                            F.col("node"), "copies", "vector", "cell")

    def assign(key, group):
        centres, ids, waiting = [], [], []

        def flush():
            d = distances(unit([r[6] for r in waiting]), unit(centres))
            at = d.argmin(axis=1)
            columns = list(zip(*waiting))
            return pa.RecordBatch.from_arrays([
                pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[4], pa.int64()), pa.array(columns[5], pa.int64()),
                pa.array(columns[6], pa.binary()), pa.array([ids[k] for k in at], pa.int32()), pa.array(d[np.arange(len(at)), at])],
                ["label", "dim", "node", "copies", "vector", "cell", "reach"])

        for r in group:
            if r[3] == 0:
                centres.append(r[6])
                ids.append(r[7])
                continue
            waiting.append(r)
            if len(waiting) == CHUNK:
                yield flush()
                waiting = []
        if waiting:
            yield flush()

    cells = stored(grouped(offered.unionByName(dealt), assign, "label string, dim int, node long, copies long, vector binary, cell int, reach double",
                           *space, "salt", order=("kind",)), "cells")
    cover = cells.groupBy(*space, "cell").agg(F.count("*").alias("n"), F.max("reach").alias("reach")) \
        .join(pivots.select(*space, "cell", "vector"), [*space, "cell"])

    def near(key, group):
        group = list(group)
        x, reach = unit([r[5] for r in group]), np.array([r[4] for r in group])
        limit = math.sqrt(2 - 2 * cosine) + 2 * SLACK
        i, j = np.nonzero(np.triu(distances(x, x) <= reach[:, None] + reach[None, :] + limit))
        chunks = [-(-r[3] // CHUNK) for r in group]
        met = [(*key, group[p][2], a, group[q][2], b) for p, q in zip(i.tolist(), j.tolist())
               for a in range(chunks[p]) for b in range(a if p == q else 0, chunks[q])]
        columns = list(zip(*met))
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *[pa.array(c, pa.int32()) for c in columns[1:]]],
                                         ["label", "dim", "i", "a", "j", "b"])

    met = stored(grouped(cover.select(*space, "cell", "n", "reach", "vector"), near, "label string, dim int, i int, a int, j int, b int", *space), "met")
    counts = cells.groupBy(*space, "cell").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    placed = cells.join(counts, [*space, "cell"]).withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(2)), F.col("chunks")).cast("int"))
    ends = met.withColumn("end", F.explode(F.array_distinct(F.array(F.struct(F.col("i").alias("cell"), F.col("a").alias("chunk")),
                                                                    F.struct(F.col("j").alias("cell"), F.col("b").alias("chunk"))))))
    meeting = ends.select(*space, "i", "a", "j", "b", "end.cell", "end.chunk").join(placed, [*space, "cell", "chunk"]) \
        .select(*space, "i", "a", "j", "b", "node", "copies", "vector", "cell", "chunk")
    links = stored(grouped(meeting, lambda key, group: joined(key, group, cosine), "node long, links long, root long", *space, "i", "a", "j", "b"), "links")
    found = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    classes = nodes.join(links.groupBy("node").agg(F.sum("links").alias("links")), "node", "left").join(found, "node", "left") \
        .select("label", "vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    component = F.coalesce("component", "vec_id")
    return rows.join(classes, ["label", "vector"], "left") \
        .select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"),
                F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
