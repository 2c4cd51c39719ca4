"""Centroid clustering of integer vectors by a bisector tournament.

Two centroids i and j are told apart by a plane: its integer normal is c_j - c_i and its threshold |c_j|^2 - |c_i|^2,
and the sign of 2 x (c_j - c_i) - threshold says which one is nearer to x. A vector starts with centroid 0 and meets
the others in turn: k - 1 sign tests, of which a zero keeps the smaller number. Only the winner's distance is computed.

Every round is one pass over the stored vectors. A task sends a count and component sums for each centroid, at most
k rows, and k rows of sums reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.llm.common import stored

ROWS = 4096  # vectors tested at once
LARGEST = 1 << 27  # components below it keep every product and distance of 64 components in 64 bits
EXACT = 1 << 22  # components up to it keep them in the 53 bits of a double


def quantised(column: pa.Array, dim: int, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors have ``dim`` finite components in range, and their floor(levels * x) as int32 rows."""
    right = np.asarray(pc.fill_null(pc.equal(pc.list_value_length(column), dim), False))
    x = column.filter(pa.array(right)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.floor(levels * x)
        fits = (np.abs(x) < LARGEST).all(axis=1)  # false for nulls, which read as nan
    kept = np.zeros(len(column), bool)
    kept[np.flatnonzero(right)[fits]] = True
    return kept, x[fits].astype(np.int32)


class Bisectors:
    """Normals and thresholds of all ordered pairs of centroids."""

    def __init__(self, centres: np.ndarray):
        self.centres = centres.astype(np.int64)
        self.normals = self.centres[None, :, :] - self.centres[:, None, :]
        norms = (self.centres ** 2).sum(axis=1)
        self.thresholds = norms[None, :] - norms[:, None]
        self.largest = int(np.abs(self.centres).max(initial=0))
        self.doubles = self.normals.astype(np.float64)

    def winners(self, x: np.ndarray) -> np.ndarray:
        """The number of the nearest centroid of each row of int64 vectors."""
        small = max(self.largest, int(np.abs(x).max(initial=0))) <= EXACT and x.shape[1] <= 64
        x, normals = (x.astype(np.float64), self.doubles) if small else (x, self.normals)
        won = np.zeros(len(x), np.int64)
        for j in range(1, len(self.centres)):
            side = 2 * np.einsum("nd,nd->n", x, normals[won, j]) - self.thresholds[won, j]
            won[side > 0] = j
        return won

    def distances(self, x: np.ndarray, won: np.ndarray) -> np.ndarray:
        return ((x - self.centres[won]) ** 2).sum(axis=1)


def rows_of(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            data = b"".join(part.column("vector").to_pylist())
            yield part, np.frombuffer(data, np.int32).reshape(-1, dim).astype(np.int64)


def totals(centres: np.ndarray, dim: int) -> Callable:
    """A task's count and component sums for each centroid that won a vector."""
    def run(batches):
        planes, count, sums = Bisectors(centres), np.zeros(len(centres), np.int64), np.zeros((len(centres), dim), np.int64)
        for _, x in rows_of(batches, dim):
            won = planes.winners(x)
            count += np.bincount(won, minlength=len(centres))
            np.add.at(sums, won, x)
        own = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(own, pa.int32()), "n": pa.array(count[own]),
                                          "sums": pa.array(sums[own].tolist(), pa.list_(pa.int64()))})
    return run


def assignments(centres: np.ndarray, dim: int) -> Callable:
    def run(batches):
        planes = Bisectors(centres)
        for part, x in rows_of(batches, dim):
            won = planes.winners(x)
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(won, pa.int32()), pa.array(planes.distances(x, won))],
                                             ["vec_id", "cluster", "distance"])
    return run


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, levels: int = 256, seed: str = "2",
            id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) of every kept vector, and the final centroids.

    Kept are vectors of exactly ``dim`` components (64 at most) that are neither null nor non-finite, each turned
    into the integer floor(levels * x). Vectors with a component of 2^27 or more after that take no part either: their distances
    need not fit 64 bits. The ``k`` first centroids are the kept vectors with the smallest sha256 of ``seed:vec_id``
    (null ids last; equal hashes, which repeated ids have, by id and then by components). An equally near centroid of smaller number wins, a
    centroid without vectors stays as it is. Repeated rows and null ids are vectors like any other; fewer than ``k``
    vectors are as many centroids; an empty table gives no rows. Other columns are not read.
    """
    if not 1 <= dim <= 64:
        raise ValueError("dim must lie between 1 and 64")

    def tidy(batches):
        for b in batches:
            kept, x = quantised(b.column(1), dim, levels)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(kept)), pa.array([r.tobytes() for r in x], pa.binary())], ["vec_id", "vector"])

    rows = stored(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
                  .mapInArrow(tidy, "vec_id long, vector binary"), "vectors")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.withColumn("h", order).orderBy(F.asc_nulls_last("h"), "vec_id").limit(k + 1).collect()
    if len({r.h for r in first}) < len(first):  # repeated ids: their components decide
        whole = rows.withColumn("h", order).where(F.col("h").isNull() | F.col("h").isin([r.h for r in first if r.h]))
        unpacked = whole.mapInArrow(lambda batches: _components(batches, dim), "vec_id long, x array<int>, h string")
        chosen = unpacked.orderBy(F.asc_nulls_last("h"), "vec_id", "x").limit(k).collect()
        centres = np.array([r.x for r in chosen], np.int64).reshape(-1, dim)
    else:
        centres = np.array([np.frombuffer(r.vector, np.int32) for r in first[:k]], np.int64).reshape(-1, dim)
    if not len(centres):
        return rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), []
    exact = lambda c: F.sum(c.cast("decimal(38,0)"))
    for _ in range(rounds):
        sums = rows.mapInArrow(totals(centres, dim), "cluster int, n long, sums array<long>").groupBy("cluster") \
            .agg(exact(F.col("n")).alias("n"), *[exact(F.col("sums")[i]).alias(f"s{i}") for i in range(dim)])
        for r in sums.collect():  # at most k rows
            centres[r.cluster] = [int(r[f"s{i}"]) // int(r.n) for i in range(dim)]
    return stored(rows.mapInArrow(assignments(centres, dim), "vec_id long, cluster int, distance long"), "clusters"), centres.tolist()


def _components(batches, dim):
    for part, x in rows_of(batches, dim):
        yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(x.tolist(), pa.list_(pa.int32())), part.column("h")], ["vec_id", "x", "h"])


def inertia(assigned: DataFrame, centres: list[list[int]]) -> DataFrame:
    """Each vector's row with the distance summed over its cluster and over all, and a digest of its centroid."""
    spark = assigned.sparkSession
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # one row a centroid
    total = sum(int(r.s) for r in sums)
    rows = [(r.cluster, int(r.s), total, hashlib.sha256(",".join(map(str, centres[r.cluster])).encode()).hexdigest()) for r in sums]
    small = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(small), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
