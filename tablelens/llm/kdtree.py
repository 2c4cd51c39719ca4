"""Exact top-k by integer inner product with KD-trees per shard.

Rows are dealt to shards of bounded size. A shard's tree splits at medians and keeps tight bounding boxes; a
query walks it best-first by the largest inner product that a box allows, and stops at the first box
below its k-th score. Queries first search the shard of their own id; the k-th score found there goes
with them to all other shards.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablelens.llm.common import grouped, stored

SHARD, LEAF, BLOCK = 8192, 64, 512  # rows of a shard and of a leaf, queries bounded at once
PART = 65_536  # queries that meet a shard in one group
FOUND = "query_id long, vec_id long, score long"


def quantise(column: pa.Array, levels: int) -> list[bytes | None]:
    """floor(levels * x) of each component as int64 bytes; None for null and empty vectors, those with null or
    non-finite components, and those whose inner products could reach 2^53."""
    out = []
    for v in column.to_pylist():
        v = np.array([np.nan] if not v or None in v else v, np.float64)
        with np.errstate(over="ignore", invalid="ignore"):
            x = np.floor(levels * v)
        out.append(x.astype(np.int64).tobytes() if (np.abs(x) < (2.0 ** 53 / len(v)) ** 0.5).all() else None)
    return out


class KDTree:
    """Median splits along the widest side; node 0 is the root, and a node's rows are a slice."""

    def __init__(self, x: np.ndarray, ids: np.ndarray):
        order, self.child, self.slice, lo, hi = np.arange(len(x)), [], [], [], []
        todo = [(0, len(x))]
        spans = []
        while todo:
            start, stop = todo.pop()
            node = len(spans)
            rows = x[order[start:stop]]
            low, high = rows.min(axis=0), rows.max(axis=0)
            lo.append(low)
            hi.append(high)
            spans.append((start, stop))
            self.child.append(None)
            wide = int((high - low).argmax())
            if stop - start > LEAF and high[wide] > low[wide]:
                half = (stop - start) // 2
                order[start:stop] = order[start:stop][np.argpartition(rows[:, wide], half)]
                self.child[node] = (start + half)
                todo += [(start, start + half), (start + half, stop)]
        # children by their spans
        at = {span: k for k, span in enumerate(spans)}
        self.child = [c and (at[s, c], at[c, e]) for c, (s, e) in zip(self.child, spans)]
        self.spans, self.x, self.ids = spans, x[order].astype(float), ids[order]
        self.lo, self.hi = np.array(lo, float), np.array(hi, float)

    def search(self, q: np.ndarray, ids: np.ndarray, kth: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
        """(place of the query, id, score) of each query's best ``k`` of this shard that reach ``kth``.

        All values are whole numbers below 2^53, so the double products are exact."""
        bounds = np.maximum(q, 0) @ self.hi.T + np.minimum(q, 0) @ self.lo.T
        for at in range(len(q)):
            bound, floor = bounds[at], kth[at]
            heap, best = [(-bound[0], 0)], []  # best: (score, -id), the worst first
            while heap and -heap[0][0] >= floor:
                node = heapq.heappop(heap)[1]
                if self.child[node]:
                    for c in self.child[node]:
                        if bound[c] >= floor:
                            heapq.heappush(heap, (-bound[c], c))
                    continue
                start, stop = self.spans[node]
                score = self.x[start:stop] @ q[at]
                for r in np.flatnonzero(score >= floor).tolist():
                    entry = (score[r], -int(self.ids[start + r]))
                    if -entry[1] == ids[at]:
                        continue
                    if len(best) < k:
                        heapq.heappush(best, entry)
                    elif entry > best[0]:
                        heapq.heapreplace(best, entry)
                if len(best) == k:
                    floor = max(floor, best[0][0])
            yield from ((at, -i, int(s)) for s, i in best)


def walk(key, rows, k: int) -> Iterator[pa.RecordBatch]:
    """A shard's rows come first (kind 0), then the queries (kind 1) in bounded blocks."""
    ids, vectors, waiting, tree = [], [], [], None

    def flush():
        q = np.frombuffer(b"".join(r[-2] for r in waiting), np.int64).reshape(len(waiting), -1).astype(float)
        own = np.array([r[-3] for r in waiting], np.int64)
        kth = np.array([-np.inf if r[-1] is None else r[-1] for r in waiting])
        hits = list(tree.search(q, own, kth, k))
        at, found, score = zip(*hits) if hits else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(own[list(at)] if at else [], pa.int64()), pa.array(found, pa.int64()), pa.array(score, pa.int64())],
                                          ["query_id", "vec_id", "score"])

    for r in rows:
        if r[-4] == 0:
            ids.append(r[-3])
            vectors.append(r[-2])
            continue
        if not ids:
            return
        if tree is None:
            tree = KDTree(np.frombuffer(b"".join(vectors), np.int64).reshape(len(ids), -1), np.array(ids, np.int64))
            vectors = []
        waiting.append(r)
        if len(waiting) == BLOCK:
            yield flush()
            waiting = []
    if waiting:
        yield flush()


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, levels: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest inner products of each row for which ``is_query`` (a column
    over ``vec_id``) holds, with all rows of another id and the same length; ties go to the smaller id.

    Null and empty vectors, null or non-finite components and null ids take no part, nor do vectors of n components one
    of which reaches sqrt(2^53 / n) after scaling (11.8 million for 64 components): within that range double products are exact. Rows that repeat an id are
    candidates each, and a query id asks once (with its smallest vector); an empty table gives no rows.
    """
    def tidy(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(quantise(b.column(1), levels), pa.binary())], ["vec_id", "vector"])

    rows = stored(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"))
                  .mapInArrow(tidy, "vec_id long, vector binary").where("vec_id is not null and vector is not null")
                  .withColumn("dim", F.length("vector")), "vectors")
    sizes = rows.groupBy("dim").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("shards"),
                                    F.ceil(F.greatest(F.lit(1), F.count_if(is_query)) / PART).cast("int").alias("parts"))
    shard = F.pmod(F.xxhash64("vec_id"), F.col("shards")).cast("int")
    dealt = stored(rows.join(sizes, "dim").withColumn("shard", shard), "dealt")
    queries = dealt.where(is_query).groupBy("vec_id", "dim", "shards", "parts", "shard").agg(F.min("vector").alias("vector"))
    queries = queries.withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("parts")).cast("int"))
    kept = dealt.select("dim", "shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"),
                        "vec_id", "vector", F.lit(None).cast("double").alias("kth"))
    columns = ["dim", "shard", "part", "kind", "vec_id", "vector", "kth"]

    def search(asked: DataFrame) -> DataFrame:
        return stored(grouped(kept.unionByName(asked.select(*columns)), lambda key, own: walk(key, own, k), FOUND,
                              "dim", "shard", "part", order=("kind",)), "found")

    near = search(queries.select("dim", "shard", "part", F.lit(1).alias("kind"), "vec_id", "vector", F.lit(None).cast("double").alias("kth")))
    # a k-th score exists only where the own shard held k others
    kth = near.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("kth")).where(F.col("n") >= k)
    others = queries.join(kth.select(F.col("query_id").alias("vec_id"), "kth"), "vec_id", "left") \
        .withColumn("own", F.col("shard")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).where("shard <> own") \
        .withColumn("kind", F.lit(1))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.unionByName(search(others)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")
