"""Helpers shared by the corpus operators: scratch tables, word and shingle hashing, link components."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.session import scratch_path

# The ASCII letters that are lower-cased, and the word separators of byte-wise
# splitting (bytes.split() splits on exactly these: space and \x09-\x0D).
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared checkpoint folder and read it back.

    Cuts lineage: a lost executor only re-reads shared files."""
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remainder(doc_id: Column, by: int) -> Column:
    """crc32(doc_id as text) mod ``by``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % by


def lowered(text: Column) -> Column:
    """A-Z lower-cased, all else untouched; null becomes empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Re-cut record batches so that ``column`` holds at most ``limit`` bytes per piece
    (a single longer value stays whole); bounds a Python worker's memory."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
        start = taken = 0
        for i, n in enumerate(sizes.tolist()):
            if taken and taken + n > limit:
                yield batch.slice(start, i - start)
                start, taken = i, 0
            taken += n
        if start < batch.num_rows:
            yield batch.slice(start)


def grouped(df: DataFrame, run, schema: str, *keys: str, order: tuple[str, ...] = ()) -> DataFrame:
    """Rows of equal ``keys`` in one stream each, one after another: run(key, rows) -> rows, without holding a group."""
    fields = df.columns

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(*[b.column(f).to_pylist() for f in fields]))
        width, row = len(keys), next(rows, None)
        at = [fields.index(k) for k in keys]
        while row is not None:
            key, ended = tuple(row[i] for i in at), False

            def group(first=row):
                nonlocal row, ended
                yield first
                for row in rows:
                    if tuple(row[i] for i in at) != key:
                        return
                    yield row
                row, ended = None, True

            own = group()
            yield from run(key if width > 1 else key[0], own)
            for _ in own:  # what run left over
                pass

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(stream, schema)


class WordHashes(dict):
    """word (bytes) -> 64-bit hash, remembered for at most ``limit`` words."""

    def __init__(self, limit: int = 200_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: str | None, width: int, words: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles of a whole text.

    Fewer words than ``width``: the whole sequence is the one shingle; no words: empty."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, tokens), np.uint64, len(tokens))
    width = min(width, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k:len(h) - width + 1 + k]
        out ^= out >> np.uint64(29)
    return np.unique(out)


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable by the undirected links.

    Alternates two steps on the edge table until it stops changing: every node
    links its larger neighbours to its smallest one, then its smaller ones. A node's
    neighbours only meet in a minimum (partial aggregation) and a join, never in one
    collected group. Every round is written to the shared folder."""
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct()
    edges = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.where("u <> v").distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.greatest("v", "m").alias("p"), F.least("v", "m").alias("q")) \
            .unionByName(least.select(F.col("u").alias("p"), F.col("m").alias("q")))
        after = stored(small.where("p <> q").select(F.col("p").alias("u"), F.col("q").alias("v")).distinct(), "edges")
        # finished when every node points at a root: no node is both a source and a target, and one target each
        n, sources, chained = after.join(after.select(F.col("u").alias("w")).distinct(),
                                         F.col("v") == F.col("w"), "left") \
            .agg(F.count("*"), F.count_distinct("u"), F.count("w")).first()
        edges = after
        if n == sources and not chained:
            break
    star = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return star.unionByName(star.select(F.col("component").alias("node"), "component").distinct())
