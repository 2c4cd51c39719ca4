"""Near-duplicate documents by MinHash with sequential Bayesian verification.

Every document becomes a set of word shingles and a signature of ``BANDS * ROWS`` min-hashes, of
which the low bytes are kept. Documents with equal sets are one node from then on. Nodes that agree on
a whole band are candidates. Candidates' signatures are compared in batches; a pair goes as soon as the
posterior probability of the wanted similarity falls below ``MISS``. The last batch compares the sets' parity
bits, which differ in no more places than the sets differ in shingles. Survivors are verified on the whole
shingle sets.

No bucket is expanded into all its pairs: first each member meets its bucket's smallest node. Verified links
give components, and only pairs of different components are compared further, in chunks of bounded
size, first in a pass that is linear in the bucket, at last all that are still of different ones.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.llm.common import WordHashes, chunks, components, digest, grouped, shingles, stored

BANDS, ROWS = 40, 5  # a pair of similarity 0.75 shares no band with probability (1 - 0.75^5)^40 = 2e-5
MISS = 1e-5
CHUNK = 256  # members of a bucket compared with each other in one group of the linear pass
WHOLE_CHUNK = 1024  # members of each side compared in one group of the whole pass; larger chunks meet fewer others
LEADERS, BEST = 24, 3
PARITY = 1024  # bits: bit k is the parity of the number of shingles whose hash falls on k
SIGMAS = 4.3  # a normal variable exceeds so many deviations with probability MISS
HASHED, WIDTH = BANDS * ROWS, BANDS * ROWS + PARITY // 8 + 4  # a signature: min-hash bytes, parity bits, set size
PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_random = np.random.default_rng(20240229)
FACTOR = (_random.integers(0, 2**32, BANDS * ROWS, np.uint64).astype(np.uint32) | np.uint32(1))[:, None]
FLIP = _random.integers(0, 2**32, BANDS * ROWS, np.uint64).astype(np.uint32)[:, None]


def signature(hashes: np.ndarray) -> np.ndarray:
    """Low bytes of the min-hashes of a non-empty set of 64-bit hashes, its parity bits and its size."""
    h = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 2**32 - 1, np.uint32)
    for at in range(0, len(h), 1024):
        np.minimum(least, ((h[None, at:at + 1024] ^ FLIP) * FACTOR).min(axis=1), out=least)
    # the product's low bits repeat those of the hash: mix before cutting to a byte
    low = ((least ^ (least >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(24)).astype(np.uint8)
    odd = np.bincount((hashes % np.uint64(PARITY)).astype(np.int64), minlength=PARITY) & 1
    return np.concatenate([low, np.packbits(odd.astype(np.uint8)), np.array([len(hashes)], "<u4").view(np.uint8)])


def most_odd(sizes: np.ndarray, percent: int) -> np.ndarray:
    """Most parity bits in which two sets of ``sizes`` shingles together may differ at the wanted similarity.

    At most d = sizes * (100 - percent) / (100 + percent) shingles are in one of them only, so never more than d bits
    differ; of many shingles some meet in a bit, and more than the mean by SIGMAS deviations differ with probability MISS."""
    d = sizes * (100 - percent) / (100 + percent)
    p = (1 - (1 - 2 / PARITY) ** d) / 2
    return np.minimum(d, PARITY * p + SIGMAS * np.sqrt(PARITY * p * (1 - p)))


def keep_from(similarity: float, miss: float = MISS) -> list[int]:
    """Least number of equal bytes after each batch of BANDS bytes, under a uniform prior.

    Two bytes agree with probability s + (1 - s) / 256 at similarity s."""
    s = (np.arange(4000) + 0.5) / 4000
    p = s + (1 - s) / 256
    out = []
    for n in range(BANDS, BANDS * ROWS + 1, BANDS):
        m = np.arange(n + 1)[:, None]
        log = m * np.log(p) + (n - m) * np.log1p(-p)
        weight = np.exp(log - log.max(axis=1, keepdims=True))
        posterior = weight[:, s >= similarity].sum(axis=1) / weight.sum(axis=1)
        out.append(int((posterior >= miss).argmax()))
    return out


def survivors(x: np.ndarray, y: np.ndarray, least: list[int], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the signature matrices that pass every batch, and their number of equal bytes."""
    rows, equal = np.arange(len(x)), np.zeros(len(x), np.int64)
    for k, need in enumerate(least):
        at = slice(k * BANDS, (k + 1) * BANDS)
        equal = equal + (x[rows, at] == y[rows, at]).sum(axis=1)
        stay = equal >= need
        rows, equal = rows[stay], equal[stay]
    u, v = x[rows], y[rows]
    odd = np.bitwise_count(u[:, HASHED:-4] ^ v[:, HASHED:-4]).sum(axis=1, dtype=np.int64)
    sizes = sum(np.ascontiguousarray(m[:, -4:]).view("<u4")[:, 0].astype(np.int64) for m in (u, v))
    stay = odd <= most_odd(sizes, percent)
    return rows[stay], equal[stay]


def matrix(signatures: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(signatures), np.uint8).reshape(-1, WIDTH)


def sketch(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, digest, signature); no digest without words or id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in chunks(batches, "text", 8 << 20):
            n, d, s = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = shingles(text, width, words)
                n.append(len(own))
                use = len(own) and doc is not None
                d.append(digest(own.tobytes()) if use else None)
                s.append(signature(own).tobytes() if use else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(d, pa.binary()), pa.array(s, pa.binary())],
                                             ["doc_id", "n_shingles", "digest", "signature"])
    return docs.mapInArrow(run, "doc_id long, n_shingles long, digest binary, signature binary")


def prune(pairs: DataFrame, nodes: DataFrame, least: list[int], percent: int) -> DataFrame:
    """Pairs (a, b) whose signatures pass the sequential test."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, _ = survivors(matrix(batch.column(2).to_pylist()), matrix(batch.column(3).to_pylist()), least, percent)
            yield batch.select([0, 1]).take(pa.array(rows))
    sides = [nodes.select(F.col("node").alias(c), F.col("signature").alias(f"s{c}")) for c in "ab"]
    return pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def verify(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs whose whole shingle sets have 100 * intersection >= percent * union."""
    pairs = stored(pairs.distinct(), "pairs")
    wanted = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in chunks(batches, "text", 8 << 20):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(
                [shingles(t, width, words).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], ["doc_id", "own"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stay = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                stay.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(stay, pa.bool_()))

    own = stored(docs.join(wanted, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(sets, "doc_id long, own binary"), "sets")
    sides = [own.select(F.col("doc_id").alias(c), F.col("own").alias(f"s{c}")) for c in "ab"]
    return pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def across(members: DataFrame, nodes: DataFrame, found: DataFrame, least: list[int], percent: int, whole: bool) -> DataFrame:
    """Surviving pairs of different components within a bucket (its leader has met all members already).

    A first pass is linear in the bucket: it is cut into chunks by a hash, about LEADERS of its members visit
    every chunk, and each node keeps its BEST most similar partners. The ``whole`` pass then compares every pair
    of different components that is left: a bucket of at most WHOLE_CHUNK members in one group; in a larger one the
    chunks of all but the largest component meet each other and those of the largest one. A pair is compared only
    in the first band that it shares."""
    rest = members.where("node <> leader").select("key", "band", "node") \
        .join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = rest.groupBy("key", "band", "component").agg(F.count("*").alias("n")).groupBy("key", "band") \
        .agg(F.sum("n").alias("n"), F.max("n").alias("top"), F.max_by("component", F.struct("n", "component")).alias("major"), F.count("*").alias("kinds")) \
        .where("kinds > 1").drop("kinds")
    here = rest.join(mixed, ["key", "band"])
    columns = ["key", "band", "kind", "i", "j", "side", "node", "component"]
    pick = lambda n, seed: F.pmod(F.xxhash64("node", "band", F.lit(seed)), n).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    if whole:
        others, majors = (F.greatest(F.lit(1), F.ceil(n / WHOLE_CHUNK)).cast("int") for n in (F.col("n") - F.col("top"), F.col("top")))
        once = here.where(F.col("n") <= WHOLE_CHUNK).withColumn("i", F.lit(0)).withColumn("j", F.lit(0)) \
            .withColumn("kind", F.lit(0)).withColumn("side", F.lit(0))
        cut = here.where(F.col("n") > WHOLE_CHUNK)
        small = cut.where("component <> major").withColumn("mine", pick(others, 1))
        alike = small.where("n - top > 1").withColumn("other", upto(others)).withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other")) \
            .withColumn("kind", F.when(F.col("i") == F.col("j"), 0).otherwise(1)).withColumn("side", (F.col("mine") == F.col("j")).cast("int"))
        large = cut.where("component = major").withColumn("i", pick(majors, 1)).withColumn("j", upto(others)) \
            .withColumn("kind", F.lit(2)).withColumn("side", F.lit(0))
        visits = small.withColumn("i", upto(majors)).withColumn("j", F.col("mine")).withColumn("kind", F.lit(2)).withColumn("side", F.lit(1))
        dealt = once.select(*columns).unionByName(alike.select(*columns)).unionByName(large.select(*columns)).unionByName(visits.select(*columns))
    else:
        cut = F.ceil(F.col("n") / CHUNK).cast("int")
        own = here.withColumn("i", pick(cut, 1)).withColumn("side", F.lit(0))
        visits = own.where(pick(F.col("n"), 2) < LEADERS).withColumn("home", F.col("i")).withColumn("i", upto(cut)) \
            .where("i <> home").withColumn("side", F.lit(1))
        dealt = own.withColumn("j", F.lit(0)).withColumn("kind", F.lit(0)).select(*columns) \
            .unionByName(visits.withColumn("j", F.lit(0)).withColumn("kind", F.lit(0)).select(*columns))

    def run(key, rows) -> Iterator[pa.RecordBatch]:
        own = list(rows)
        _, band, kind, _, _ = key
        side, node, component = (np.array([r[c] for r in own], np.int64) for c in (5, 6, 7))
        signatures = matrix([r[8] for r in own])
        bands = signatures[:, :HASHED].reshape(len(own), BANDS, ROWS)
        found = []
        for at in range(len(own)):
            ok = (component != component[at]) & (node > node[at])
            if kind:
                ok &= side != side[at]
            elif not whole and side[at]:
                ok &= side == 0
            other = np.flatnonzero(ok)
            if whole and len(other):
                equal = (bands[other] == bands[at]).all(axis=2)
                other = other[equal[:, band] & ~equal[:, :band].any(axis=1)]
            rows_, n = survivors(np.broadcast_to(signatures[at], (len(other), WIDTH)), signatures[other], least, percent)
            found += [(int(m), at, int(o)) for m, o in zip(n, other[rows_])]
        if not whole:
            met, kept = Counter(), []
            for m, x, y in sorted(found, reverse=True):
                if met[x] < BEST or met[y] < BEST:
                    kept.append((m, x, y))
                    met.update((x, y))
            found = kept
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(node[[x for _, x, _ in found]]), pa.array(node[[y for *_, y in found]])], schema=PAIRS)

    dealt = dealt.join(nodes.select("node", "signature"), "node").select(*columns, "signature")
    return grouped(dealt, run, "a long, b long", "key", "band", "kind", "i", "j")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row.

    Documents link when their sets of distinct ``width``-word shingles (the whole sequence, if shorter)
    have 100 * intersection >= percent * union. ``component_id`` is the smallest id reachable. Null and
    empty texts link with nothing; rows that repeat an id are the same document; a null id takes no part: its component is
    null and ``kept`` false; an empty table gives no rows; other columns are not read.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketches = stored(sketch(docs, width), "sketches")
    nodes = stored(sketches.where("digest is not null").groupBy("digest")
                   .agg(F.min("doc_id").alias("node"), F.min("signature").alias("signature")), "nodes")
    least = keep_from(percent / 100)

    bands = nodes.select("node", F.explode(F.array(*[
        F.struct(F.lit(b).alias("band"), F.xxhash64(F.substring("signature", b * ROWS + 1, ROWS)).alias("key"))
        for b in range(BANDS)])).alias("at")).select("node", "at.band", "at.key")
    shared = bands.groupBy("key", "band").agg(F.min("node").alias("leader"), F.count("*").alias("n")).where("n > 1")
    members = stored(bands.join(shared.drop("n"), ["key", "band"]), "members")

    links = stored(verify(prune(members.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(),
                                nodes, least, percent), docs, width, percent), "links")
    for whole in (False, True):
        found = stored(components(links), "components")
        links = stored(links.unionByName(verify(across(members, nodes, found, least, percent, whole), docs, width, percent)), "links")
    found = components(links)
    classes = nodes.select("digest", "node").join(found, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    component = F.coalesce("component", "doc_id")
    return sketches.drop("signature").join(classes, "digest", "left") \
        .select("doc_id", "n_shingles", component.alias("component_id"),
                F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))
