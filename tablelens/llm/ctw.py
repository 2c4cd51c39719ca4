"""Context-tree weighting of bytes.

A text is its lower-cased words joined by single spaces and closed by a line feed. Every byte is eight
binary decisions; each decision has a context tree over the ``DEPTH`` bytes before it, with a
Krichevsky-Trofimov estimate at every depth, and the weighting mixes all depths.

The corpus is cut into blocks of bounded size. A block sends, for each shard of contexts, its distinct
n-grams (context and byte) with their training counts as one packed row. A shard holds all contexts
that share their last two bytes, so the trees below depth 2 live in one shard; of the two depths above,
at most 256 x 255 sums reach the driver. A shard then answers every block's n-grams with
their log-probability, and the block adds them up per document.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.llm.common import chunks, grouped, stored
from tablelens.session import scratch_path

DEPTH = 6  # bytes of context; with the byte itself an n-gram has 56 bits, and 8 number the texts it is sorted with
BLOCK = 4 << 20  # bytes of text in a block
MERGED = 2_000_000  # n-grams held before they are merged
END = b"\n"
U = np.uint64
SENT = "shard int, block long, items binary, counts binary"


# -- packed arrays ---------------------------------------------------------------------------------

def pack(values: np.ndarray) -> bytes:
    """Sorted integers: of each, how many leading bytes it shares with the one before, and its other bytes, by place."""
    own = values.astype(">u8").view(np.uint8).reshape(-1, 8)
    differs = np.ones(own.shape, bool)
    differs[1:] = own[1:] != own[:-1]
    shared = differs.argmax(axis=1).astype(np.uint8)  # none differs: 0, which sends all bytes
    return len(shared).to_bytes(8, "little") + squeeze(shared.tobytes() + b"".join(own[shared <= k, k].tobytes() for k in range(8)), 3)


def unpack(data: bytes) -> np.ndarray:
    raw, n = np.frombuffer(expand(data[8:]), np.uint8), int.from_bytes(data[:8], "little")
    shared, at = raw[:n], n
    out = np.empty((n, 8), np.uint8)
    for k in range(8):
        upto = np.cumsum(shared <= k, dtype=np.int32)  # how many were sent; the first one always is
        many = int(upto[-1]) if n else 0
        out[:, k] = raw[at:at + many][upto - 1]
        at += many
    return out.view(">u8").ravel().astype(np.uint64)


def pack_counts(values: np.ndarray) -> bytes:
    """Integers, byte planes apart."""
    return squeeze(values.astype(np.uint64).view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack_counts(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(expand(data), np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


def pack_logs(values: np.ndarray) -> bytes:
    """Logarithms as 24 bits of a float (15 of its fraction), rounded: within a relative 2e-5 each, without a direction."""
    bits = (values.astype(np.float32).view(np.uint32) + np.uint32(128)) >> np.uint32(8)
    return squeeze(bits.view(np.uint8).reshape(-1, 4)[:, :3].T.tobytes())


def unpack_logs(data: bytes) -> np.ndarray:
    planes = np.frombuffer(expand(data), np.uint8).reshape(3, -1).astype(np.uint32)
    return ((planes[0] | planes[1] << np.uint32(8) | planes[2] << np.uint32(16)) << np.uint32(8)).view(np.float32)


def squeeze(data: bytes, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(data)


def expand(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


# -- texts and n-grams -----------------------------------------------------------------------------

def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def ngrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram of every byte of the texts, and the number of bytes of each text."""
    sizes = np.array([len(t) for t in texts], np.int64)
    joined = b"".join(END * DEPTH + t for t in texts)
    n = len(joined) - DEPTH
    # eight bytes from every place on, of which the first DEPTH + 1 are the n-gram
    g = np.ndarray((n,), ">u8", joined + bytes(8), 0, (1,)).astype(np.uint64) >> U(56 - 8 * DEPTH)
    inside = np.ones(n, bool)  # not the bytes of the next text's padding
    starts = np.cumsum(sizes + DEPTH)[:-1] - DEPTH
    for k in range(DEPTH):
        inside[starts + k] = False
    return g[inside], sizes


def shard_of(grams: np.ndarray, shards: int) -> np.ndarray:
    """By the last two bytes of the context."""
    return ((((grams >> U(8)) & U(0xFFFF)) * U(0x9E3779B97F4A7C15)) >> U(40)).astype(np.int64) % shards


def sorted_set(values: np.ndarray) -> np.ndarray:
    """The different values in order. ``np.unique`` hashes them before it sorts, which takes several times as long."""
    values = np.sort(values)
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    return values[new]


def in_shards(shard: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, places) of each shard that occurs, its places in order: one sort, however many shards there are."""
    order = np.argsort(shard.astype(np.uint16 if shards <= 1 << 16 else np.uint32), kind="stable")
    ends = np.cumsum(np.bincount(shard, minlength=shards)).tolist()
    for s, (a, b) in enumerate(zip([0, *ends], ends)):
        if a < b:
            yield s, order[a:b]


def by_shard(words: set[bytes], shards: int) -> dict[int, list[bytes]]:
    out: dict[int, list[bytes]] = {}
    for w in sorted(words):
        out.setdefault(xxhash.xxh3_64_intdigest(w) % shards, []).append(w)
    return out


# -- trees -----------------------------------------------------------------------------------------

def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series above 8, brought there by the recurrence."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    z = x + 8
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z ** 3) + 1 / (1260 * z ** 5) - shift


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1.0) - math.log(math.pi)


def weight(log_beta: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(np.clip(-log_beta, -700, 700)))


def decisions(grams: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(tree node at ``depth``, bit) of the eight binary decisions of each n-gram's byte; a node is the last
    ``depth`` bytes of context and the byte's bits so far behind a 1."""
    context = ((grams >> U(8)) & U((1 << 8 * depth) - 1)) << U(8)
    byte = grams & U(255)
    for b in range(8):
        yield context | U(1 << b) | (byte >> U(8 - b)), (byte >> U(7 - b)) & U(1)


class Trees:
    """The trees' nodes of one shard from depth ``DEPTH`` up to depth 2."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        self.levels = []
        counts, below = counts.astype(float), None
        for depth in range(DEPTH, 1, -1):
            nodes, ones, all_ = [], [], []
            for node, bit in decisions(grams, depth):
                nodes.append(node)
                ones.append(counts * bit)
                all_.append(counts)
            keys, at = np.unique(np.concatenate(nodes), return_inverse=True)
            n1 = np.bincount(at, np.concatenate(ones), len(keys))
            n = np.bincount(at, np.concatenate(all_), len(keys))
            own = log_kt(n - n1, n1)
            if below is None:
                ratio, total = None, own
            else:
                under, log_w = below
                parent = (((under >> U(8)) & U((1 << 8 * depth) - 1)) << U(8)) | (under & U(255))
                split = np.bincount(np.searchsorted(keys, parent), log_w, len(keys))
                ratio, total = weight(own - split), np.logaddexp(own, split) - math.log(2)
            self.levels.append((depth, keys, n, n1, ratio))
            below = keys, total
        keys, total = below
        _, _, n, n1, _ = self.levels[-1]
        # what depth 1 needs: summed over the second last byte
        key = (((keys >> U(8)) & U(255)) << U(8)) | (keys & U(255))
        self.above, at = np.unique(key, return_inverse=True)
        self.sums = [np.bincount(at, v, len(self.above)).astype(float) for v in (n, n1, total)]  # an empty count has whole numbers

    def log10(self, grams: np.ndarray, top: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """log10 probability of each n-gram's byte after its context."""
        out = np.zeros(len(grams))
        for steps in zip(*(decisions(grams, depth) for depth, *_ in self.levels)):
            bit = steps[0][1].astype(np.int64)
            p = np.full(len(grams), 0.5)
            for (_, keys, n, n1, ratio), (node, _) in zip(self.levels, steps):
                if not len(keys):
                    continue
                at = np.minimum(np.searchsorted(keys, node), len(keys) - 1)
                seen = keys[at] == node
                kt = (np.where(bit == 1, n1[at], n[at] - n1[at]) + 0.5) / (n[at] + 1)
                mixed = kt if ratio is None else ratio[at] * kt + (1 - ratio[at]) * p
                p = np.where(seen, mixed, 0.5)
            node = (steps[-1][0] & U(0xFFFF)).astype(np.int64)
            out += np.log10(top[0][bit, node] + top[1][node] * p)
        return out


def top_levels(keys: np.ndarray, n: np.ndarray, n1: np.ndarray, split: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Depths 1 and 0 for every (last byte, node): the probability is ``add[bit] + times * (depth 2's)``."""
    add, times = np.full((2, 65536), 0.5), np.zeros(65536)
    if not len(keys):
        return add, times
    own = log_kt(n - n1, n1)
    w1, total = weight(own - split), np.logaddexp(own, split) - math.log(2)
    node = (keys & U(255)).astype(np.int64)
    m, m1, under = (np.bincount(node, v, 256) for v in (n, n1, total))
    w0 = weight(log_kt(m - m1, m1) - under)
    for bit in (0, 1):
        kt0 = ((m1 if bit else m - m1) + 0.5) / (m + 1)
        every = np.arange(65536) & 255
        add[bit] = np.where(m[every] > 0, w0[every] * kt0[every] + (1 - w0[every]) * 0.5, 0.5)
        kt1 = ((n1 if bit else n - n1) + 0.5) / (n + 1)
        add[bit, keys.astype(np.int64)] = w0[node] * kt0[node] + (1 - w0[node]) * w1 * kt1
    times[keys.astype(np.int64)] = (1 - w0[node]) * (1 - w1)
    return add, times


def merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    grams, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    return grams, np.bincount(at, np.concatenate([n for _, n in parts]).astype(float), len(grams)).astype(np.uint64)


# -- Spark jobs ------------------------------------------------------------------------------------

def batch(names: list[str], kinds: list, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def cut(batches: Iterator[pa.RecordBatch], shards: int, word_shards: int, block_bytes: int) -> Iterator[pa.RecordBatch]:
    """Blocks: the block itself, its n-grams by shard and its words by shard, each as packed rows."""
    names = ["kind", "shard", "block", "items", "counts"]
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
    base, k = TaskContext.get().partitionId() << 32, 0
    for rows in chunks(batches, "text", block_bytes):
        ids, held, texts = (rows.column(c) for c in ("doc_id", "held_out", "text"))
        held = np.asarray(held.to_pylist(), bool)
        split = [tokens(t) for t in texts.to_pylist()]
        flat = [b" ".join(w) + END for w in split]
        block, k = base + k, k + 1
        sink = pa.BufferOutputStream()
        plain = pa.RecordBatch.from_arrays([ids, pa.array(held), pa.array(flat, pa.large_binary())], ["doc_id", "held_out", "text"])
        with pa.ipc.new_stream(sink, plain.schema) as out:
            out.write_batch(plain)
        grams, sizes = ngrams(flat)
        marked, n = np.unique((grams << U(1)) | np.repeat(held, sizes).astype(np.uint64), return_counts=True)
        grams = marked >> U(1)
        first = np.flatnonzero(np.diff(grams, prepend=grams[0] + U(1)))
        counts = np.add.reduceat(np.where(marked & U(1), 0, n), first)
        grams, shard = grams[first], shard_of(grams[first], shards)
        made = [("blocks", 0, block, squeeze(sink.getvalue().to_pybytes(), 3), b"")]
        for s, own in in_shards(shard, shards):
            made.append(("grams", s, block, pack(grams[own]), pack_counts(counts[own])))
        learned: Counter = Counter()
        for w, h in zip(split, held):
            if not h:
                learned.update(w)
                learned[END] += 1
        every = set().union(*split)
        every.add(END)
        for s, own in by_shard(every, word_shards).items():
            made.append(("words", s, block, squeeze(b" ".join(own), 3), pack_counts(np.array([learned[w] for w in own]))))
        yield batch(names, kinds, made)


def learn(key, rows) -> Iterator[pa.RecordBatch]:
    """The training counts of a shard's n-grams, merged."""
    held, size, shard = [], 0, key[0] if isinstance(key, tuple) else key
    for *_, items, counts in rows:
        grams, n = unpack(items), unpack_counts(counts)
        held.append((grams[n > 0], n[n > 0]))
        size += len(held[-1][0])
        if size > MERGED:
            held = [merge(held)]
            size = 0
    grams, n = merge(held)
    yield batch(["shard", "block", "items", "counts"], [pa.int32(), pa.int64(), pa.binary(), pa.binary()],
                [(shard, -1, pack(grams), pack_counts(n))])


def score(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text",
          block_bytes: int = BLOCK, spread: int = 256) -> DataFrame:
    """Per row: the text's log10 probability under the tree weighting and under add-one word counts.

    Both learn from the rows where ``held_out`` (a column over ``doc_id``; null counts as false) does not hold.
    Null and empty texts are the end alone; repeated rows count and are scored each; a null id
    stays null; an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")) \
        .select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    shards = max(4, min(blocks, math.isqrt(256 * blocks)))  # a block has a row a shard: both grow with the root
    word_shards = max(4, blocks)
    salts = -(-blocks // spread)  # a shard's rows are handled in this many parts, and its model is sent to each
    path = scratch_path(spark, "ctw")
    rows.mapInArrow(lambda b: cut(b, shards, word_shards, block_bytes), "kind string, " + SENT).write.partitionBy("kind").parquet(path)
    read = lambda kind: spark.read.schema(SENT).parquet(f"{path}/kind={kind}") if size_of(spark, path, kind) else spark.createDataFrame([], SENT)
    salted = read("grams").withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int")).select("salt", "shard", "block", "items", "counts")

    # the model: counts merged in two steps, the trees' sums for the two upper depths
    first = grouped(salted.select("shard", "salt", "block", "items", "counts"), learn, SENT, "shard", "salt")
    model = stored(grouped(first, learn, SENT, "shard"), "ctw-model")
    ends = stored(model.select("shard", "items", "counts").mapInArrow(upper, "node long, n double, n1 double, split double"), "ctw-top")
    top = ends.groupBy("node").agg(*[F.sum(c).alias(c) for c in ("n", "n1", "split")]).orderBy("node").collect()  # <= 256 * 255 rows
    upper_levels = top_levels(np.array([r.node for r in top], np.uint64), *[np.array([r[c] for r in top], float) for c in ("n", "n1", "split")])

    # answers to the blocks
    copies = model.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    asked = copies.select("salt", "shard", "block", "items", "counts").unionByName(salted.withColumn("counts", F.lit(b"")))
    answers = grouped(asked, lambda key, own: answer(key, own, upper_levels), "block long, shard int, kind int, items binary", "salt", "shard", order=("block",))
    known = stored(grouped(read("words"), count_words, "block long, shard int, kind int, items binary, total long, known long", "shard"), "ctw-words")
    total, distinct = known.where("block < 0").agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("known"), F.lit(0))).first()
    whole = read("blocks").select("block", F.lit(0).alias("shard"), F.lit(0).alias("kind"), "items")
    joined = whole.unionByName(answers).unionByName(known.where("block >= 0").select("block", "shard", "kind", "items"))
    return grouped(joined, lambda block, own: finish(own, shards, word_shards, total, distinct),
                   "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long",
                   "block", order=("kind", "shard"))


def size_of(spark, path: str, kind: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/kind={kind}")
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def upper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for items, counts in zip(b.column("items").to_pylist(), b.column("counts").to_pylist()):
            trees = Trees(unpack(items), unpack_counts(counts))
            yield pa.RecordBatch.from_arrays([pa.array(trees.above.astype(np.int64)), *map(pa.array, trees.sums)], ["node", "n", "n1", "split"])


def answer(key, rows, top) -> Iterator[pa.RecordBatch]:
    """The log-probabilities of the n-grams of each block; the shard's model (block -1) comes first."""
    _, shard = key
    _, _, _, items, counts = next(rows)
    trees = Trees(unpack(items), unpack_counts(counts))
    waiting, size = [], 0

    def flush():
        every = sorted_set(np.concatenate([g for _, g in waiting]))
        p = trees.log10(every, top).astype(np.float32)
        return batch(["block", "shard", "kind", "items"], [pa.int64(), pa.int32(), pa.int32(), pa.binary()],
                     [(block, shard, 1, pack_logs(p[np.searchsorted(every, g)])) for block, g in waiting])

    for _, _, block, items, _ in rows:
        waiting.append((block, unpack(items)))
        size += len(waiting[-1][1])
        if size > MERGED // 4:
            yield flush()
            waiting, size = [], 0
    if waiting:
        yield flush()


def count_words(shard: int, rows) -> Iterator[pa.RecordBatch]:
    """The corpus counts of the words of each block: first all rows are added up, then answered."""
    asked, counts = [], Counter()
    for _, block, items, n in rows:
        words = expand(items).split(b" ")
        for w, c in zip(words, unpack_counts(n).tolist()):
            if c:
                counts[w] += c
        asked.append((block, items))
    names = ["block", "shard", "kind", "items", "total", "known"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64()]
    yield batch(names, kinds, [(-1, shard, 2, b"", sum(counts.values()), len(counts))])
    for block, items in asked:
        n = np.array([counts[w] for w in expand(items).split(b" ")], np.uint64)
        yield batch(names, kinds, [(block, shard, 2, pack_counts(n), 0, 0)])


def finish(rows, shards: int, word_shards: int, total: int, distinct: int) -> Iterator[pa.RecordBatch]:
    """Per document of a block: word counts and the sum of its bytes' log-probabilities."""
    block, _, _, items = next(rows)
    with pa.ipc.open_stream(expand(items)) as source:
        docs = source.read_all()
    texts = docs.column("text").to_pylist()
    grams, sizes = ngrams(texts)
    split = [t[:-1].split(b" ") if len(t) > 1 else [] for t in texts]
    words = by_shard(set().union(*split) | {END}, word_shards)
    # n-grams are sorted with the number of their text in the bits they leave free, so many texts at once
    free, sums, starts = 64 - 8 * (DEPTH + 1), np.zeros(len(texts)), np.append(0, np.cumsum(sizes))
    parts = []
    for a in range(0, len(texts), 1 << free):
        own = sizes[a:a + (1 << free)]
        both = np.sort((grams[starts[a]:starts[a + len(own)]] << U(free)) | np.repeat(np.arange(len(own), dtype=np.uint64), own))
        new = np.flatnonzero(np.diff(both >> U(free), prepend=~both[0] >> U(free)))
        parts.append((a, both[new] >> U(free), np.diff(np.append(new, len(both))), (both & U((1 << free) - 1)).astype(np.uint16)))
    del grams
    every = sorted_set(np.concatenate([g for _, g, *_ in parts]))
    within, p = dict(in_shards(shard_of(every, shards), shards)), np.zeros(len(every), np.float32)
    base, unseen = {}, math.log10(1 / (total + distinct + 1))
    for _, s, kind, items in rows:
        if kind == 1:
            p[within[s]] = unpack_logs(items)
        else:
            base.update((w, math.log10((c + 1) / (total + distinct + 1)) if c else None) for w, c in zip(words[s], unpack_counts(items).tolist()))
    for a, g, places, text in parts:
        own = np.bincount(text, np.repeat(p[np.searchsorted(every, g)].astype(float), places))
        sums[a:a + len(own)] = own
    n_known, score_base = [], []
    for w in split:
        values = [base[x] for x in w]
        values.append(base[END])
        missing = values.count(None)
        n_known.append(len(values) - missing)
        score_base.append(math.fsum(v for v in values if v is not None) + missing * unseen)
    n = pa.array([len(w) + 1 for w in split], pa.int64())
    yield pa.RecordBatch.from_arrays([
        docs.column("doc_id").combine_chunks(), docs.column("held_out").combine_chunks(), n, pa.array(n_known, pa.int64()),
        pa.array([total] * len(split), pa.int64()), pa.array(score_base, pa.float64()), pa.array(sums), pa.array(sizes)],
        ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes"])
