"""Best-fit packing of token sequences by exact complements.

Documents become token ids plus an end id; a document longer than the capacity is cut
into whole-capacity pieces with the shorter piece first. Only the histogram of piece
lengths (at most ``capacity`` rows, whatever the corpus) reaches the driver, where
:func:`plan` decides how many sequences of which length combination to make. Spark
then numbers the pieces of each length and joins them to the combinations.
"""

from __future__ import annotations

import functools
import os
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablelens.llm.common import parts, stored

# Fixed value: the byte-level pre-tokenizer's published pattern.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class PieceIds(dict):
    """Space-led word -> its token ids as little-endian uint32 bytes; at most ``limit`` words."""

    def __init__(self, encode, limit: int = 400_000):
        super().__init__()
        self.encode, self.limit = encode, limit

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = self.encode(" " + word)
        return value


def byte_of_symbol() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 characters stand for themselves, the other bytes,
    in order, for the characters from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


@functools.lru_cache(maxsize=1)
def encoder(tokenizer_path: str):
    """text -> token ids as uint32 bytes, those that the tokenizer gives for the whole text.

    The byte-level pre-tokenizer starts a new piece at every single space that stands
    between two other characters, so such a text is encoded word by word through a
    bounded cache, by the tokenizer's own vocabulary (a token's id is the order of its merge).
    A text with doubled spaces or with the text of a special token goes to the tokenizer whole.
    Kept for the tasks that follow in the same worker.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import tiktoken
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(tokenizer_path)
    specials = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    byte = byte_of_symbol()
    ranks = {bytes(byte[c] for c in token): i for token, i in tokenizer.get_vocab(with_added_tokens=False).items()
             if token not in specials}
    merges = tiktoken.Encoding("words", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={})

    def words(text: str) -> bytes:
        return array("I", merges.encode_ordinary(text)).tobytes()

    cache = PieceIds(words)

    def encode(text: str) -> bytes:
        if "  " in text or any(s in text for s in specials):
            return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        head, *rest = text.split(" ")
        return words(head) + b"".join(map(cache.__getitem__, rest))

    return encode


def tokenise(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int,
             id_col: str, text_col: str) -> DataFrame:
    """One row per piece: (doc_id, piece, start, length, ids_crc32)."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                out: list[tuple] = []
                for doc, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                    ids = encode(text or "") + end
                    n, first = len(ids) // 4, (len(ids) // 4) % capacity or capacity
                    cuts = [0, *range(first, n + 1, capacity)]
                    out += [(doc, k, a, b - a, zlib.crc32(ids[4 * a:4 * b]))
                            for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
                doc, piece, start, length, crc = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                     pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.col(text_col).cast("string").alias("text")).mapInArrow(run, PIECES)


def complement(counts: np.ndarray, gap: int) -> tuple[int, ...]:
    """Available lengths that sum to exactly ``gap``: one, else two, else three, the longest first; or ()."""
    def pair(total: int) -> tuple[int, ...]:
        longer = np.arange(total - 1, (total + 1) // 2 - 1, -1)
        shorter = total - longer
        ok = (counts[longer] > 0) & (counts[shorter] > (longer == shorter))
        at = int(ok.argmax()) if len(ok) else 0
        return (int(longer[at]), int(shorter[at])) if len(ok) and ok[at] else ()

    if counts[gap]:
        return (gap,)
    if hit := pair(gap):
        return hit
    for n in np.flatnonzero(counts[:gap])[::-1].tolist():
        if 3 * n < gap:
            break
        counts[n] -= 1
        hit = pair(gap - n)
        counts[n] += 1
        if hit and hit[0] <= n:
            return (n, *hit)
    return ()


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[Counter, int]]:
    """Combinations of lengths ({length: copies}) and how often each is made; every piece once.

    From the longest length down, what a sequence still lacks is looked up among the single,
    pair and triple sums of the lengths available. A combination that fills it exactly is made
    as often as the counts allow. Where no exact complement exists, the best-fitting (longest
    fitting) length is added and the rest of the gap looked up again. Each combination
    runs a length out, so the plan's size depends on the capacity, not on the corpus.
    """
    counts = np.zeros(capacity + 1, np.int64)
    for n, c in histogram.items():
        counts[n] = c
    made: list[tuple[Counter, int]] = []
    for n in range(capacity, 0, -1):
        while counts[n]:
            combo, gap, lent = Counter([n]), capacity - n, counts.copy()
            lent[n] -= 1
            while gap:
                fitting = complement(lent, gap)
                if not fitting:
                    below = np.flatnonzero(lent[:gap + 1])
                    if not len(below):
                        break
                    fitting = (int(below[-1]),)
                for m in fitting:
                    combo[m] += 1
                    lent[m] -= 1
                    gap -= m
            times = min(int(counts[m]) // k for m, k in combo.items())
            for m, k in combo.items():
                counts[m] -= times * k
            made.append((combo, times))
    return made


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sequences of at most ``capacity`` tokens: one row per piece with its sequence and offset.

    Null and empty texts are the end id alone. Rows that repeat a doc_id are packed as rows of
    their own; a null doc_id stays null; an empty table gives no rows. Columns other than the
    two named ones are not read, so clashing names don't matter.
    """
    pieces = stored(tokenise(docs, tokenizer_path, capacity, end_id, id_col, text_col), "pieces")
    spark = docs.sparkSession
    # pieces of one length are numbered in two steps, so that a length held by a third of the rows is
    # spread: rank within (length, spread), then the offset of that spread within the length
    spreads = max(64, parts(docs))
    keyed = pieces.withColumn("spread", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(spreads)).cast("int"))
    sizes = keyed.groupBy("length", "spread").agg(F.count("*").alias("n"))
    before = stored(sizes.withColumn("before", F.sum("n").over(
        Window.partitionBy("length").orderBy("spread").rowsBetween(Window.unboundedPreceding, -1))), "lengths")
    counts = {r.length: r.n for r in before.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots, base, used = [], 0, Counter()
    for combo, times in plan(counts, capacity):
        offset = 0
        for n, copies in combo.items():
            slots.append((n, used[n], used[n] + times * copies, base, offset, copies))
            used[n] += times * copies
            offset += n * copies
        base += times
    # at most a few rows per combination: bounded by the capacity, not by the corpus
    slots = spark.createDataFrame(slots, "length long, lo long, hi long, base long, offset long, copies long") \
        .groupBy("length").agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "base", "offset", "copies"))).alias("slots"))
    ranked = keyed.withColumn("rank", F.row_number().over(
        Window.partitionBy("length", "spread").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    placed = (ranked.join(before.select("length", "spread", "before"), ["length", "spread"])
              .withColumn("rank", F.col("rank") + F.coalesce("before", F.lit(0)))
              .join(F.broadcast(slots), "length")
              .withColumn("slot", F.element_at(F.filter("slots", lambda s: (s.lo <= F.col("rank")) & (F.col("rank") < s.hi)), 1)))
    nth, copies = F.col("rank") - F.col("slot.lo"), F.col("slot.copies")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32",
                         (F.col("slot.base") + F.floor(nth / copies)).cast("long").alias("sequence_id"),
                         (F.col("slot.offset") + nth % copies * F.col("length")).cast("long").alias("offset"))
