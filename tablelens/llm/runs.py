"""Periodic runs of words: maximal stretches that repeat with a smallest period.

Longest common extensions (LCE) come from a difference cover: only suffixes that start at positions whose remainder mod
``V`` lies in the cover are sorted. Two positions reach sampled ones after the same few words, which are compared
directly; from there a sparse table over the sampled suffixes' common prefixes answers at once. Extensions to the left
use the same structure over the reversed words.

For every period q, the pairs (i, i + q) on the grid i = 0, q, 2q, ... are extended both ways; the grids of all periods
together have about n ln n pairs, and every run of period q with at least 2q words holds such a pair. A run shows up
again for the multiples of its period with the same ends, so the smallest period of equal ends is kept.

Documents are taken together in batches, each closed by words that occur nowhere else, so no extension leaves a document.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.llm.common import chunks

# A planar difference set; every remainder mod 31 is a difference of two of its members.
V, COVER = 31, (1, 5, 11, 24, 25, 27)
BATCH = 1 << 20  # bytes of text whose documents are searched together (a longer document goes alone)
PAIRS = 1 << 20  # grid pairs held at once
LEAST = 12  # words of a run


def _lengths(values: np.ndarray) -> np.ndarray:
    """0..n-1 for every n of ``values``, one after another."""
    ends = np.cumsum(values)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - values, values)


class Extensions:
    """Common extensions to the right of any two positions of ``words`` (numbers from 0)."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        # past the end: numbers that occur nowhere else
        self.words = np.concatenate([words, words.max(initial=0) + 1 + np.arange(2 * V)])
        cover = np.array(COVER)
        self.slot = np.full(V, -1)
        self.slot[cover] = np.arange(len(cover))
        # step[i mod V, j mod V]: the smallest number of words after which both positions are sampled
        steps = np.array([[min(d for d in range(V) if (i + d) % V in COVER and (j + d) % V in COVER) for j in range(V)] for i in range(V)])
        self.step = steps
        at = (np.arange(0, n + V, V)[:, None] + cover[None, :]).ravel()
        self.at = at[at < n + V]
        self._sort()

    def _index(self, position: np.ndarray) -> np.ndarray:
        """Number of a sampled position among the sampled ones."""
        return position // V * len(COVER) + self.slot[position % V]

    def _sort(self) -> None:
        m = len(self.at)
        rank = np.zeros(m, np.int64)
        tied = np.arange(m)
        for t in range(V):  # the first V words, by words of the suffixes still equal
            if not len(tied):
                break
            tied = self._refine(rank, tied, self.words[self.at[tied] + t])
        self.levels = [rank.copy()]
        width = V
        while len(tied):
            following = self._index(self.at[tied] + width)
            tied = self._refine(rank, tied, np.where(following < m, rank[np.minimum(following, m - 1)], m + following))
            self.levels.append(rank.copy())
            width *= 2
        self.rank = rank
        order = np.empty(m, np.int64)
        order[rank] = np.arange(m)
        common = self._prefixes(self.at[order[:-1]], self.at[order[1:]])
        self.table = [common]
        half = 1
        while 2 * half <= len(common):
            last = self.table[-1]
            self.table.append(np.minimum(last[:-half], last[half:]))
            half *= 2

    @staticmethod
    def _refine(rank: np.ndarray, tied: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Split equal ranks by ``key``; a rank is the number of smaller suffixes. Returns the suffixes that stay tied."""
        order = np.lexsort((key, rank[tied]))
        own, key, tied = rank[tied][order], key[order], tied[order]
        first = np.r_[True, own[1:] != own[:-1]]
        new = first | np.r_[True, key[1:] != key[:-1]]
        place = np.arange(len(tied))
        begin = place[new][np.cumsum(new) - 1]
        rank[tied] = own + begin - place[first][np.cumsum(first) - 1]
        alone = new & np.r_[new[1:], True]
        return tied[~alone]

    def _prefixes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefixes of sampled suffixes, by the ranks of their first V * 2^k words."""
        common = np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            level, ia, ib = self.levels[k], self._index(a + common), self._index(b + common)
            inside = np.maximum(ia, ib) < len(level)
            same = inside & (level[np.where(inside, ia, 0)] == level[np.where(inside, ib, 0)])
            common += np.where(same, V << k, 0)
        self._walk(a, b, common, np.full(len(a), V))
        return common

    def _walk(self, a: np.ndarray, b: np.ndarray, common: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Lengthen ``common`` word by word, by ``most`` words at most; which pairs came to the end of these."""
        going, stop, t = np.arange(len(a)), np.zeros(len(a), bool), 0
        while len(going):
            ended = most[going] <= t
            stop[going[ended]] = True
            going = going[~ended]
            going = going[self.words[a[going] + common[going]] == self.words[b[going] + common[going]]]
            common[going] += 1
            t += 1
        return stop

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The number of equal words from ``a`` and from ``b`` on, where a < b."""
        length = np.zeros(len(a), np.int64)
        deep = np.flatnonzero(self._walk(a, b, length, self.step[a % V, b % V]))
        if len(deep):
            low, high = self.rank[self._index(a[deep] + length[deep])], self.rank[self._index(b[deep] + length[deep])]
            low, high = np.minimum(low, high), np.maximum(low, high)
            k = np.frexp((high - low).astype(float))[1] - 1
            least = np.empty(len(deep), np.int64)
            for level in np.unique(k):
                of = k == level
                row = self.table[level]
                least[of] = np.minimum(row[low[of]], row[high[of] - (1 << level)])
            length[deep] += least
        return length


class Run(NamedTuple):
    start: int
    length: int
    period: int


def find(documents: list[np.ndarray], least: int = LEAST) -> list[list[Run]]:
    """The runs of each document, by start and period; a document is an array of word numbers."""
    sizes = np.array([len(d) for d in documents], np.int64)
    words = max((int(d.max()) for d in documents if len(d)), default=0) + 1
    # one closing word after each document and one before the first, all different
    pieces = [np.array([words])]
    for k, d in enumerate(documents):
        pieces += [d, np.array([words + k + 1])]
    text = np.concatenate(pieces).astype(np.int64)
    begin = 1 + np.cumsum(sizes + 1) - (sizes + 1)
    runs: list[list[Run]] = [[] for _ in documents]
    if not len(sizes) or sizes.max() < least:
        return runs
    right, left = Extensions(text), Extensions(text[::-1].copy())
    last = len(text) - 1
    # (document, period), and its number of grid pairs
    of = np.repeat(np.arange(len(sizes)), sizes // 2)
    period = _lengths(sizes // 2) + 1
    pairs = (sizes[of] - 1) // period
    found = []
    cuts = np.searchsorted(np.cumsum(pairs), np.arange(PAIRS, int(pairs.sum()) + PAIRS, PAIRS)).tolist()
    for lo, hi in zip([0, *[c + 1 for c in cuts]], [c + 1 for c in cuts]):
        own = pairs[lo:hi]
        q = np.repeat(period[lo:hi], own)
        doc = np.repeat(of[lo:hi], own)
        i = begin[doc] + _lengths(own) * q
        same = np.flatnonzero(text[i] == text[i + q])
        q, doc, i = q[same], doc[same], i[same]
        forward = right.common(i, i + q)
        backward = left.common(last - (i + q) + 1, last - i + 1)
        long = np.flatnonzero(forward + backward + q >= np.maximum(least, 2 * q))
        found.append(np.stack([doc[long], (i - backward)[long], (i + q + forward)[long], q[long]], axis=1))
    rows = np.unique(np.concatenate(found), axis=0)  # by document, start, end, period
    rows = rows[np.r_[True, (rows[1:, :3] != rows[:-1, :3]).any(axis=1)]] if len(rows) else rows
    for d, s, e, q in rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))].tolist():
        runs[d].append(Run(s - int(begin[d]), e - s, q))
    return runs


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def kept_words(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for r in runs:
        change[r.start + r.period] += 1
        change[r.start + r.length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def periodic_tail(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """A tenth of the documents, by crc32 of the id, repeat the words after a place of theirs."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


FIELDS = "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def _answer(ids: list, texts: list, change) -> pa.RecordBatch:
    numbers: dict[bytes, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    documents = [change(words_of(t), i) if change else words_of(t) for i, t in zip(ids, texts)]
    runs = find([np.fromiter(map(numbers.__getitem__, d), np.int64, len(d)) for d in documents])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array([[r._asdict() for r in own] for own in runs], kind),
         pa.array([b" ".join(kept_words(d, own)) for d, own in zip(documents, runs)], pa.binary()).cast(pa.string())],
        ["doc_id", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, change=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, runs, collapsed) of every row: all runs of at least 12 words and two periods.

    Words are split at ASCII white space. ``change`` (words, id) may replace a document's words first. ``runs`` is sorted by start,
    then period; ``collapsed`` are the words that no run holds after its first period, joined by one space. Null and empty texts have no words and no runs; repeated
    rows and null ids are rows like any other; an empty table gives no rows. Two runs may start at the same word with different periods: both count.
    Long texts are searched whole. Other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text", BATCH):
            yield _answer(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), change)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, FIELDS)


def longest(found: DataFrame) -> DataFrame:
    """One row per document: the number of runs, the longest one (the first of equal ones, then the smaller period), and
    digests of all runs' lines ``start,length,period`` and of the collapsed text."""
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r.length).alias("least"), r.start.alias("start"), r.period.alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.least")).alias("length"),
        F.col("best.period").alias("period"), F.expr("1000 * -best.least div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
