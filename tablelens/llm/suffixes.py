"""Repeated byte strings across documents by a distributed merge sort of front-coded suffix runs.

A string of ``WINDOW`` bytes belongs to its anchor, the first of its ``GRAM``-byte grams with the smallest hash. The anchor depends
on the string alone, so equal strings have equal anchors at equal places, and only suffixes that start at
anchors need sorting: about one in 13.

1. Blocks of whole texts are written once. Each block sends the hashes of its anchors' grams; a gram that occurs
   in one document only cannot hold a repeated string, and its block learns that by one bit.
2. A block sorts its remaining suffixes, each cut where its anchor's last string ends, into a run. Equal strings
   of the run keep those of the smallest document; the others are known to be covered. The run is front-coded
   (the length of the prefix shared with the entry before, then the other bytes) and cut at common splitters.
3. Each range of strings merges the pieces of all runs with a loser tree that carries common prefix lengths: two
   heads are compared from the shorter of their known prefixes on, and often not at all. The merged prefix lengths
   say which right parts are equal, those of the sorted left contexts which left parts, and per class of
   equal strings all but the smallest document's are covered.
4. Blocks receive their covered strings and cut the bytes out.

A gram of ``HOT`` documents or more would bring all of them to one range with their different contexts. The suffixes of such grams
are sent as their whole strings instead, sorted and split at all ``WINDOW`` bytes: equal ones are at most one
document's for each run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.llm.common import grouped, parts, stored
from tablelens.llm.ctw import expand, pack, squeeze, unpack

WINDOW, GRAM = 50, 25  # bytes of a removed string and of a gram
SPAN = WINDOW - GRAM  # places of a gram in a string, less one
RUN = 6 << 20  # bytes of text sorted into one run; a task needs some 20 times as much memory
RANGE = 16 << 20  # bytes of text for each range of hashes or strings
SAMPLED, SPLITTERS = 64, 200_000  # strings sampled from a run, and strings at most from which splitters are taken
HOT = 4096  # documents from which on a gram's strings are sent whole
PIECE = 65_000  # grams hashed at once; their places fit 16 bits
ROW = 80  # bytes of a sort key: right part, its length, left part reversed, its length, padding
U = np.uint64

# Odd multipliers of the gram hash.
BASE, MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


# -- anchors -----------------------------------------------------------------------------------------

def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base & 0xFFFFFFFFFFFFFFFF, U)
    p[0] = 1
    return np.multiply.accumulate(p)


UP, DOWN = _powers(BASE, PIECE + WINDOW), _powers(pow(BASE, -1, 1 << 64), PIECE + WINDOW)


class Anchors:
    """Anchors of a block of texts: places ``x``, first and last start ``lo``, ``hi`` of their strings, 48-bit gram ``hash``."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, usable: np.ndarray):
        """``ends``: where the documents end; ``usable``: whether a document takes part."""
        inside = np.zeros(max(len(data) - WINDOW + 1, 0), bool)  # starts whose string stays in its document
        for s, e in zip(np.concatenate([[0], ends[:-1]])[usable].tolist(), ends[usable].tolist()):
            inside[s:max(s, e - WINDOW + 1)] = True
        found = [self._piece(data, p, inside[p:p + PIECE - SPAN]) for p in range(0, len(inside), PIECE - SPAN)]
        x, lo, hi, h = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U),)
        # an anchor whose starts go on in the next piece
        new = np.r_[True, (x[1:] != x[:-1]) | (lo[1:] != hi[:-1] + 1)] if len(x) else np.zeros(0, bool)
        self.x, self.lo, self.hash = x[new], lo[new], h[new]
        self.hi = hi[np.r_[new[1:], True]] if len(x) else hi
        self.document = np.searchsorted(ends, self.x, "right")

    @staticmethod
    def _piece(data: np.ndarray, p: int, inside: np.ndarray) -> tuple[np.ndarray, ...]:
        """(anchors, first and last starts, gram hashes) of the strings that start at p and after, where ``inside``."""
        x = data[p:p + len(inside) + WINDOW - 1].astype(U)
        sums = np.zeros(len(x) + 1, U)
        np.cumsum(x * UP[:len(x)], out=sums[1:])
        h = (sums[GRAM:] - sums[:-GRAM]) * DOWN[:len(x) - GRAM + 1]
        h ^= h >> U(32)
        h *= U(MIX)
        h ^= h >> U(29)
        # the place in the low bits: the first of equal hashes wins
        least, width = (h & U(0xFFFFFFFFFFFF0000)) | np.arange(len(h), dtype=U), 1
        while 2 * width <= SPAN + 1:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        rest = SPAN + 1 - width
        least = np.minimum(least[:len(least) - rest], least[rest:])
        at = np.flatnonzero(inside)
        own = (least[at] & U(0xFFFF)).astype(np.int64)
        new = np.r_[True, (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)] if len(at) else np.zeros(0, bool)
        last = np.r_[new[1:], True] if len(at) else new
        return p + own[new], p + at[new], p + at[last], h[own[new]] >> U(16)

    def grams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct hashes ascending, the number of documents of each, and each anchor's place among them."""
        order = np.lexsort((self.document, self.hash))
        h, d = self.hash[order], self.document[order]
        new = np.r_[True, h[1:] != h[:-1]] if len(h) else np.zeros(0, bool)
        place = np.empty(len(h), np.int64)
        place[order] = np.cumsum(new) - 1
        fresh = new | np.r_[True, d[1:] != d[:-1]] if len(h) else new
        return h[new], np.bincount(np.cumsum(new)[fresh] - 1, minlength=int(new.sum())), place


# -- blocks of text ------------------------------------------------------------------------------------

BLOCK = "run long, ids array<long>, sizes binary, data binary, n_bytes long, sample array<binary>"


def text_blocks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    ids, texts, size, number = [], [], 0, TaskContext.get().partitionId() << 33

    def block():
        data = np.frombuffer(b"".join(texts), np.uint8)
        starts = np.linspace(0, max(len(data) - WINDOW, 0), SAMPLED, dtype=np.int64) if len(data) else []
        return pa.RecordBatch.from_arrays(
            [pa.array([number]), pa.array([ids], pa.list_(pa.int64())), pa.array([pack(np.cumsum([len(t) for t in texts]))], pa.binary()),
             pa.array([squeeze(data.tobytes())], pa.binary()), pa.array([len(data)], pa.int64()),
             pa.array([[data[s:s + WINDOW].tobytes() for s in starts]], pa.list_(pa.binary()))],
            ["run", "ids", "sizes", "data", "n_bytes", "sample"])

    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if texts and size + len(t) > limit:
                yield block()
                ids, texts, size, number = [], [], 0, number + 1
            ids.append(i)
            texts.append(t)
            size += len(t)
    if texts:
        yield block()


def opened(ids: list, sizes: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray, Anchors, np.ndarray]:
    """(bytes, document ends, anchors, ids with 0 for null)"""
    raw, ends = np.frombuffer(expand(data), np.uint8), unpack(sizes).astype(np.int64)
    usable = np.array([i is not None for i in ids], bool)
    return raw, ends, Anchors(raw, ends, usable), np.array([i or 0 for i in ids], np.int64)


# -- repeated grams ------------------------------------------------------------------------------------

def send_grams(ranges: int):
    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                hashes, documents, _ = opened(r["ids"], r["sizes"], r["data"])[2].grams()
                cuts = np.searchsorted(hashes, (np.arange(1, ranges, dtype=object) << 48) // ranges).tolist() if ranges > 1 else []
                bounds = [0, *cuts, len(hashes)]
                rows = [(k, s, e) for k, (s, e) in enumerate(zip(bounds, bounds[1:])) if e > s]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k for k, _, _ in rows], pa.int32()), pa.array([r["run"]] * len(rows), pa.int64()),
                     pa.array([pack(hashes[s:e]) for _, s, e in rows], pa.binary()),
                     pa.array([squeeze(np.minimum(documents[s:e], 65535).astype(np.uint16).tobytes()) for _, s, e in rows], pa.binary())],
                    ["part", "run", "hashes", "documents"])
    return run


def judge_grams(key, rows, hot: int) -> Iterator[pa.RecordBatch]:
    """For each run and range, a bit for each of its grams that two documents hold, and one for those that ``hot`` documents hold."""
    runs, hashes, documents = [], [], []
    for _, run, h, d in rows:
        runs.append(run)
        hashes.append(unpack(h))
        documents.append(np.frombuffer(expand(d), np.uint16))
    sizes = [len(h) for h in hashes]
    _, place = np.unique(np.concatenate(hashes), return_inverse=True)
    total = np.bincount(place, weights=np.concatenate(documents))[place]
    ends = np.cumsum(sizes).tolist()
    bits = lambda mask, n, e: squeeze(np.packbits(mask[e - n:e]).tobytes())
    yield pa.RecordBatch.from_arrays(
        [pa.array(runs, pa.int64()), pa.array([key] * len(runs), pa.int32()), pa.array(sizes, pa.int64()),
         pa.array([bits(total >= 2, n, e) for n, e in zip(sizes, ends)], pa.binary()),
         pa.array([bits(total >= hot, n, e) for n, e in zip(sizes, ends)], pa.binary())], ["run", "part", "n", "repeated", "hot"])


def _flags(packed: list[tuple[int, bytes]]) -> np.ndarray:
    return np.concatenate([np.unpackbits(np.frombuffer(expand(b), np.uint8))[:n] for n, b in packed]).astype(bool) if packed else np.zeros(0, bool)


# -- runs of suffixes ------------------------------------------------------------------------------------

def sort_keys(data: np.ndarray, x: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Rows of ``ROW`` bytes whose order is that of the right parts, then that of the reversed left parts."""
    keys = np.zeros((len(x), ROW), np.uint8)
    for t in range(WINDOW):
        has = right > t
        keys[has, t] = data[x[has] + t]
    keys[:, WINDOW] = right
    for t in range(SPAN):
        has = left > t
        keys[has, WINDOW + 1 + t] = data[x[has] - 1 - t]
    keys[:, WINDOW + 1 + SPAN] = left
    return keys


def shared(keys: np.ndarray, width: int) -> np.ndarray:
    """For each row, the number of bytes shared with the row before, of the first ``width``."""
    if not len(keys):
        return np.zeros(0, np.int64)
    differs = keys[1:, :width] != keys[:-1, :width]
    return np.r_[0, np.where(differs.any(axis=1), differs.argmax(axis=1), width)]


def ordered(keys: np.ndarray, *last: np.ndarray) -> np.ndarray:
    words = np.ascontiguousarray(keys).view(">u8").astype(U)
    return np.lexsort((*reversed(last), *[words[:, k] for k in range(words.shape[1] - 1, -1, -1)]))


def sorted_run(data, ids, document, x, left, right) -> tuple[tuple, np.ndarray]:
    """The run's entries (keys, ids, places) in order, and which of the given suffixes an equal one of a smaller document covers."""
    keys = sort_keys(data, x, left, right)
    own = ids[document]
    order = ordered(keys, own, x)
    keys, own = keys[order], own[order]
    new = np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)] if len(keys) else np.zeros(0, bool)
    smallest = own[new][np.cumsum(new) - 1] if len(keys) else own
    stays = own == smallest
    covered = np.zeros(len(x), bool)
    covered[order[~stays]] = True
    return (keys[stays], own[stays], x[order[stays]]), covered


def coded(keys: np.ndarray, ids: np.ndarray, x: np.ndarray) -> bytes:
    """Front-coded entries: common prefix, lengths, the other bytes, left parts, ids and places."""
    right, left = keys[:, WINDOW].astype(np.int64), keys[:, WINDOW + 1 + SPAN].astype(np.int64)
    common = np.minimum(shared(keys, WINDOW), right)
    common[1:] = np.minimum(common[1:], right[:-1])
    t = np.arange(WINDOW)
    tails = keys[:, :WINDOW][(t >= common[:, None]) & (t < right[:, None])]
    lefts = keys[:, WINDOW + 1:WINDOW + 1 + SPAN][t[:SPAN] < left[:, None]]
    planes = lambda v: v.astype(np.int64).view(np.uint8).reshape(-1, 8).T.tobytes()
    return squeeze(b"".join([common.astype(np.uint8).tobytes(), right.astype(np.uint8).tobytes(), left.astype(np.uint8).tobytes(),
                             planes(ids), planes(x), lefts.tobytes(), tails.tobytes()]))


def decoded(n: int, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """(common, right, left, ids, places, left parts as padded rows, right parts)"""
    raw = np.frombuffer(expand(data), np.uint8)
    common, right, left = (raw[k * n:(k + 1) * n].astype(np.int64) for k in range(3))
    ids, x = (np.ascontiguousarray(raw[k * n:(k + 8) * n].reshape(8, n).T).view(np.int64).ravel() for k in (3, 11))
    lefts = np.zeros((n, SPAN), np.uint8)
    has = np.arange(SPAN) < left[:, None]
    at = 19 * n + int(has.sum())
    lefts[has] = raw[19 * n:at]
    tails, texts, last = raw[at:].tobytes(), [], b""
    at = 0
    for c, r in zip(common.tolist(), right.tolist()):
        last = last[:c] + tails[at:at + r - c]
        at += r - c
        texts.append(last)
    return common, right, left, ids, x, lefts, texts


def merged(runs: list[tuple[list[int], list[bytes]]]) -> tuple[list[tuple[int, int]], list[int]]:
    """Merge sorted runs, each (prefix shared with the entry before, entry): (run, place) in order and the prefix shared with
    the entry merged before.

    A loser tree: every inner node holds the run that lost there, ``known[run]`` the prefix that its head shares with the
    last winner that passed. The head that shares more with the last winner is the smaller one without a look at its
    bytes; equal ones are compared from there on, so no byte of a known prefix is compared again."""
    count = len(runs)
    heads = [texts[0] if texts else None for _, texts in runs]
    known, place = [0] * count, [0] * count
    width = 1
    while width < count:
        width *= 2

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's known prefix becomes the one shared with the winner."""
        if b < 0 or heads[b] is None:
            return a, b
        if a < 0 or heads[a] is None:
            return b, a
        ha, hb = known[a], known[b]
        if ha > hb:
            return a, b
        if hb > ha:
            return b, a
        s, t = heads[a], heads[b]
        end = min(len(s), len(t))
        while ha < end and s[ha] == t[ha]:
            ha += 1
        if (len(s) <= len(t)) if ha == end else s[ha] < t[ha]:
            known[b] = ha
            return a, b
        known[a] = ha
        return b, a

    loser = [-1] * width
    level = [k if k < count else -1 for k in range(width)]
    begin = width
    while len(level) > 1:
        begin //= 2
        pairs = [play(level[2 * k], level[2 * k + 1]) for k in range(len(level) // 2)]
        for k, (_, lost) in enumerate(pairs):
            loser[begin + k] = lost
        level = [won for won, _ in pairs]
    winner = level[0] if level else -1
    order, common = [], []
    while winner >= 0 and heads[winner] is not None:
        at = place[winner]
        order.append((winner, at))
        common.append(known[winner])
        at += 1
        shares, texts = runs[winner]
        place[winner] = at
        if at < len(texts):
            heads[winner], known[winner] = texts[at], shares[at]
        else:
            heads[winner] = None
        node = (width + winner) // 2
        while node:
            winner, loser[node] = play(winner, loser[node])
            node //= 2
    return order, common


def covered_strings(common: np.ndarray, right: np.ndarray, left: np.ndarray, ids: np.ndarray, lefts: np.ndarray) -> np.ndarray:
    """For entries in merged order, a bit for each of their strings (by the anchor's place in it) that a smaller document holds.

    The string with its anchor at place o is o bytes of the left part and WINDOW - o of the right part. Right parts
    are equal where no smaller shared prefix lies between, left parts likewise in their own order."""
    n = len(ids)
    by_left = ordered(np.pad(lefts, ((0, 0), (0, 32 - SPAN))))
    left_shared = shared(lefts[by_left], SPAN)
    bits = np.zeros(n, np.int64)
    left_class = np.empty(n, np.int64)
    for o in range(SPAN + 1):
        some = np.flatnonzero((WINDOW - right <= o) & (left >= o))
        if len(some) < 2:
            continue
        left_class[by_left] = np.cumsum(left_shared < o)
        key = np.cumsum(common < WINDOW - o)[some] * (n + 1) + left_class[some]
        order = np.lexsort((ids[some], key))
        key, own = key[order], ids[some][order]
        new = np.r_[True, key[1:] != key[:-1]]
        bits[some[order]] |= (own > own[new][np.cumsum(new) - 1]).astype(np.int64) << o
    return bits


# -- the job ------------------------------------------------------------------------------------------

PART = "part int, run long, n long, data binary"


def send_runs(splitters: list[bytes]):
    """A block and what is known of its grams -> its covered strings and the pieces of its sorted run."""
    cuts = np.array(splitters, f"S{WINDOW}")

    def run(key, rows):
        block = next(rows)
        packed = [(r[-3], r[-2], r[-1]) for r in rows]
        if not packed:
            return
        data, _, anchors, ids = opened(*block[2:5])
        _, _, place = anchors.grams()
        repeated, hot = _flags([(n, b) for n, b, _ in packed])[place], _flags([(n, b) for n, _, b in packed])[place]
        out = []
        whole = np.flatnonzero(repeated & hot)
        # the strings of hot grams one by one, each its own right part
        count = (anchors.hi - anchors.lo + 1)[whole]
        start = np.repeat(anchors.lo[whole], count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        kinds = [(start, np.zeros(len(start), np.int64), np.full(len(start), WINDOW), np.repeat(anchors.document[whole], count), WINDOW)]
        some = np.flatnonzero(repeated & ~hot)
        x = anchors.x[some]
        kinds.append((x, x - anchors.lo[some], anchors.hi[some] + WINDOW - x, anchors.document[some], GRAM))
        for x, left, right, document, width in kinds:
            if not len(x):
                continue
            (keys, own, at), covered = sorted_run(data, ids, document, x, left, right)
            if covered.any():
                lowest = WINDOW - right[covered]
                bits = (1 << (left[covered] + 1)) - (1 << lowest)
                out.append((-1 - key % 1_000_003, key, x[covered], bits))
            part = np.searchsorted(cuts, np.ascontiguousarray(keys[:, :width]).view(f"S{width}").ravel(), "right") if len(cuts) else np.zeros(len(keys), int)
            ends = np.flatnonzero(np.r_[part[1:] != part[:-1], True])
            for s, e in zip([0, *(ends[:-1] + 1).tolist()], (ends + 1).tolist()):
                out.append((int(part[s]), key, (keys[s:e], own[s:e], at[s:e]), None))
        rows = [(part, run, len(body[0]), coded(*body)) if bits is None else (part, run, len(body), covered_row(body, bits)) for part, run, body, bits in out]
        yield pa.RecordBatch.from_pydict({"part": pa.array([r[0] for r in rows], pa.int32()), "run": pa.array([r[1] for r in rows], pa.int64()),
                                          "n": pa.array([r[2] for r in rows], pa.int64()), "data": pa.array([r[3] for r in rows], pa.binary())})
    return run


def covered_row(x: np.ndarray, bits: np.ndarray) -> bytes:
    order = np.argsort(x, kind="stable")
    first = pack(x[order])
    return len(first).to_bytes(8, "little") + first + pack(bits[order])


def covered_starts(row: bytes) -> np.ndarray:
    """Starts of the covered strings."""
    n = int.from_bytes(row[:8], "little")
    x, bits = unpack(row[8:8 + n]).astype(np.int64), unpack(row[8 + n:]).astype(np.int64)
    return np.concatenate([x[(bits >> o & 1) == 1] - o for o in range(SPAN + 1)])


def merge_range(key, rows) -> Iterator[pa.RecordBatch]:
    """The pieces of one range -> covered strings of each run. Rows that are covered strings already go through."""
    if key < 0:
        for _, run, _, data in rows:
            yield pa.RecordBatch.from_arrays([pa.array([run], pa.int64()), pa.array([data], pa.binary())], ["run", "data"])
        return
    runs, columns, sizes = [], [], []
    for _, run, n, data in rows:
        common, *rest, texts = decoded(n, data)
        runs.append((common.tolist(), texts))
        columns.append((*rest, np.full(n, run, np.int64)))
        sizes.append(n)
    order, common = merged(runs)
    del runs
    if not order:
        return
    begin = np.cumsum(sizes) - sizes
    at = np.array(order, np.int64)
    at = begin[at[:, 0]] + at[:, 1]
    right, left, ids, x, lefts, run = (np.concatenate(c)[at] for c in zip(*columns))
    common = np.array(common, np.int64)
    # entries whose gram none of their neighbours shares hold no repeated string
    near = common >= GRAM
    some = np.flatnonzero(near | np.r_[near[1:], False])
    # what is shared across dropped entries is shorter than a gram and stays so
    bits = covered_strings(common[some], right[some], left[some], ids[some], lefts[some]) if len(some) else np.zeros(0, np.int64)
    hit = bits != 0
    run, x, bits = run[some][hit], x[some][hit], bits[hit]
    numbers = np.unique(run)
    if len(numbers):
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()),
                                          pa.array([covered_row(x[run == r], bits[run == r]) for r in numbers.tolist()], pa.binary())], ["run", "data"])


KEPT = "doc_id long, kept binary, n_bytes long, removed array<struct<start: long, length: long>>"


def cut_out(key, rows) -> Iterator[pa.RecordBatch]:
    block = next(rows)
    ids, raw, ends = block[2], expand(block[4]), unpack(block[3]).astype(np.int64)
    starts = [covered_starts(r[-1]) for r in rows]
    covered = np.zeros(len(raw), bool)
    for own in starts:
        covered[own] = True
    out = []
    data = np.frombuffer(raw, np.uint8)
    for i, s, e in zip(ids, [0, *ends[:-1].tolist()], ends.tolist()):
        sums = np.concatenate([np.zeros(WINDOW, np.int64), np.cumsum(covered[s:e])])
        own = sums[WINDOW:] > sums[:e - s]
        edges = np.flatnonzero(np.diff(own, prepend=False, append=False))
        out.append({"doc_id": i, "kept": data[s:e][~own].tobytes() if len(edges) else raw[s:e], "n_bytes": e - s,
                    "removed": [{"start": a, "length": b - a} for a, b in edges.reshape(-1, 2).tolist()]})
        if len(out) == 1000:
            yield _kept(out)
            out = []
    yield _kept(out)


def _kept(rows: list[dict]) -> pa.RecordBatch:
    kinds = pa.schema([("doc_id", pa.int64()), ("kept", pa.binary()), ("n_bytes", pa.int64()),
                       ("removed", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))])
    return pa.RecordBatch.from_pylist(rows, schema=kinds)


def remove_repeated(docs: DataFrame, run_bytes: int = RUN, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kept, n_bytes, removed) of every row: the text's UTF-8 bytes without those of any ``WINDOW``-byte string that
    also starts in a document of smaller id, the size of the text, and the removed stretches.

    Strings are judged on the input. Strings do not cross documents, and may start inside a character, so ``kept`` is
    binary. Null and empty texts have no bytes; texts shorter than ``WINDOW`` stay whole. Rows that share an id are neither smaller
    than the other, so both keep what only they share; rows with a null id stay whole and cover nothing. An empty table
    gives no rows. Long texts are searched whole. Other columns are not read. The bytes of a run and the documents of a
    hot gram change the work, not the result.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    blocks = stored(docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
                    .mapInArrow(lambda batches: text_blocks(batches, run_bytes), BLOCK), "texts")
    total = blocks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    ranges = max(parts(docs), total // RANGE)
    body = blocks.select("run", "ids", "sizes", "data")
    grams = grouped(body.mapInArrow(send_grams(ranges), "part int, run long, hashes binary, documents binary"),
                    lambda key, own: judge_grams(key, own, hot),
                    "run long, part int, n long, repeated binary, hot binary", "part")
    none = lambda *names: [F.lit(None).cast(t).alias(n) for n, t in names]
    known = body.select("run", F.lit(-1).alias("part"), "ids", "sizes", "data", *none(("n", "long"), ("repeated", "binary"), ("hot", "binary"))) \
        .unionByName(grams.select("run", "part", *none(("ids", "array<long>"), ("sizes", "binary"), ("data", "binary")), "n", "repeated", "hot"))
    # at most SPLITTERS strings
    sample = sorted(bytes(r.s) for r in blocks.select("run", F.explode("sample").alias("s")).orderBy(F.xxhash64("run", "s")).limit(SPLITTERS).collect())
    splitters = sorted({sample[len(sample) * k // ranges] for k in range(1, ranges)}) if sample else []
    runs = grouped(known, send_runs(splitters), PART, "run", order=("part",))
    covered = stored(grouped(runs, merge_range, "run long, data binary", "part"), "covered")
    back = body.select("run", F.lit(0).alias("kind"), "ids", "sizes", "data") \
        .unionByName(covered.select("run", F.lit(1).alias("kind"), *none(("ids", "array<long>"), ("sizes", "binary")), "data"))
    return grouped(back, cut_out, KEPT, "run", order=("kind",))
