import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tablelens.llm import suffixes as S


def plain(rows):
    """(doc_id, kept, removed stretches) of each row, by a table of all strings."""
    least = {}
    for i, t in rows:
        if i is not None:
            for k in range(len(t) - S.WINDOW + 1):
                w = t[k:k + S.WINDOW]
                least[w] = min(least.get(w, i), i)
    out = []
    for i, t in rows:
        gone = [False] * len(t)
        for k in range(len(t) - S.WINDOW + 1) if i is not None else ():
            if least[t[k:k + S.WINDOW]] < i:
                gone[k:k + S.WINDOW] = [True] * S.WINDOW
        spans, k = [], 0
        while k < len(t):
            e = k
            while e < len(t) and gone[e]:
                e += 1
            if e > k:
                spans.append((k, e - k))
            k = e + 1
        out.append((i, bytes(b for b, g in zip(t, gone) if not g), len(t), spans))
    return out


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.binary(max_size=6), max_size=12).map(sorted), max_size=9))
def test_loser_tree(runs):
    share = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    order, common = S.merged([([0, *[share(a, b) for a, b in zip(r, r[1:])]], r) for r in runs])
    got = [runs[a][k] for a, k in order]
    assert got == sorted(x for r in runs for x in r) and len(set(order)) == len(order)
    assert common == [0, *[share(a, b) for a, b in zip(got, got[1:])]][:len(got)]


def test_known_prefixes_are_not_compared_again():
    class Counted(bytes):
        seen = 0

        def __getitem__(self, k):
            Counted.seen += 1
            return super().__getitem__(k)

    text = b"p" * 40
    runs = [[Counted(text + bytes([65 + (k * 7 + j) % 50])) for j in range(30)] for k in range(8)]
    runs = [sorted(r, key=bytes) for r in runs]
    S.merged([([0, *[40 if a != b else 41 for a, b in zip(r, r[1:])]], r) for r in runs])
    assert Counted.seen < 2 * (8 * 41 + 240 * 3 * 2)  # the common 40 bytes once a run, then a byte or two a meeting


def test_equal_strings_have_equal_anchors():
    rng = np.random.default_rng(1)
    a = rng.integers(97, 100, 3000).astype(np.uint8)
    data = np.concatenate([a, rng.integers(0, 256, 70_000).astype(np.uint8), a, np.full(500, 97, np.uint8)])
    ends = np.array([3000, 73_000, 76_000, 76_500])
    anchors = S.Anchors(data, ends, np.array([True, True, True, True]))
    starts = np.concatenate([np.arange(lo, hi + 1) for lo, hi in zip(anchors.lo, anchors.hi)])
    assert sorted(starts.tolist()) == [s for b, e in zip([0, *ends], ends) for s in range(b, e - S.WINDOW + 1)]
    place = {s: x - s for lo, hi, x in zip(anchors.lo, anchors.hi, anchors.x) for s in range(lo, hi + 1)}
    assert all(0 <= p <= S.SPAN for p in place.values())
    assert all(place[s] == place[s + 73_000] for s in range(3000 - S.WINDOW + 1))
    assert (anchors.hash[anchors.document == 3] == anchors.hash[-1]).all() and len(anchors.x) < len(starts)


def made(rng, n):
    words = [bytes(rng.choice(b"abcdefgh ") for _ in range(rng.randrange(2, 9))).decode() for _ in range(40)]
    passages = [" ".join(rng.choice(words) for _ in range(rng.randrange(5, 60))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 30))) for _ in range(3)]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            cut = rng.randrange(len(p))
            parts.insert(rng.randrange(4), p[cut:] if rng.random() < .5 else p[:cut + 30])
        rows.append((i, " é ".join(parts)))
    return rows + [(n + k, rows[rng.randrange(n)][1] + "x" * (k % 3)) for k in range(n // 4)]


def got(df, **more):
    return [(r.doc_id, bytes(r.kept), r.n_bytes, [tuple(s) for s in r.removed]) for r in S.remove_repeated(df, **more).collect()]


KEY = lambda r: (r[0] is None, r[0] or 0, r[1])


@pytest.mark.parametrize("hot", [4096, 5])
def test_against_a_table_of_all_strings(spark, hot):
    rows = made(random.Random(3), 60)
    rows += [(1000, "a" * 300), (1001, "b" + "a" * 120 + "b" + "a" * 60), (1002, "ab" * 100), (1003, "ba" * 40), (-5, rows[7][1] + "tail")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, kept int").repartition(3)
    want = plain([(i, t.encode()) for i, t in rows])
    assert sorted(got(df, run_bytes=3000, hot=hot), key=KEY) == sorted(want, key=KEY)
    assert sum(len(r[3]) for r in want) > 40


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, "x" * 49), (2, "x" * 49), (3, None), (4, ""), (None, "y" * 60), (5, "y" * 60), (6, "y" * 60), (6, "z" + "y" * 59), (7, long), (8, long),
            (9, "q" * 60), (9, "q" * 60), (10, "é" * 30 + "1"), (11, "é" * 30 + "2")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, run string")
    want = plain([(i, (t or "").encode()) for i, t in rows])
    assert sorted(got(df), key=KEY) == sorted(want, key=KEY)
    assert got(df.limit(0)) == []
