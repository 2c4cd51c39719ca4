import hashlib
import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tablelens.llm import runs as R


def plain(words):
    """All runs by looking at every period and every position."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(12, 2 * q):
                found.setdefault((i, j + q), q)
            i = j
    return sorted((s, e - s, q) for (s, e), q in found.items())


def found(documents):
    numbers = {}
    return [[tuple(r) for r in own] for own in R.find([np.array([numbers.setdefault(w, len(numbers)) for w in d], np.int64) for d in documents])]


def test_the_cover_holds_every_difference():
    assert {(a - b) % R.V for a in R.COVER for b in R.COVER} == set(range(R.V))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=150), max_size=4))
def test_small_alphabet(documents):
    assert found(documents) == [plain(d) for d in documents]


@settings(max_examples=60, deadline=None)
@given(st.data())
def test_planted_repetitions(data):
    words = []
    for _ in range(data.draw(st.integers(1, 5))):
        block = data.draw(st.lists(st.integers(0, 5), min_size=1, max_size=40))
        words += block * data.draw(st.integers(1, 6)) + block[:data.draw(st.integers(0, len(block)))]
    assert found([words, words[::-1], words]) == [plain(words), plain(words[::-1]), plain(words)]


def test_extensions_against_comparing():
    rng = random.Random(4)
    text = np.array([rng.randrange(2) for _ in range(90)] * 3 + [7] * 200 + [rng.randrange(3) for _ in range(100)] + [9])
    lce = R.Extensions(text)
    a = np.array([rng.randrange(len(text)) for _ in range(3000)])
    b = np.array([rng.randrange(len(text)) for _ in range(3000)])
    a, b = np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]
    want = []
    for i, j in zip(a.tolist(), b.tolist()):
        k = 0
        while j + k < len(text) and text[i + k] == text[j + k]:
            k += 1
        want.append(k)
    assert lce.common(a, b).tolist() == want


def test_many_grid_pairs_in_blocks(monkeypatch):
    monkeypatch.setattr(R, "PAIRS", 37)
    rng = random.Random(1)
    documents = [[rng.randrange(3) for _ in range(rng.randrange(80))] * rng.randrange(1, 4) for _ in range(20)]
    assert found(documents) == [plain(d) for d in documents]


def reference_row(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    own = plain(words)
    drop = {i for s, n, q in own for i in range(s + q, s + n)}
    best = min(own, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return (doc_id, len(own), *best, 1000 * best[1] // best[2] if own else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in own).encode()),
            sha(b" ".join(w for i, w in enumerate(words) if i not in drop)))


def test_rows_against_plain_search(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["a", "b", "cd"]) for _ in range(rng.randrange(90)))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, " \t\n"), (None, "x " * 30), (503, "é " * 40 + "z"), (503, "é " * 40 + "z"), (504, "a b " * 13), (505, "w " * 5000)]
    df = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, period int, runs string")
    got = [tuple(r) for r in R.longest(R.periodic_runs(df, R.periodic_tail)).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[-1])
    want = sorted((reference_row(*r) for r in rows if r[0] != 505), key=key)
    assert sorted((r for r in got if r[0] != 505), key=key) == want
    assert [r[1:6] for r in got if r[0] == 505] == [(1, 0, 5000, 1, 5000000)]
    assert R.longest(R.periodic_runs(df.limit(0))).count() == 0
