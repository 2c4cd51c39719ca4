import math
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablelens.llm import ctw
from tablelens.llm.common import remainder
from tablelens.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
DOCS = [(1, "The cat sat on the mat"), (2, "the CAT"), (3, None), (4, ""), (5, "x" * 300), (6, "the cat sat\ton\nthe mat é"),
        (7, "mat the on sat"), (8, "the cat"), (8, "the cat"), (None, "a cat")]


def brute(docs, held):
    """Log10 probabilities by the textbook recursion over explicit contexts."""
    texts = [b" ".join((t or "").encode().lower().split()) + b"\n" for _, t in docs]
    counts = defaultdict(lambda: [0, 0])
    children = defaultdict(set)

    def walk(t):
        padded = b"\n" * ctw.DEPTH + t
        for i in range(len(t)):
            context, byte = padded[i:i + ctw.DEPTH], t[i]
            for b in range(8):
                yield context, (1 << b) | (byte >> (8 - b)), (byte >> (7 - b)) & 1

    for t, h in zip(texts, held):
        if not h:
            for context, node, bit in walk(t):
                for d in range(ctw.DEPTH + 1):
                    counts[context[ctw.DEPTH - d:], node][bit] += 1
                    if d:
                        children[context[ctw.DEPTH - d + 1:], node].add(context[ctw.DEPTH - d:])

    def kt(key):
        a, b = counts[key]
        return math.lgamma(a + .5) + math.lgamma(b + .5) - math.lgamma(a + b + 1) - math.log(math.pi)

    @lru_cache(None)
    def split(context, node):
        return sum(weighted(c, node) for c in sorted(children[context, node]))

    @lru_cache(None)
    def weighted(context, node):
        own = kt((context, node))
        return own if len(context) == ctw.DEPTH else np.logaddexp(own, split(context, node)) - math.log(2)

    def predict(context, node, bit, d=0):
        key = context[ctw.DEPTH - d:], node
        if key not in counts:
            return .5
        n = counts[key]
        own = (n[bit] + .5) / (sum(n) + 1)
        if d == ctw.DEPTH:
            return own
        ratio = 1 / (1 + math.exp(min(700.0, split(*key) - kt(key))))  # beyond, 0 in doubles either way
        return ratio * own + (1 - ratio) * predict(context, node, bit, d + 1)

    return [sum(math.log10(predict(*step)) for step in walk(t)) for t in texts]


@pytest.mark.parametrize("block,spread", [(1 << 20, 256), (40, 3)])  # one block, or many
def test_matches_the_recursion(spark, block, spread):
    df = spark.createDataFrame([(*d, "z", 1) for d in DOCS], "doc_id long, text string, score string, shard int")
    held = [d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in DOCS]
    assert any(held)
    rows = ctw.score(df, remainder(F.col("doc_id"), 7) == 2, block_bytes=block, spread=spread).collect()
    want = Counter((d, round(p, 3)) for (d, _), p in zip(DOCS, brute(DOCS, held)))
    assert Counter((r.doc_id, round(r.score, 3)) for r in rows) == want or \
        np.allclose(sorted(r.score for r in rows), sorted(brute(DOCS, held)), atol=2e-3)
    assert {r.doc_id: r.n_tokens for r in rows}[1] == 7 and {r.doc_id: r.n_bytes for r in rows}[3] == 1


def test_word_base_and_gain(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op1_context_tree_weighting"](spark, SF).collect()
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in docs}
    words = {d: [*t.encode().lower().split(), b"\n"] for d, t in docs.items()}
    c = Counter(w for d, ws in words.items() if not held[d] for w in ws)
    n, v = sum(c.values()), len(c)
    assert len(rows) == len(docs)
    for r in rows:
        ws = words[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(math.fsum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel=1e-9)
        assert r.score < 0


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert ctw.score(df, F.lit(False)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 5, 10000])
def test_packed_arrays(n):
    rng = np.random.default_rng(n)
    whole = np.sort(rng.integers(0, 2 ** 63, n).astype(np.uint64) >> np.uint64(20))
    assert (ctw.unpack(ctw.pack(whole)) == whole).all() and (ctw.unpack_counts(ctw.pack_counts(whole[::-1])) == whole[::-1]).all()
    logs = -9 * rng.random(n)
    assert np.allclose(ctw.unpack_logs(ctw.pack_logs(logs)), logs, rtol=2.1e-5, atol=0)


def test_more_texts_than_are_sorted_at_once(spark):
    docs = [(i, f"cat {i % 3} mat") for i in range(300)] + [(300, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = {r.doc_id: r.score for r in ctw.score(df, F.lit(False)).collect()}
    want = dict(zip(range(301), brute(docs, [False] * 301)))
    assert len(rows) == 301 and all(abs(rows[i] - want[i]) < 2e-3 for i in rows)


def test_places_by_shard_need_no_pass_a_shard():
    shard = np.random.default_rng(4).integers(0, 700, 3000)
    got = dict(ctw.in_shards(shard, 900))
    assert list(got) == sorted(set(shard.tolist())) and all((own == np.flatnonzero(shard == s)).all() for s, own in got.items())
    assert dict(ctw.in_shards(shard[:0], 900)) == {} and (ctw.sorted_set(shard) == np.unique(shard)).all() and not len(ctw.sorted_set(shard[:0]))
