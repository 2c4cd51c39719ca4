"""Nulls, empty and long texts, repeated rows, empty tables and clashing extra columns, for the table operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablelens.llm import toxicity as T
from tablelens.llm.covertree import threshold_components
from tablelens.llm.kdtree import top_k
from tablelens.llm.licenses import scan
from tablelens.llm.minhash import keep_from, near_duplicates
from tablelens.llm.mixing import mix
from tablelens.llm.quality import score_quality
from tablelens.llm.toxicity import score_toxicity

BASE = " ".join(f"w{i}" for i in range(100))
ROWS = [(1, BASE), (2, BASE.upper()), (3, BASE + " more"), (4, None), (5, ""), (6, "two words"), (6, "two words"), (None, BASE),
        (7, "a b\tc\nd"), (8, "long " * 50_000), (9, " ".join(f"x{i}" for i in range(100)))]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "z", 1.5, None) for r in ROWS], "doc_id long, text string, score string, n double, source string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 10)] + [(None, 1, None)], "doc_id long, quality int, toxic int")


def test_near_duplicates(docs):
    got = sorted(((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in near_duplicates(docs).collect()))
    assert got == [(0, 96, 0, False), (1, 96, 1, True), (2, 96, 1, False), (3, 97, 1, False), (4, 0, 4, True), (5, 0, 5, True),
                   (6, 1, 6, True), (6, 1, 6, True), (7, 1, 7, True), (8, 1, 8, True), (9, 96, 9, True)]
    assert near_duplicates(docs.limit(0)).count() == 0
    assert keep_from(0.75) == sorted(keep_from(0.75)) and keep_from(0.75)[-1] < 150


def test_classifiers(docs, labels):
    for run in (score_quality, score_toxicity):
        got = run(docs, labels, F.lit(True), per_class=10).collect()
        assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
        assert len(run(docs, labels.limit(0), F.lit(True)).collect()) == len(ROWS)
        assert run(docs.limit(0), labels, F.lit(True)).count() == 0


def test_classifiers_learn_from_the_end_of_long_texts(spark):
    """What tells the classes apart stands behind 300,000 characters; nulls and repeats score like empty and equal texts."""
    start = "word " * 60_000
    rows = [(i, start + f"{'vile scum' if i % 2 else 'kind friend'} {i}") for i in range(40)] + [(90, None), (91, ""), (92, "x y"), (92, "x y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    got = score_toxicity(docs, labels, F.col("doc_id") < 30, per_class=100, evidence=1.0).collect()
    by = {r.doc_id: r.score for r in got}
    assert all((by[i] > 0.5) == bool(i % 2) for i in range(30, 40))
    assert by[90] == by[91] and len([r for r in got if r.doc_id == 92]) == 2
    q = score_quality(docs, labels, F.col("doc_id") < 30, per_class=100, carry="s").collect()
    assert [r.doc_id for r in q if r.text is None] == [90] and len({r.s for r in q if r.doc_id == 92}) == 1


def test_counting_in_tasks_gives_the_model_of_the_texts(spark):
    rng = np.random.default_rng(1)
    vocabulary = [f"w{i}" for i in range(40)] + ["women", "gay", "black"]
    rows = [(i, ". ".join(" ".join(rng.choice(vocabulary, 6)) for _ in range(3)) + (" vile" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, y int")
    settings = (20, 3, 1.0, 2e-3, 1.0, T.IDENTITY)
    got = T.learned(docs, docs.select("doc_id", F.col("y").alias("toxic")), F.lit(True), 1000, settings, "toxic", "doc_id", "text")
    want = T.fit([(t, y) for _, t, y in rows], *settings)
    assert got["terms"] == want["terms"] and got["weights"].keys() == want["weights"].keys()
    assert all(abs(got["weights"][w] - want["weights"][w]) < 1e-6 for w in want["weights"])


def test_identity_swaps_reduce_false_positives():
    sample = [(f"you muslim are awful {i}", 1) for i in range(30)] + [(f"my muslim neighbour is kind {i}", 0) for i in range(6)] \
        + [(f"a christian neighbour is kind {i}", 0) for i in range(24)]
    free, fair = (T.fit(sample, 100, 3, 0.0, 2e-3, f, T.IDENTITY) for f in (0.0, 5.0))
    gap = lambda m: abs(m["weights"].get(b"muslim", 0) - m["weights"].get(b"christian", 0))
    assert gap(fair) < 0.2 * gap(free)
    assert T.logit(fair, "the muslim neighbour is kind") < 0 < T.logit(fair, "you are awful")


def test_licenses(docs):
    extra = docs.limit(0).sparkSession.createDataFrame([(20, "x\nReleased under the MIT\nLicense.", "", 0.0, "")], docs.schema)
    got = {r.doc_id: r for r in scan(docs.unionByName(extra)).collect()}
    assert got[4].n_words == 0 and got[8].n_words == 50_000 and not got[1].matches
    assert [(m.label, m.first_word, m.n_words) for m in got[20].matches] == [("mit", 0, 6)] and got[20].places[0].first_word == 2
    assert scan(docs.limit(0)).count() == 0


def test_mixing(docs):
    levels = {"lang": F.lit(None), "source": F.col("source")}
    got = mix(docs, levels, {}, (1, 1), 2).collect()
    tokens = sum(len((t or "").split()) for _, t in ROWS)
    assert sum(r.tokens_taken for r in got) == tokens and {r.lang for r in got} == {"unknown"}
    assert sum(r.tokens_taken for r in mix(docs, levels, {}, (3, 1), 2).collect()) == 2 * tokens  # at most two passes
    assert mix(docs.limit(0), levels, {}).count() == 0


def test_vectors(spark):
    v = [1.0, 0.5]
    rows = [(1, v, 1), (2, v, 1), (3, [2.0, 1.0], 1), (4, v, 2), (5, v, None), (6, None, 1), (7, [0.0, 0.0], 1), (8, [float("nan"), 1.0], 1),
            (None, v, 1), (9, [-0.5, 1.0], 1), (10, [1.0], 1), (11, [None, 1.0], 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, score string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in threshold_components(df).collect()}
    assert got[1] == (2, 1, True) and got[3] == (2, 1, False) and got[None] == (0, None, False)
    assert all(got[k] == (0, k, True) for k in (4, 5, 6, 7, 8, 9, 10, 11))
    best = top_k(df, F.col("vec_id") == 1, 3).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in best] == [(3, 256 * 512 + 128 * 256), (2, 256 * 256 + 128 * 128), (4, 256 * 256 + 128 * 128)]
    assert threshold_components(df.limit(0)).count() == 0 and top_k(df.limit(0), F.col("vec_id") == 1).count() == 0


def test_random_vectors_against_brute_force(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([c + rng.normal(0, 0.05, (40, 8)) for c in rng.normal(0, 1, (6, 8))])
    df = spark.createDataFrame([(i, r.tolist(), 0) for i, r in enumerate(x)], "vec_id long, embedding array<double>, label int")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    want = ((u @ u.T) >= 0.98).sum(axis=1) - 1
    got = {r.vec_id: r.n_links for r in threshold_components(df).collect()}
    assert [got[i] for i in range(len(x))] == want.tolist() and want.max() > 3
