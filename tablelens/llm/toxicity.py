"""Toxicity by a linear classifier that is penalised where swapping identity terms changes its score."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelens.llm.common import stored
from tablelens.llm.sample import beside, labelled, sigmoid

# Words that name groups of people, by kind; members of one kind are swapped for each other.
IDENTITY = {
    "people": "person people human humans someone everyone".split(),
    "religion": "christian christians muslim muslims jewish jews hindu hindus buddhist buddhists atheist atheists catholic catholics".split(),
    "origin": "african africans american americans arab arabs asian asians chinese european europeans indian indians "
              "jewish latino latinos mexican mexicans immigrant immigrants refugee refugees".split(),
    "colour": "black white brown".split(),
    "gender": "man men woman women male males female females girl girls boy boys transgender trans".split(),
    "orientation": "gay gays lesbian lesbians homosexual homosexuals heterosexual heterosexuals bisexual bisexuals queer straight".split(),
    "condition": "blind deaf disabled elderly old young".split(),
}
#: ASCII letters lower-cased, other ASCII that is not a letter or digit turned into a space.
FOLD = bytes(ord(c.lower()) if (c := chr(b)).isalnum() or b > 127 else 32 for b in range(128)) + bytes(range(128, 256))


def words(text: str | None) -> set[bytes]:
    return set((text or "").encode("utf-8", "surrogatepass").translate(FOLD).split())


def choose(bags: list[set[bytes]], y: np.ndarray, features: int, least: int, evidence: float) -> list[bytes]:
    """The ``features`` words whose presence tells the classes apart best (chi-square, at least
    ``evidence``), among those in at least ``least`` texts."""
    n, pos = len(y), y.sum()
    with_word, with_toxic = Counter(), Counter()
    for bag, k in zip(bags, y):
        with_word.update(bag)
        if k:
            with_toxic.update(bag)

    def power(w):
        a, m = with_toxic[w], with_word[w]
        e = m * pos / n
        return (a - e) ** 2 / (e * (1 - m / (n + 1)) + 1e-9)

    strong = [(-p, w) for w, m in with_word.items() if m >= least and (p := power(w)) >= evidence]
    return [w for _, w in sorted(strong)[:features]]


def reduced(text: str | None, terms: set[bytes]) -> tuple[set[bytes], list[set[bytes]]]:
    """What is learned from a whole text: its words, and the identity terms of each sentence that holds one."""
    sentences = (text or "").replace("!", ".").replace("?", ".").replace("\n", ".").split(".")
    return words(text), [present for s in sentences if (present := words(s) & terms)]


def terms_of(identity: dict[str, list[str]]) -> set[bytes]:
    return {w.encode() for kind in identity.values() for w in kind}


def fit(sample: list[tuple[str, int]], *settings) -> dict:
    """:func:`fit_reduced` from texts."""
    terms = terms_of(settings[5])
    return fit_reduced([(*reduced(t, terms), y) for t, y in sample], *settings)


def fit_reduced(sample: list[tuple[set[bytes], list[set[bytes]], int]], features: int, least: int, evidence: float, ridge: float,
                fairness: float, identity: dict[str, list[str]]) -> dict:
    """:func:`fit_chosen` with the words chosen here."""
    bags = [bag for bag, _, _ in sample]
    y = np.array([k for *_, k in sample], float)
    chosen = choose(bags, y, features, least, evidence) if len(set(y.tolist())) == 2 else []
    return fit_chosen(sample, chosen + sorted(terms_of(identity) & set().union(*bags)), ridge, fairness, identity)


def fit_chosen(sample: list[tuple[set[bytes], list[set[bytes]], int]], chosen: list[bytes], ridge: float,
               fairness: float, identity: dict[str, list[str]], rounds: int = 300) -> dict:
    """Word weights and intercept. Loss: mean log loss + ridge + fairness * mean squared score change between
    a sentence and its copies with an identity term swapped for the others of its kind."""
    y = np.array([k for *_, k in sample], float)
    if len(set(y.tolist())) < 2:
        return {"weights": {}, "offset": math.log((y.sum() + 1) / (len(y) - y.sum() + 1)), "terms": []}
    bags = [bag for bag, _, _ in sample]
    kinds = [[w.encode() for w in kind] for kind in identity.values()]
    terms = {w for kind in kinds for w in kind}
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(chosen))}
    at = [np.array(sorted(vocabulary[w] for w in bag if w in vocabulary), np.int64) for bag in bags]
    rows = np.repeat(np.arange(len(at)), [len(a) for a in at])
    cols = np.concatenate([*at, np.empty(0, np.int64)])
    # swapped sentences: the score changes by the difference of two words' weights
    swaps = Counter()
    for _, sentences, _ in sample:
        for present in sentences:
            for kind in kinds:
                for old in present & set(kind):
                    for new in kind:
                        if new not in present:
                            swaps[vocabulary[old], vocabulary.get(new, -1)] += 1
    pairs = np.array(list(swaps), np.int64).reshape(-1, 2)
    weight = np.array(list(swaps.values()), float)
    weight = weight / weight.sum() if len(weight) else weight
    w, b = np.zeros(len(vocabulary) + 1), 0.0  # the last word stands for terms outside the vocabulary and stays 0
    m, v, n = np.zeros(len(w) + 1), np.zeros(len(w) + 1), len(y)
    balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for step in range(1, rounds + 1):
        p = sigmoid(np.bincount(rows, w[cols], n) + b)
        g = balance * (p - y) / n
        gradient = np.bincount(cols, g[rows], len(w)) + ridge * w
        if len(pairs):
            change = 2 * fairness * weight * (w[pairs[:, 0]] - w[pairs[:, 1]])
            gradient += np.bincount(pairs[:, 0], change, len(w)) - np.bincount(pairs[:, 1] % len(w), change, len(w))
        gradient[-1] = 0
        full = np.append(gradient, g.sum())
        m, v = 0.9 * m + 0.1 * full, 0.999 * v + 0.001 * full * full
        move = 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return {"weights": {word: float(w[i]) for word, i in vocabulary.items() if abs(w[i]) > 1e-4}, "offset": float(b),
            "terms": sorted(t.decode() for t in terms & vocabulary.keys())}


def logit(model: dict, text: str | None) -> float:
    weights = model["weights"]
    return model["offset"] + math.fsum(weights[w] for w in words(text) & weights.keys())


def learned(docs: DataFrame, labels: DataFrame, learn: Column, per_class: int, settings: tuple, label: str, id_col: str, text_col: str) -> dict:
    """The model of a bounded labelled sample, learned from whole texts in two passes over it.

    The first counts the texts of each class that hold a word, and keeps the ``features`` words that :func:`choose` would. The second
    reduces each text to the kept words and to the identity terms of its sentences, as numbers; only these reach the driver."""
    features, least, evidence, ridge, fairness, identity = settings
    terms = terms_of(identity)
    drawn = stored(labelled(docs, labels, label, learn, per_class, id_col, text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "y"),
                   "labelled")
    n, pos = (int(v or 0) for v in drawn.agg(F.count("y"), F.sum("y")).first())
    if pos in (0, n):
        return fit_chosen([(set(), [], 1)] * pos + [(set(), [], 0)] * (n - pos), [], ridge, fairness, identity)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist()):
                own = sorted(words(t))
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), pa.array([y] * len(own), pa.int32())], ["word", "y"])

    counts = stored(drawn.mapInArrow(spell, "word binary, y int").groupBy("word").agg(F.count("y").alias("m"), F.sum("y").alias("a")), "words")
    e = F.col("m") * F.lit(pos) / F.lit(n)
    power = (F.col("a") - e) * (F.col("a") - e) / (e * (1 - F.col("m") / F.lit(n + 1)) + 1e-9)
    strong = counts.where(F.col("m") >= least).withColumn("p", power).where(F.col("p") >= evidence).orderBy(F.desc("p"), "word").limit(features)
    chosen = [bytes(r.word) for r in strong.select("word", "p").collect()]
    present = {bytes(r.word) for r in counts.where(F.col("word").isin([bytearray(t) for t in sorted(terms)])).select("word").collect()}
    vocabulary = {w: k for k, w in enumerate(dict.fromkeys(chosen + sorted(present)))}

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = pa.list_(pa.int32())
        for b in batches:
            got = [reduced(t, terms) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([sorted(vocabulary[w] for w in own if w in vocabulary) for own, _ in got], lists),
                 pa.array([[sorted(vocabulary[w] for w in p) for p in s] for _, s in got], pa.list_(lists)), b.column("y")],
                ["doc_id", "words", "sentences", "y"])

    rows = drawn.mapInArrow(reduce, "doc_id long, words array<int>, sentences array<array<int>>, y int").collect()
    rows.sort(key=lambda r: r.doc_id)
    name = list(vocabulary)
    return fit_chosen([({name[k] for k in r.words}, [{name[k] for k in p} for p in r.sentences], r.y) for r in rows], name, ridge, fairness, identity)


def score_toxicity(docs: DataFrame, labels: DataFrame, learn: Column, per_class: int = 3000,
                   features: int = 600, least: int = 3, evidence: float = 10.0, ridge: float = 2e-3, fairness: float = 1.0,
                   identity: dict[str, list[str]] = IDENTITY, label: str = "toxic",
                   id_col: str = "doc_id", text_col: str = "text", carry: str | None = None) -> DataFrame:
    """(doc_id, score) of every row; the score estimates the probability of label 1 at even odds. With ``carry``, all columns of ``docs`` as
    they are and the score under that name.

    Fitted on at most ``per_class`` documents of each class among those where ``learn`` holds, on their whole texts;
    every whole text is scored. Empty and null texts get the intercept's score. With
    labels of one class only, the score is that class's smoothed share. Repeated rows and equal texts are scored each and alike;
    a null id stays null; other columns are not read.
    """
    model = learned(docs, labels, learn, per_class, (features, least, evidence, ridge, fairness, identity), label, id_col, text_col)
    score = lambda texts: [sigmoid(np.array([logit(model, t) for t in texts], float))]
    if carry:
        return beside(docs, [pa.field(carry, pa.float64())], score, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return beside(rows, [pa.field("score", pa.float64())], score).select("doc_id", "score")
