"""Quality by compression: texts are compressed with a dictionary of good and one of bad texts."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelens.llm.common import stored
from tablelens.llm.sample import beside, labelled, logistic, sigmoid

SMALL = 40  # bytes
PIECE = 2048  # bytes compressed at once, so that the dictionary counts as much at a long text's end


def pieces(text: str | None) -> list[bytes]:
    """The whole text in pieces of PIECE bytes."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return [data[i:i + PIECE] for i in range(0, len(data), PIECE)]


class Sizes:
    """Compressed sizes of a text under the good and the bad dictionary."""

    def __init__(self, good: bytes, bad: bytes, level: int):
        self.by = [zstandard.ZstdCompressor(level=level, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(d))
                   for d in (good, bad)]
        self.frame = [len(c.compress(b"")) for c in self.by]

    def measure(self, text: str | None) -> tuple[float, float]:
        """The normalised difference (bad - good) / (bad + good) of the sizes without frame headers, and
        the log of their mean over the raw size. SMALL bytes are added to each size, so that a
        few bytes of a short text decide little; an empty text has 0 and 0."""
        cut = pieces(text)
        good, bad = (sum(len(c.compress(p)) - f for p in cut) for c, f in zip(self.by, self.frame))
        raw = sum(map(len, cut))
        return (bad - good) / (bad + good + 2 * SMALL), math.log((bad + good + 2 * SMALL) / (2 * raw + 2 * SMALL))


@functools.lru_cache(maxsize=2)
def sizes(good: bytes, bad: bytes, level: int) -> Sizes:
    return Sizes(good, bad, level)


def dictionary(own: list[bytes], size: int) -> bytes:
    """A dictionary trained on pieces of one class."""
    total = sum(map(len, own))
    try:
        return zstandard.train_dictionary(min(size, max(512, total // 4)), own).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself is the dictionary
        return b"".join(own)[-size:]


def terms(x: np.ndarray) -> np.ndarray:
    """Calibration variables: the difference, and the compressibility with its square (text that
    repeats itself compresses well under either dictionary, so its difference says little)."""
    return np.column_stack([10 * x[:, 0], x[:, 1], x[:, 1] ** 2])


def learned(docs: DataFrame, labels: DataFrame, learn: Column, per_class: int, per_dictionary: int, dictionary_bytes: int, level: int,
            label: str, id_col: str, text_col: str) -> tuple[dict | None, float]:
    """The model of a bounded labelled sample (None without both classes), and the smoothed share of label 1 in it.

    Two thirds of the documents give pieces to the dictionaries, drawn by hash from anywhere in their texts; the others are
    measured whole, in tasks, and calibrate the score."""
    drawn = stored(labelled(docs, labels, label, learn, per_class, id_col, text_col), "labelled")
    held = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(3)) == 0
    counts = {(r.held, r.y): r["count"] for r in drawn.groupBy(held.alias("held"), "y").count().collect()}
    share = (sum(n for (_, y), n in counts.items() if y) + 1) / (sum(counts.values()) + 2)
    if any(not counts.get((h, y)) for h in (True, False) for y in (0, 1)):
        return None, share

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                own = pieces(t)
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([i] * len(own), pa.int64()), "at": pa.array(range(len(own)), pa.int64()),
                                                  "piece": pa.array(own, pa.binary())})

    trained = []
    for y in (1, 0):
        own = drawn.where(~held & (F.col("y") == y)).select(F.col("doc_id").cast("long").alias("doc_id"), "text") \
            .mapInArrow(cut, "doc_id long, at long, piece binary").orderBy(F.xxhash64("doc_id", "at"), "doc_id", "at").limit(per_dictionary)
        trained.append(dictionary([bytes(r.piece) for r in own.collect()], dictionary_bytes))
    good, bad = trained

    def measure(texts):
        z = sizes(good, bad, level)
        return np.array([z.measure(t) for t in texts], float).reshape(-1, 2).T

    rows = beside(drawn.where(held).select("doc_id", "text", "y"), [pa.field("d", pa.float64()), pa.field("c", pa.float64())], measure) \
        .select("doc_id", "y", "d", "c").collect()
    rows.sort(key=lambda r: r.doc_id)
    x, y = np.array([(r.d, r.c) for r in rows]), np.array([r.y for r in rows], float)
    return {"good": good, "bad": bad, "calibration": logistic(terms(x), y), "level": level}, share


def score_quality(docs: DataFrame, labels: DataFrame, learn: Column, per_class: int = 3000, per_dictionary: int = 8000,
                  dictionary_bytes: int = 65_536, level: int = 3, label: str = "quality",
                  id_col: str = "doc_id", text_col: str = "text", carry: str | None = None) -> DataFrame:
    """(doc_id, difference, score) of every row; the score estimates the probability of label 1. With ``carry``, all columns of ``docs`` as
    they are and the score under that name.

    Fitted on at most ``per_class`` documents of each class among those where ``learn`` holds, and each dictionary on at
    most ``per_dictionary`` pieces drawn from their whole texts; every whole text is scored. Empty and null texts have
    difference 0 and get the calibrated score of that. With labels of one class only, the score is the class's smoothed share.
    Repeated rows and equal texts are scored each and alike; a null id stays null; other columns are not read.
    """
    model, share = learned(docs, labels, learn, per_class, per_dictionary, dictionary_bytes, level, label, id_col, text_col)

    def score(texts):
        z = sizes(model["good"], model["bad"], model["level"]) if model else None
        x = np.array([z.measure(t) if z else (0.0, 0.0) for t in texts], float).reshape(-1, 2)
        w = model and model["calibration"]
        return [x[:, 0], sigmoid(terms(x) @ w[:-1] + w[-1]) if model else np.full(len(x), share)]

    double = pa.float64()
    if carry:
        return beside(docs, [pa.field(carry, double)], lambda texts: score(texts)[1:], text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return beside(rows, [pa.field("difference", double), pa.field("score", double)], score).select("doc_id", "difference", "score")
