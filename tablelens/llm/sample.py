"""Bounded labelled samples for the classifiers, and one-variable calibration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


def labelled(docs: DataFrame, labels: DataFrame, label: str, learn: Column, per_class: int,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, y) of at most ``per_class`` documents of each class 0 and 1, with their whole texts.

    Documents are drawn by a hash of their id among the labelled ones for which ``learn`` (on the
    column ``doc_id``) holds. Ids are drawn first, so only the drawn rows' texts move; what is learned from a text
    is to be made of it in the tasks, so that no text has to reach the driver. Rows that share an id are one document."""
    ids = docs.select(F.col(id_col).alias("doc_id")).distinct()
    marked = (labels.select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1))
              .where(learn).groupBy("doc_id").agg(F.max("y").alias("y")).join(ids, "doc_id", "left_semi"))
    drawn = None
    for y in (0, 1):
        own = marked.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        drawn = own if drawn is None else drawn.unionByName(own)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # at most 2 * per_class ids
    return texts.join(F.broadcast(drawn), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))


def beside(docs: DataFrame, more: list[pa.Field], make, text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` as they are, and those that ``make`` (texts) gives as arrays for ``more``: every row is
    judged by itself, whatever its id. The new columns' names must be free."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = make(b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(v, f.type) for v, f in zip(new, more)]], [*b.schema.names, *[f.name for f in more]])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *[StructField(f.name, DoubleType()) for f in more]]))


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic regression by Newton steps; the last one is the intercept, not penalised.

    Calibration: one or a few columns, standardised by the caller's scale."""
    x = np.column_stack([x, np.ones(len(y))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge * len(y))
    penalty[-1] = 1e-9
    for _ in range(rounds):
        p = sigmoid(x @ w)
        gradient = x.T @ (p - y) + penalty * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty) + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w
