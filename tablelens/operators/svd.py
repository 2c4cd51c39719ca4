"""Truncated SVD of a sparse TF-IDF table (V3), by randomized subspace iteration.

The right singular vectors live in term space, whose size is capped by the
vocabulary (``max_features``). Each iteration computes Z = W^T (W M) for a
small d x l matrix M: documents are scanned once, every partition multiplies
blocks of its own rows with numpy (Arrow batches) and emits one partial row per term it
touched, and the partials are summed by term in running sums of Arrow batches.
Only d x l matrices reach the driver, where they are orthonormalised.
The embedding of a document is its row times the top-k right singular
vectors (U*Sigma, as TruncatedSVD.transform), L2-normalised; a document
without any vocabulary term has no row in the weights table: it has the zero
vector where the documents are given, and no embedding otherwise.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.functions.stats import materialize
from tablelens.operators.termrows import BLOCK, dense, exploded, flat, listed, numbers, schema_of, weigh


def _rows(weights: DataFrame, id_col: str, terms: list[str]) -> DataFrame:
    """(id, idx array<int>, w array<double>): one sparse row per document (its
    terms only, bounded by the vocabulary), materialised for the repeated passes."""
    if "weights" in weights.columns:  # rows of terms already
        return materialize(_placed(weights, id_col, terms).where(F.size("idx") > 0))
    j = weights.join(F.broadcast(weights.sparkSession.createDataFrame(list(zip(terms, range(len(terms)))), "term string, t int")), "term")
    g = j.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("t", "weight"))).alias("e"))
    return materialize(g.select(id_col, F.transform("e", lambda s: s["t"]).alias("idx"),
                                F.transform("e", lambda s: s["weight"]).alias("w")))


def _placed(rows: DataFrame, id_col: str, terms: list[str]) -> DataFrame:
    """(id, terms, weights) rows as (id, idx, w), known terms only."""
    bc = rows.sparkSession.sparkContext.broadcast(terms)

    def place(batches):
        known = pa.array(bc.value, pa.string())
        for b in batches:
            values, lens = flat(b.column(1))
            at = pc.fill_null(pc.index_in(values, value_set=known.cast(values.type)), -1).to_numpy(zero_copy_only=False)
            keep = at >= 0
            own = np.bincount(np.repeat(np.arange(len(lens)), lens)[keep], minlength=len(lens))
            w = flat(b.column(2))[0].to_numpy(zero_copy_only=False)[keep]
            yield pa.RecordBatch.from_arrays([b.column(0), listed(pa.array(at[keep], pa.int32()), own), listed(pa.array(w, pa.float64()), own)], [id_col, "idx", "w"])

    return rows.select(id_col, "terms", "weights").mapInArrow(place, schema_of(rows, [id_col], idx="array<int>", w="array<double>"))


def _blocks(batch: pa.RecordBatch):
    """(rows, matrix, terms) of ``BLOCK`` sparse rows at a time; a block without terms has a matrix without columns."""
    values, lens = flat(batch.column(batch.num_columns - 2))
    w = flat(batch.column(batch.num_columns - 1))[0].to_numpy(zero_copy_only=False)
    idx, end = values.to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lens)])
    for at in range(0, len(lens), BLOCK):
        to = min(at + BLOCK, len(lens))
        yield slice(at, to), *dense(lens[at:to], idx[end[at]:end[to]], w[end[at]:end[to]])


def _gram_times(rows: DataFrame, m: np.ndarray) -> np.ndarray:
    """W^T (W m) for the sparse rows, m of shape (d, l)."""
    spark = rows.sparkSession
    bc = spark.sparkContext.broadcast(m)
    d, l = m.shape

    def some(acc):
        nz = np.nonzero(np.any(acc != 0, axis=1))[0]
        yield pa.RecordBatch.from_arrays([pa.array(nz, pa.int32()), numbers(acc[nz])], ["t", "v"])

    def partial(batches):
        mat, acc = bc.value, np.zeros((d, l))
        for b in batches:
            for _, a, terms in _blocks(b):
                acc[terms] += a.T @ (a @ mat[terms])
        yield from some(acc)

    def total(batches):
        acc = np.zeros((d, l))
        for b in batches:
            np.add.at(acc, b.column(0).to_numpy(), flat(b.column(1))[0].to_numpy().reshape(-1, l))
        yield from some(acc)

    # partial rows of a term meet in one task, which holds one running d x l sum: bounded by the vocabulary and k
    # one partial sum a core, however many files the rows have
    part = rows.select("idx", "w").coalesce(spark.sparkContext.defaultParallelism).mapInArrow(partial, "t int, v array<double>")
    summed = part.repartition("t").mapInArrow(total, "t int, v array<double>").toArrow()
    z = np.zeros((d, l))
    if summed.num_rows:
        z[summed.column("t").to_numpy()] = flat(summed.column("v").combine_chunks())[0].to_numpy().reshape(-1, l)
    bc.unpersist()
    return z


def _basis(rows: DataFrame, d: int, l: int, n_iter: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(q, q^T W^T W q): an orthonormal d x l basis after ``n_iter`` rounds of subspace iteration."""
    q = np.random.RandomState(seed).standard_normal((d, l))
    for _ in range(n_iter):
        q, _ = np.linalg.qr(_gram_times(rows, q))
    return q, q.T @ _gram_times(rows, q)


def _right_vectors(rows: DataFrame, d: int, k: int, oversample: int, n_iter: int, seed: int) -> np.ndarray:
    """The d x k top right singular vectors, k at most d - 1 (and at least 1)."""
    k = max(1, min(k, d - 1))
    q, gram = _basis(rows, d, min(k + oversample, d), n_iter, seed)
    evals, evecs = np.linalg.eigh(gram)  # W^T W restricted to span(q)
    return q @ evecs[:, np.argsort(evals)[::-1][:k]]


def _vocabulary(weights: DataFrame) -> list[str]:
    """The terms in their order (at most ``max_features``)."""
    terms = weights.select(F.explode("terms").alias("term")) if "weights" in weights.columns else weights.select("term")
    return sorted(r["term"] for r in terms.distinct().collect())


def fit_components(weights: DataFrame, id_col: str, k: int = 200, oversample: int = 10, n_iter: int = 3, seed: int = 42) -> DataFrame:
    """(term, vector array<double>): each term's row of the top-k right singular vectors of a sparse (id, term, weight) table,
    or of rows (id, terms, weights).

    k is at most the number of terms less one (and at least 1); a table without rows has no components. One row a
    term, written once, so that texts that come later are placed in the same space (:func:`fold_in`)."""
    terms = _vocabulary(weights)
    if not terms:
        return weights.sparkSession.createDataFrame([], "term string, vector array<double>")
    v = _right_vectors(_rows(weights, id_col, terms), len(terms), k, oversample, n_iter, seed)
    return materialize(weights.sparkSession.createDataFrame(pa.table({"term": pa.array(terms, pa.string()), "vector": numbers(v)})))


def _project(rows: DataFrame, id_col: str, v: np.ndarray) -> DataFrame:
    """(id, vector): the sparse rows times ``v``, L2-normalised; zero for a row without terms."""
    bc = rows.sparkSession.sparkContext.broadcast(v)

    def embed(batches):
        for b in batches:
            out = np.zeros((b.num_rows, bc.value.shape[1]))
            for at, a, terms in _blocks(b):
                out[at] = a @ bc.value[terms]
            yield pa.RecordBatch.from_arrays([b.column(0), numbers(out / (np.sqrt((out * out).sum(axis=1)) + 1e-9)[:, None])], [id_col, "vector"])

    return rows.select(id_col, "idx", "w").mapInArrow(embed, schema_of(rows, [id_col], vector="array<double>"))


def fold_in(weights: DataFrame, id_col: str, components: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """V4: (id, vector array<double>): the rows of a sparse table times the components (U * Sigma), L2-normalised.

    Terms that the components do not have are left out. With ``docs`` given, each of its ids has a row; one
    without a known term has the zero vector. The components (at most ``max_features`` x k numbers) are sent to every task."""
    table = components.orderBy("term").toArrow()
    terms, values = table.column("term").to_pylist(), flat(table.column("vector").combine_chunks())[0].to_numpy()
    k = len(values) // len(terms) if terms else 1
    rows = _rows(weights, id_col, terms)
    found = _project(rows, id_col, values.reshape(len(terms), k))
    if docs is None:
        return found
    # only ids move; a null id is one like any other
    other = docs.select(id_col).distinct().join(rows.select(F.col(id_col).alias("_found")),
                                                F.col(id_col).eqNullSafe(F.col("_found")), "left_anti")
    return found.unionByName(other.select(id_col, F.array_repeat(F.lit(0.0), k).alias("vector")))


def svd_embed(weights: DataFrame, id_col: str, k: int = 200, oversample: int = 10, n_iter: int = 3,
              seed: int = 42, docs: DataFrame | None = None) -> DataFrame:
    """V3: components fitted on a sparse (id, term, weight) table and its own rows placed in their space."""
    return fold_in(weights, id_col, fit_components(weights, id_col, k, oversample, n_iter, seed), docs)


def embed_texts(docs: DataFrame, id_col: str, text_col: str, k: int = 200, max_features: int = 5000,
                oversample: int = 10, n_iter: int = 3, seed: int = 42) -> DataFrame:
    """V2 and V3 in one go: (id, vector array<double>) of every row's text, in the SVD space of its TF-IDF weights.

    Terms are counted inside the rows, and a row stays a row all the way, so only the counts of the vocabulary are
    shuffled. The vocabulary (at most ``max_features`` terms) is sent to every task. Null and empty texts and those
    without a known term have the zero vector; rows that share an id each have a vector; an empty table gives no rows."""
    from tablelens.operators.retrieval import fit_idf, row_term_counts
    counted = materialize(row_term_counts(docs, id_col, text_col))
    idf = fit_idf(counted, id_col, text_col, max_features, exploded(counted, [id_col], "counts", "tf")).orderBy("term").toArrow()
    rows = materialize(weigh(counted, idf.column("term").combine_chunks(), idf.column("idf").to_numpy(), places=True))
    if not idf.num_rows:
        return rows.select(id_col, F.array(F.lit(0.0)).alias("vector"))
    return _project(rows, id_col, _right_vectors(rows, idf.num_rows, k, oversample, n_iter, seed))


def singular_values(weights: DataFrame, id_col: str, k: int, oversample: int = 10, n_iter: int = 3,
                    seed: int = 42) -> np.ndarray:
    """Top-k singular values (small array, for checks)."""
    terms = _vocabulary(weights)
    _, gram = _basis(_rows(weights, id_col, terms), len(terms), min(k + oversample, len(terms)), n_iter, seed)
    return np.sqrt(np.clip(np.sort(np.linalg.eigvalsh(gram))[::-1][:k], 0, None))
