"""Texts as rows of terms, weighed and searched in Arrow batches.

A text's terms stay in its own row, ``(id, terms, counts)`` and then ``(id, terms, weights)``, so neither counting, nor
weighing, nor scoring shuffles one row per term. A search keeps, per task, each query's best scores so far; only rows that
can still be among them leave the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.functions.columns import col
from tablelens.functions.stats import materialize

TEXTS = 1024  # texts counted at once
BLOCK = 128  # rows multiplied at once
QUERIES = 256  # queries scored at once
SLACK = 2e-6  # scores further apart than this stay so when they are rounded to six decimals
MAX_BROADCAST_IDS = 2_000_000


def flat(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The values of a list column one after the other, and the length of each list (0 for null)."""
    return lists.flatten(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def listed(values: pa.Array, lens: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lens)]), pa.int32()), values)


def numbers(values: np.ndarray) -> pa.ListArray:
    """A matrix as one list of doubles a row."""
    return listed(pa.array(np.ascontiguousarray(values, float).ravel(), pa.float64()), np.full(len(values), values.shape[1]))


def dense(lens: np.ndarray, place: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(matrix, terms): sparse rows as a small dense matrix over the terms they hold; a repeated term is summed."""
    terms, at = np.unique(place, return_inverse=True)
    a = np.zeros((len(lens), len(terms)))
    np.add.at(a, (np.repeat(np.arange(len(lens)), lens), at), weight)
    return a, terms


def schema_of(df: DataFrame, names, **types: str) -> T.StructType:
    """The named columns of a table, and new ones."""
    old = [df.schema[n] for n in names]
    return T.StructType([T.StructField(f.name, f.dataType) for f in old] + list(T._parse_datatype_string(", ".join(f"{n} {t}" for n, t in types.items()))))


def _kept(batch: pa.RecordBatch, names) -> list[pa.Array]:
    return [batch.column(batch.schema.get_field_index(n)) for n in names]


def count_in_rows(tokens: DataFrame, stop_words, names) -> DataFrame:
    """(names..., terms array<string>, counts array<int>) of a table with an array ``tokens``: each row's distinct terms in
    their order and how often they occur."""
    stop, names = list(stop_words), list(names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS):
                b = whole.slice(at, TEXTS)
                values, lens = flat(b.column(b.num_columns - 1))
                coded = pc.dictionary_encode(values)
                words = coded.dictionary
                order = pc.sort_indices(words).to_numpy()
                rank = np.empty(len(words), np.int64)
                rank[order] = np.arange(len(words))
                used = ~pc.is_in(words, value_set=pa.array(stop, words.type)).to_numpy(zero_copy_only=False).astype(bool)
                code = coded.indices.to_numpy(zero_copy_only=False)
                keep = used[code] if len(words) else np.zeros(0, bool)
                row = np.repeat(np.arange(len(lens)), lens)[keep]
                key, n = np.unique(row * max(len(words), 1) + rank[code[keep]], return_counts=True)
                row, place = key // max(len(words), 1), key % max(len(words), 1)
                own = np.bincount(row, minlength=len(lens))
                terms = words.take(pa.array(order)).take(pa.array(place))
                yield pa.RecordBatch.from_arrays([*_kept(b, names), listed(terms, own), listed(pa.array(n, pa.int32()), own)], [*names, "terms", "counts"])

    return tokens.mapInArrow(count, schema_of(tokens, names, terms="array<string>", counts="array<int>"))


def weigh(counted: DataFrame, terms: pa.Array, idf: np.ndarray, places: bool = False) -> DataFrame:
    """The rows with tf*idf weights of unit length in place of the counts, known terms only: (..., terms, weights), or with
    ``places`` (..., idx array<int>, w array<double>) by the terms' places in the vocabulary."""
    names = [c for c in counted.columns if c not in ("terms", "counts")]
    words = counted.sparkSession.sparkContext.broadcast((terms.to_pylist(), np.asarray(idf, float)))

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, own_idf = pa.array(words.value[0], pa.string()), words.value[1]
        for b in batches:
            values, lens = flat(*_kept(b, ["terms"]))
            counts = flat(*_kept(b, ["counts"]))[0].to_numpy(zero_copy_only=False)
            place = pc.fill_null(pc.index_in(values, value_set=known.cast(values.type)), -1).to_numpy(zero_copy_only=False)
            keep = place >= 0
            row, place = np.repeat(np.arange(len(lens)), lens)[keep], place[keep]
            w = own_idf[place] * counts[keep]
            w = w / np.sqrt(np.bincount(row, w * w, len(lens)))[row]
            own = np.bincount(row, minlength=len(lens))
            first = pa.array(place, pa.int32()) if places else known.take(pa.array(place))
            yield pa.RecordBatch.from_arrays([*_kept(b, names), listed(first, own), listed(pa.array(w, pa.float64()), own)],
                                             [*names, *(("idx", "w") if places else ("terms", "weights"))])

    types = {"idx": "array<int>", "w": "array<double>"} if places else {"terms": "array<string>", "weights": "array<double>"}
    return counted.mapInArrow(weighed, schema_of(counted, names, **types))


def exploded(rows: DataFrame, keep, value: str, out: str) -> DataFrame:
    """(keep..., term, out): one row a term."""
    e = rows.select(*[col(c) for c in keep], F.explode(F.arrays_zip("terms", value)).alias("_e"))
    return e.select(*[col(c) for c in keep], F.col("_e.terms").alias("term"), F.col(f"_e.{value}").alias(out))


def split_repeated(rows: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame | None]:
    """(rows whose id occurs once, the others or None). Only ids are shuffled; nulls are one id."""
    repeated = materialize(rows.groupBy(id_col).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col(id_col).alias("_rep")))
    n = repeated.count()
    if not n:
        return rows, None
    few = F.broadcast(repeated) if n <= MAX_BROADCAST_IDS else repeated
    same = F.col(id_col).eqNullSafe(F.col("_rep"))
    return rows.join(few, same, "left_anti"), rows.join(few, same, "left_semi")


class Best:
    """Each query's ``k`` best scores so far in a task."""

    def __init__(self, queries: int, k: int):
        self.k, self.top = k, np.full((0, queries), -np.inf)

    def pick(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, query) of the positive scores (NaN counts as the largest) that can be among the best once rounded."""
        key = np.where(np.isnan(scores), np.inf, scores)
        top = np.concatenate([self.top, key])
        if len(top) > self.k:
            top = np.partition(top, len(top) - self.k, axis=0)[len(top) - self.k:]
        self.top = top
        floor = top.min(axis=0) - SLACK if len(top) == self.k else np.full(scores.shape[1], -np.inf)
        return np.nonzero((key >= floor) & (key > 0))


def _hits(b: pa.RecordBatch, id_col: str, query_id: str, ids: pa.Array, found: list) -> pa.RecordBatch:
    row, query, score = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    return pa.RecordBatch.from_arrays([ids.take(pa.array(query)), *(c.take(pa.array(row)) for c in _kept(b, [id_col])), pa.array(score, pa.float64())],
                                      [query_id, id_col, "score"])


def _one(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def sparse_scores(rows: DataFrame, id_col: str, queries: DataFrame, query_id: str, k: int) -> DataFrame:
    """(query_id, id, score): inner products of (id, terms, weights) rows with (query_id, term, qw) queries; of each task only
    what can be among a query's ``k`` best. The queries pass through the driver to every task; the caller bounds them."""
    own = queries.toArrow()
    coded = pc.dictionary_encode(_one(own.column(query_id)), null_encoding="encode")
    number, ids = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    term, weight = _one(own.column("term")), own.column("qw").to_numpy()
    groups = []
    for at in range(0, len(ids), QUERIES):
        mine = (number >= at) & (number < at + QUERIES)
        words = pc.dictionary_encode(term.filter(pa.array(mine)))
        groups.append((at, min(QUERIES, len(ids) - at), words.dictionary.to_pylist(), words.indices.to_numpy(zero_copy_only=False), number[mine] - at, weight[mine]))
    sent = rows.sparkSession.sparkContext.broadcast((ids, groups))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, groups = sent.value
        best = [Best(n, k) for _, n, *_ in groups]
        words = [pa.array(g[2], pa.string()) for g in groups]
        for b in batches:
            values, lens = flat(*_kept(b, ["terms"]))
            w = flat(*_kept(b, ["weights"]))[0].to_numpy(zero_copy_only=False)
            found = []
            for g, (at, n, _, place, query, qw) in enumerate(groups):
                m = np.zeros((len(words[g]), n))
                np.add.at(m, (place, query), qw)
                t = pc.fill_null(pc.index_in(values, value_set=words[g].cast(values.type)), -1).to_numpy(zero_copy_only=False)
                known = t >= 0
                row = np.repeat(np.arange(len(lens)), lens)[known]
                own, tk, wk = np.bincount(row, minlength=len(lens)), t[known], w[known]
                end = np.concatenate([[0], np.cumsum(own)])
                for lo in range(0, len(lens), BLOCK):
                    hi = min(lo + BLOCK, len(lens))
                    if end[lo] == end[hi]:
                        continue
                    a, terms = dense(own[lo:hi], tk[end[lo]:end[hi]], wk[end[lo]:end[hi]])
                    s = a @ m[terms]
                    r, q = best[g].pick(s)
                    found.append((r + lo, q + at, s[r, q]))
            yield _hits(b, id_col, query_id, ids, found)

    out = T.StructType([T.StructField(query_id, queries.schema[query_id].dataType), T.StructField(id_col, rows.schema[id_col].dataType), T.StructField("score", T.DoubleType())])
    return rows.select(id_col, "terms", "weights").mapInArrow(score, out)


def _vectors(lists: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Of the lists without null components, by length: (their places, their matrix)."""
    values, lens = flat(lists)
    x = values.to_numpy(zero_copy_only=False)
    end = np.concatenate([[0], np.cumsum(lens)])
    gaps = np.concatenate([[0], np.cumsum(values.is_null().to_numpy(zero_copy_only=False))])
    whole = (gaps[end[1:]] == gaps[end[:-1]]) & (lens > 0)
    return {int(n): (at, x[end[at][:, None] + np.arange(n)]) for n in np.unique(lens[whole]) for at in [np.nonzero(whole & (lens == n))[0]]}


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of ``a`` with those of ``b``, each summed in the order of the components."""
    acc = np.zeros((len(a), len(b)))
    for x, y in zip(a.T, b.T):
        acc += x[:, None] * y
    return acc


def _squares(a: np.ndarray) -> np.ndarray:
    acc = np.zeros(len(a))
    for x in a.T:
        acc += x * x
    return acc


def dense_scores(vectors: DataFrame, id_col: str, vec_col: str, queries: DataFrame, query_id: str, vec: str, k: int) -> DataFrame:
    """(query_id, id, score): cosines of array<double> vectors with the queries' vectors; of each task only what can be among
    a query's ``k`` best. Vectors that are null, zero, of another length or hold a null have no score. The queries pass
    through the driver to every task; the caller bounds them."""
    own = queries.select(query_id, vec).toArrow()
    ids = _one(own.column(query_id))
    sent = vectors.sparkSession.sparkContext.broadcast((ids, _vectors(_one(own.column(vec)))))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, groups = sent.value
        norms = {n: np.sqrt(_squares(m)) for n, (_, m) in groups.items()}
        best = {(n, at): Best(len(places[at:at + QUERIES]), k) for n, (places, _) in groups.items() for at in range(0, len(places), QUERIES)}
        for b in batches:
            found = []
            with np.errstate(all="ignore"):
                for n, (rows, x) in _vectors(*_kept(b, [vec_col])).items():
                    if n not in groups:
                        continue
                    places, m = groups[n]
                    own = np.sqrt(_squares(x))
                    for lo in range(0, len(rows), BLOCK):
                        for at in range(0, len(places), QUERIES):
                            part, mine = slice(lo, lo + BLOCK), slice(at, at + QUERIES)
                            by = norms[n][None, mine] * own[part, None]
                            s = np.where(by == 0, -np.inf, _dots(x[part], m[mine]) / by)
                            r, q = best[n, at].pick(s)
                            found.append((rows[part][r], places[mine][q], s[r, q]))
            yield _hits(b, id_col, query_id, ids, found)

    out = T.StructType([T.StructField(query_id, queries.schema[query_id].dataType), T.StructField(id_col, vectors.schema[id_col].dataType), T.StructField("score", T.DoubleType())])
    return vectors.select(id_col, vec_col).mapInArrow(score, out)
