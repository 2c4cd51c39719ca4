"""Samples by digest, the splittable CSV reader, the versioned index, projection into the SVD space, kernel densities."""

import csv
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablelens.operators import chartdata, retrieval, svd
from tablelens.sources import index_store, quoted_csv, readers, sampling

FIELDS = ["plain", 'a "b", c', "two\nlines", 'x\n\n\ny "q"', "", "l" + "\nm" * 60, "cr\r\nlf", "\n"]


@pytest.fixture
def tiny_splits(spark):
    """Splits of 64 bytes, so that records and even fields span several of them."""
    conf = {"spark.sql.files.maxPartitionBytes": "64", "spark.sql.files.openCostInBytes": "64"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_records_across_splits(spark, tmp_path, tiny_splits):
    want = []
    for f, end in enumerate(["\n", "\r\n"]):
        rows = [(10 * f + i, FIELDS[(3 * i + f) % len(FIELDS)], i / 8) for i in range(30)] + [(7, "te.xt", 0.5)]
        want += rows
        with open(tmp_path / f"f{f}.csv", "w", newline="") as h:
            w = csv.writer(h, lineterminator=end)
            w.writerow(["id", "te.xt", "v"])
            w.writerows(rows)
    assert quoted_csv.split_lines(spark, str(tmp_path)).rdd.getNumPartitions() > 20
    df = quoted_csv.read_quoted_csv(spark, str(tmp_path))
    assert [t for _, t in df.dtypes] == ["int", "string", "double", "string"]
    got = sorted((r[0], r[1] or "", r[2]) for r in df.collect())
    assert got == sorted(want)
    assert quoted_csv.corrupt_records(df).first() == (len(want), 0)
    assert readers.load_dataset(spark, str(tmp_path / "f0.csv")).columns == ["id", "te.xt", "v"]


def test_odd_csv(spark, tmp_path, tiny_splits):
    (tmp_path / "ragged.csv").write_text('a,b,c\n\n1,2\n3,"4\n5",6,7\na,b,c\n8,9,yes')
    df = quoted_csv.read_quoted_csv(spark, str(tmp_path / "ragged.csv"))
    rows = {r["_corrupt_record"]: r for r in df.collect()}
    assert set(rows) == {"1,2", '3,"4\n5",6,7', None} and quoted_csv.corrupt_records(df).first() == (4, 2)
    assert sorted(r["a"] for r in df.collect()) == ["1", "3", "8", "a"]  # a row equal to the header is a row
    (tmp_path / "header.csv").write_text("a,b\n")
    assert quoted_csv.read_quoted_csv(spark, str(tmp_path / "header.csv")).collect() == []
    (tmp_path / "types.csv").write_text("d,t,b,y\n1.5,2020-01-02 03:04:05,true,12:30\n-2,2021-01-01,FALSE,13:00\n")
    t = quoted_csv.read_quoted_csv(spark, str(tmp_path / "types.csv"))
    assert [x for _, x in t.dtypes][:4] == ["double", "timestamp", "boolean", "string"]


def test_samples(spark):
    rows = [(i % 40, None if i % 7 == 0 else "x" * (i % 5)) for i in range(400)] + [(99, "hot")] * 300
    df = spark.createDataFrame(rows, "a int, `b.c` string").repartition(5)
    digest = sorted((r[0], r[1], r[2]) for r in df.select(sampling.row_digest(sampling.cols(df), 42).alias("d"), *sampling.cols(df)).collect())
    for n in (0, 1, 57, 350, 650, 700, 900):
        got = sorted(map(tuple, sampling.sample_rows(df, n).collect()), key=repr)
        assert got == sorted(((a, b) for _, a, b in sorted(digest, key=lambda r: r[0])[:n]), key=repr), n
    assert sampling.sample_exact(df, 0.25).count() == 175 and sampling.sample_exact(df, 0.0).count() == 0
    a = sampling.sample_by_key(df, ["a"], 0.3)
    kept = {r[0] for r in a.collect()}
    assert 0 < len(kept) < 41 and a.count() == df.where(F.col("a").isin(*kept)).count()
    pairs = spark.createDataFrame([("ab", "c"), ("a", "bc"), (None, "n"), ("n", None)], "x string, y string")
    assert pairs.select(sampling.row_digest(sampling.cols(pairs))).distinct().count() == 4


def test_fingerprint_sees_copies(spark):
    one, two = spark.createDataFrame([(1, "x")], "a int, b string"), spark.createDataFrame([(1, "x")] * 3, "a int, b string")
    a, b = sampling.fingerprint(one).first(), sampling.fingerprint(two).first()
    assert a["xor_hash"] == b["xor_hash"] and a["sum_hash"] != b["sum_hash"]


def test_kde_against_every_value(spark):
    rng = np.random.RandomState(5)
    x = np.concatenate([rng.standard_normal(800), 50 + 0.01 * rng.standard_normal(50), [1e4]])
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),), (float("inf"),)], "x double")
    h = x.std(ddof=1) * len(x) ** -0.2
    grid = np.linspace(x.min(), x.max(), 50)
    want = np.exp(-0.5 * ((grid[:, None] - x) / h) ** 2).sum(axis=1) / (len(x) * h * math.sqrt(2 * math.pi))
    got = [r["density"] for r in chartdata.kde(df, "x", 50).orderBy("i").collect()]
    assert np.abs(np.array(got) - want).max() < 6e-9
    same = chartdata.kde(spark.createDataFrame([(2.0,)] * 5, "x double"), "x", 10).collect()
    assert len(same) == 10 and all(r["density"] is None and r["x"] == 2.0 for r in same)
    assert chartdata.kde(df.limit(0), "x").collect() == []


def test_scatter_points(spark):
    df = spark.createDataFrame([(i, 3.0 * i + 1) for i in range(100)] + [(5, None)], "x int, y double")
    rows = chartdata.scatter_points(df, "x", "y", 30).collect()
    assert len(rows) == 30 and all(r["fit"] == r["y"] for r in rows)
    assert all(r["fit"] is None for r in chartdata.scatter_points(df.where("x = 7"), "x", "y").collect())


def test_index_versions(spark, tmp_path):
    texts = [(1, "red apples fall"), (2, "green pears grow"), (3, "blue plums rot")]
    first = spark.createDataFrame(texts, "id int, body string")
    base = str(tmp_path / "index")
    assert index_store.create(base, first, "id", "body") == 0
    more = spark.createDataFrame([(2, "green apples"), (4, "red plums unknownword"), (3, "")], "id int, body string")
    assert index_store.add(spark, base, more) == 1
    now, before = index_store.load(spark, base), index_store.load(spark, base, 0)
    assert sorted((r["id"], r["text"]) for r in before.chunks.collect()) == texts
    assert sorted((r["id"], r["text"]) for r in now.chunks.collect()) == [(1, texts[0][1]), (2, "green apples"), (4, "red plums unknownword")]
    assert {r["term"] for r in now.weights.where("chunk_key = '4_0'").collect()} == {"red", "plums"}
    fitted = retrieval.transform_tfidf(now.chunks, "chunk_key", "text", now.vocabulary)
    ordered = lambda t: sorted((r["chunk_key"], r["term"], round(r["weight"], 9)) for r in t.collect())
    assert ordered(now.weights) == ordered(fitted)
    with pytest.raises(Exception):
        index_store.create(base, first, "id", "body")
    with pytest.raises(ValueError):
        index_store.load(spark, base, 7)


def test_fold_in(spark):
    rng = np.random.RandomState(3)
    w = np.where(rng.rand(60, 12) < 0.4, rng.rand(60, 12), 0.0)
    table = lambda m: spark.createDataFrame([(i, f"t{j:02d}", float(m[i, j])) for i in range(len(m)) for j in range(12) if m[i, j]],
                                            "id int, term string, weight double")
    c = svd.fit_components(table(w), "id", k=4, oversample=8, n_iter=6)
    new = np.where(rng.rand(9, 12) < 0.5, rng.rand(9, 12), 0.0)
    asked = table(new).unionByName(spark.createDataFrame([(3, "unseen", 1.0)], "id int, term string, weight double"))
    got = {r["id"]: np.array(r["vector"]) for r in svd.fold_in(asked, "id", c, spark.range(11).select(F.col("id").cast("int"))).collect()}
    v = np.linalg.svd(w, full_matrices=False)[2][:4].T
    place = new @ v
    place = place / np.linalg.norm(place, axis=1, keepdims=True)
    found = np.stack([got[i] for i in range(9)])
    assert np.abs(found @ found.T - place @ place.T).max() < 1e-6  # the same up to signs
    assert not got[10].any() and len(got) == 11
    assert svd.fit_components(table(w).limit(0), "id").count() == 0


def test_texts_to_vectors_without_a_weights_table(spark):
    words = ["oak", "elm", "fir", "ash", "yew", "pine", "palm"]
    texts = [(i, " ".join(words[(i * j + j // 2) % 7] for j in range(3 + i % 5))) for i in range(40)] + [(40, ""), (41, None), (41, "oak oak elm")]
    docs = spark.createDataFrame(texts, "id int, body string")
    counts = {(r["id"], tuple(r["terms"])): r["counts"] for r in retrieval.row_term_counts(docs, "id", "body").collect()}
    assert counts[(41, ("elm", "oak"))] == [1, 2] and counts[(40, ())] == counts[(41, ())] == []
    own = docs.where("id < 40")
    vectors = lambda t: np.stack([r["vector"] for r in t.orderBy("id").collect()])
    a = vectors(svd.embed_texts(own, "id", "body", k=3, oversample=4, n_iter=6))
    b = vectors(svd.svd_embed(retrieval.tfidf(own, "id", "body"), "id", k=3, oversample=4, n_iter=6))
    assert np.abs(a @ a.T - b @ b.T).max() < 1e-6
    rows = svd.embed_texts(docs, "id", "body", k=3).where("id >= 40").collect()
    assert sorted((r["id"], any(r["vector"])) for r in rows) == [(40, False), (41, False), (41, True)]
    assert svd.embed_texts(docs.limit(0), "id", "body").collect() == []


def test_lines_without_open_quotes_are_taken_as_they_are(spark, tmp_path):
    import pyarrow as pa
    lines = [(1, 0, "\r"), (1, 0, "a,b"), (1, 0, '"x, y",2'), (1, 0, ""), (2, 0, "a,b"), (2, 0, "3,4\r"), (2, 90, "5,6")]
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*zip(*rows), [False] * len(rows)], (
        pa.int64(), pa.int64(), pa.string(), pa.bool_()))], ["file", "block", "line", "opened"])
    want = [(1, 0, 0, True, "a,b"), (1, 0, 0, False, '"x, y",2'), (2, 0, 0, True, "a,b"), (2, 0, 0, False, "3,4\r"), (2, 90, 0, False, "5,6")]
    rows = lambda out: [tuple(r.values()) for b in out for r in b.to_pylist()]
    for cut in range(1, len(lines)):  # the state goes on between batches
        assert rows(quoted_csv._pieces(iter([batch(lines[:cut]), batch(lines[cut:])]))) == want, cut
    mixed = [(3, 0, "h"), (3, 0, '"open'), (3, 0, 'shut"'), (3, 0, "9")]
    assert rows(quoted_csv._pieces(iter([batch(mixed[:2]), batch(mixed[2:]), batch(lines)])))[:3] == [(3, 0, 0, True, "h"), (3, 0, 0, False, '"open\nshut"'), (3, 0, 0, False, "9")]
    assert quoted_csv._single_lines(batch(lines), None, False) is not None  # before: every line went through a loop, four times
    (tmp_path / "p.csv").write_text("a,b\n1,2\n3,4\n")
    plan = quoted_csv.records(spark, str(tmp_path / "p.csv"))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan


def test_types_are_told_without_failing_casts(spark):
    texts = ["12.7", "12.", " 12 ", "-5", "2147483648", "-2147483649", "9223372036854775808", "1e5", "-1.5e+3", "0x1p3", "NaN", "-inf", "12d", "1-2",
             "1995-01-02", "1995-01-02 03:04:05", "", "abc", "1-URGENT", "true", "FALSE", "1/2", "1,5"]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    shape = {"double": r"[0-9.]$|(?i)^[-+]?(nan|inf|infinity)$", "timestamp": r"^\d{4}-\d{2}-\d{2}"}
    for t in ("int", "bigint", "double", "timestamp"):
        cast = F.col("v").try_cast(t).isNotNull() & F.col("v").rlike(shape.get(t, ""))
        got = df.select("v", cast, quoted_csv._reads_as(F.col("v"), t)).collect()
        assert [r[0] for r in got if r[1]] == [r[0] for r in got if r[2]], t
    # before: each of these was cast, and the failure's exception took most of the time
    plan = df.select(quoted_csv._reads_as(F.col("v"), "int").alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" in plan
