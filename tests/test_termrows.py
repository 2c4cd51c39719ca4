import math

import numpy as np
from pyspark.sql import functions as F

from tablelens.operators import retrieval as V
from tablelens.operators import svd, termrows

DOCS = [(1, "oak elm oak"), (2, "fir oak"), (2, "elm elm fir"), (None, "ash oak"), (None, "ash"), (3, ""), (4, None), (5, "oak elm oak")]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_weights_of_single_ids_are_not_shuffled(spark):
    docs = spark.createDataFrame([r for r in DOCS if r[0] not in (2, None)], "id int, body string")
    w = V.tfidf(docs, "id", "body")
    assert "Exchange" not in _plan(w) and w.count() == 4  # before: a shuffle of every term and a window over each id
    tf = V.term_rows(docs, "id", "body")
    queries = V.transform_tfidf(docs, "id", "body", V.fit_idf(docs, "id", "body")).withColumnRenamed("id", "q")
    hits = V.search(V.weight_rows(tf, V.fit_idf(docs, "id", "body")), "id", queries, "q", 1).collect()
    assert sorted(map(tuple, hits)) == [(1, 1, 1.0, 1), (5, 1, 1.0, 1)]


def test_repeated_ids_are_counted_together(spark):
    docs = spark.createDataFrame(DOCS, "id int, body string")
    counts = sorted(map(tuple, V.term_rows(docs, "id", "body").long().collect()), key=repr)
    assert counts == sorted(map(tuple, V.term_counts(docs, "id", "body").collect()), key=repr)
    joined = V.transform_tfidf(docs, "id", "body", V.fit_idf(docs, "id", "body"), V.term_counts(docs, "id", "body"))
    rows = V.weight_rows(V.term_rows(docs, "id", "body"), V.fit_idf(docs, "id", "body"))
    own = lambda t: {(r[0], r[1]): round(r[2], 9) for r in t.collect()}
    assert own(V.tfidf(docs, "id", "body")) == own(joined)
    q = joined.withColumnRenamed("id", "q").where("q is not null")
    assert sorted(V.search(rows, "id", q, "q", 3).collect(), key=repr) == sorted(V.search(joined, "id", q, "q", 3).collect(), key=repr)


def test_dense_scores_are_those_of_ordered_sums(spark):
    rng = np.random.RandomState(2)
    m = rng.standard_normal((300, 7))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(300, None), (301, [1.0, None] + [1.0] * 5), (302, [0.0] * 7), (303, [1.0]),
                                                                      (304, [math.nan] * 7), (None, [float(x) for x in m[0]])]
    vec = spark.createDataFrame(rows, "vid int, v array<double>").repartition(3)
    q = vec.where("vid in (0, 5, 302, 303)").select(F.col("vid").alias("q"), F.col("v").alias("qv"))
    got = sorted(map(tuple, V.dense_topk(vec, "vid", "v", q, "q", "qv", 4).collect()), key=repr)
    pairs = q.crossJoin(vec).withColumn("score", V.cosine(F.col("qv"), F.col("v"))).where("score > 0").withColumn("score", F.round("score", 6))
    want = V.top_k(pairs, ["q"], [F.col("score").desc(), F.col("vid")], 4).select("q", "vid", "score", "rank")
    assert got == sorted(map(tuple, want.collect()), key=repr) or repr(got) == repr(sorted(map(tuple, want.collect()), key=repr))
    assert "Generate" not in _plan(V.dense_topk(vec, "vid", "v", q, "q", "qv", 4))  # before: one row a pair left the scan


def test_queries_in_several_batches(spark, monkeypatch):
    vec = spark.range(40).select("id", F.array(F.cos(F.col("id") / 5), F.sin(F.col("id") / 5)).alias("v"))
    q = vec.select(F.col("id").alias("q"), F.col("v").alias("qv"))
    once = sorted(map(tuple, V.dense_topk(vec, "id", "v", q, "q", "qv", 3).collect()))
    monkeypatch.setattr(V, "MAX_DENSE_QUERIES", 9)
    monkeypatch.setattr(termrows, "QUERIES", 4)
    assert sorted(map(tuple, V.dense_topk(vec, "id", "v", q, "q", "qv", 3).collect())) == once and len(once) == 120


def test_partial_products_do_not_grow_with_the_files(spark, monkeypatch):
    weights = spark.range(400).select("id", F.concat(F.lit("t"), F.col("id") % 7).alias("term"), F.lit(1.0).alias("weight"))
    rows = svd._rows(weights.repartition(50), "id", sorted(r[0] for r in weights.select("term").distinct().collect())).repartition(50)
    seen = []
    whole = type(rows).mapInArrow
    monkeypatch.setattr(type(rows), "mapInArrow", lambda df, *a, **k: (seen.append(df.rdd.getNumPartitions()), whole(df, *a, **k))[1])
    z = svd._gram_times(rows, np.eye(7))
    assert seen[0] <= spark.sparkContext.defaultParallelism and np.allclose(np.diag(z).sum(), 400)  # before: one partial sum of each of 50 parts
