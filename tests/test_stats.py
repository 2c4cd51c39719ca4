"""Distributed building blocks against brute force (pandas / numpy)."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablelens.functions.stats import cumulative, exact_quantiles, modes, row_numbers, safe_corr


def _skewed(spark, n=3000, seed=1):
    rng = np.random.default_rng(seed)
    key = np.where(rng.random(n) < 0.34, "hot", rng.choice(["a", "b", "c", "d"], n))
    val = rng.integers(0, 500, n).astype(float)
    return pd.DataFrame({"k": key, "v": val, "id": np.arange(n)}), spark.createDataFrame(
        pd.DataFrame({"k": key, "v": val, "id": np.arange(n)}))


def test_row_numbers_match_pandas_with_hot_key(spark):
    pdf, df = _skewed(spark)
    got = row_numbers(df, ["k"], [F.col("v").desc(), F.col("id")], "rn").toPandas()
    exp = pdf.sort_values(["k", "v", "id"], ascending=[True, False, True])
    exp["rn"] = exp.groupby("k").cumcount() + 1
    m = got.merge(exp, on="id", suffixes=("", "_e"))
    assert len(m) == len(pdf)
    assert (m["rn"] == m["rn_e"]).all()


def test_cumulative_weighted(spark):
    pdf, df = _skewed(spark, seed=2)
    vc = df.groupBy("k", "v").agg(F.count(F.lit(1)).alias("cnt"))
    got = cumulative(vc, ["k"], [F.col("v")], "cnt", "c").toPandas().sort_values(["k", "v"])
    exp = pdf.groupby(["k", "v"]).size().rename("cnt").reset_index().sort_values(["k", "v"])
    exp["c"] = exp.groupby("k")["cnt"].cumsum()
    assert got["c"].tolist() == exp["c"].tolist()


def test_exact_quantiles_match_numpy(spark):
    pdf, df = _skewed(spark, seed=3)
    probs = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]
    got = exact_quantiles(df, ["k"], "v", probs).toPandas()
    for (k, p), row in got.set_index(["k", "prob"]).iterrows():
        assert abs(row["q"] - np.percentile(pdf.loc[pdf.k == k, "v"], p * 100)) < 1e-9


def test_modes_smallest_on_ties(spark):
    df = spark.createDataFrame([("x", 3.0), ("x", 1.0), ("x", 3.0), ("x", 1.0), ("y", 5.0)], "k string, v double")
    got = {r["k"]: r["mode"] for r in modes(df, ["k"], "v").collect()}
    assert got == {"x": 1.0, "y": 5.0}


def test_safe_corr_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, 4.0)], "a double, b double")
    assert df.agg(safe_corr("a", "b").alias("c")).first()["c"] is None


def test_top_k_matches_pandas_with_hot_key(spark):
    from tablelens.functions.stats import top_k
    pdf, df = _skewed(spark, seed=3)
    got = top_k(df, ["k"], [F.col("v").desc(), F.col("id")], 7, "rank").toPandas()
    exp = pdf.sort_values(["k", "v", "id"], ascending=[True, False, True])
    exp["rank"] = exp.groupby("k").cumcount() + 1
    exp = exp[exp["rank"] <= 7]
    key = ["k", "id", "rank"]
    assert sorted(map(tuple, got[key].values.tolist())) == sorted(map(tuple, exp[key].values.tolist()))


def test_top_k_plans_a_partial_group_limit(spark):
    from tablelens.functions.stats import top_k
    _, df = _skewed(spark, seed=4)
    plan = top_k(df, ["k"], [F.col("v").desc(), F.col("id")], 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_ecdf_points_with_hot_value(spark):
    from tablelens.operators.describe import ecdf_values
    rng = np.random.default_rng(5)
    x = np.where(rng.random(4000) < 0.34, 7.0, rng.normal(0, 10, 4000).round(3))
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    for n in (50, 5000):
        got = ecdf_values(df, ["x"], n).orderBy("i").toPandas()
        s = np.sort(x)
        m = min(len(s), n)
        idx = [i if len(s) <= n else (len(s) - 1 if i == n - 1 else int(np.floor(i * ((len(s) - 1) / (n - 1)))))
               for i in range(m)]
        assert got["i"].tolist() == list(range(m))
        assert np.array_equal(got["x"].to_numpy(), s[idx])


def test_single_valued(spark):
    from tablelens.operators.schema import single_valued
    df = spark.createDataFrame([(1, None, "a", float("nan")), (1, None, "b", 2.0), (1, None, None, 2.0)],
                               "a long, b string, c string, d double")
    row = df.agg(*[single_valued(df, c).alias(c) for c in df.columns]).first()
    assert (row["a"], row["b"], row["c"], row["d"]) == (True, True, False, True)


def test_exact_sum_keeps_tiny_huge_and_infinite_values(spark):
    from pyspark.sql import functions as F
    from tablelens.functions.stats import exact_sum
    total = lambda *v: spark.createDataFrame([(x,) for x in v], "x double").agg(exact_sum(F.col("x")).alias("s")).first().s
    assert total(*[4e-7] * 5) == pytest.approx(2e-6, rel=1e-9)
    assert total(float("inf"), 1.0) == float("inf")
    assert total(1e33, 1.0) == 1e33
    assert total(0.1, 0.2, 0.3, None) == 0.6
    assert total(None, None) is None
