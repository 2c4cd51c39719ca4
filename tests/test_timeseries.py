import numpy as np
from pyspark.sql import functions as F

from tablelens.operators import forecast as FC
from tablelens.operators import timeseries as TS


def test_series_and_trend(small_df):
    s = TS.build_time_series(small_df, "sold_at", "amount", "D")
    assert s.count() == 84
    t = TS.trend(s).first()
    assert t["direction"] in ("increasing", "decreasing", "flat")


def test_weekly_buckets_start_monday(small_df):
    s = TS.build_time_series(small_df, "sold_at", None, "W")
    assert {r[0] for r in s.select(F.dayofweek("bucket")).collect()} == {2}


def test_decompose_needs_two_periods(small_df):
    s = TS.build_time_series(small_df, "sold_at", "amount", "D")
    d = TS.decompose(s, freq="D").toPandas()
    assert len(d) == 84 and d["trend"].isna().sum() == 0
    assert abs(d.groupby(np.arange(84) % 7)["seasonal"].first().sum()) < 1e-3


def test_decompose_of_huge_values(spark):
    def trend(values):
        s = spark.createDataFrame(list(enumerate(values)), "i int, value double").selectExpr(
            "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(i) as bucket", "value", "1L as n_records")
        return [r["trend"] for r in TS.decompose(s, freq="D").orderBy("bucket").collect()][3:-3]

    assert np.allclose(trend([1e35] * 14), [1e35] * 8)
    assert trend([1.0] * 7 + [float("inf")] + [1.0] * 8) == [1.0] + [float("inf")] * 7 + [1.0] * 2


def _made(spark, values, keys=None):
    rows = [(k, i, v) for k in keys or ["a"] for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "k string, i int, value double").selectExpr(
        "k", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(i) as bucket", "value", "1L as n_records")


def test_decompose_carries_a_line_to_the_edges(spark):
    y = [3.0 * i + (i % 4) for i in range(24)]
    d = TS.decompose(_made(spark, y, ["a", "b"]), period=4, keys=["k"]).toPandas().sort_values(["k", "bucket"])
    assert len(d) == 48
    own = d[d.k == "a"]
    assert np.allclose(own.trend, [3.0 * i + 1.5 for i in range(24)], atol=1e-4) and np.allclose(own.resid, 0, atol=1e-4)


def test_rolling_mean_keeps_ones_after_a_huge_value(spark):
    got = TS.rolling_mean(_made(spark, [1e17, 1.0, 1.0, 1.0, float("inf"), 2.0, 2.0, 2.0]), 3).orderBy("bucket").toPandas()
    assert got.rolling_mean.tolist()[3] == 1.0 and got.rolling_mean.tolist()[7] == 2.0


def test_pairs_equal_single_series(small_df):
    both = TS.all_series(small_df, ["sold_at"], ["amount", "pieces"], "W")
    one = TS.build_time_series(small_df, "sold_at", "pieces", "W")
    assert sorted(both.where("metric = 'pieces'").select("bucket", "value", "n_records").collect()) == sorted(one.collect())
    assert TS.trend(both, ["metric"]).count() == 2 and TS.rolling_mean(both, keys=["metric"]).count() == both.count()


def test_moving_sum_keeps_small_digits(spark):
    from pyspark.sql import Window

    from tablelens.functions.stats import exact_sum
    df = spark.createDataFrame([(i, 4e-7) for i in range(5)], "i int, v double")
    got = df.select(exact_sum("v", Window.orderBy("i").rowsBetween(-1, 1)).alias("s")).collect()
    assert np.allclose([r.s for r in got], [8e-7, 12e-7, 12e-7, 12e-7, 8e-7], rtol=1e-9)


def _holt_numpy(y):
    best = None
    for a in FC.HOLT_ALPHA:
        for b in FC.HOLT_BETA:
            for p in FC.HOLT_PHI:
                lvl, tr, sse = y[1], y[1] - y[0], 0.0
                for v in y[2:]:
                    f = lvl + p * tr
                    sse += (v - f) ** 2
                    new = a * v + (1 - a) * f
                    tr = b * (new - lvl) + (1 - b) * p * tr
                    lvl = new
                if best is None or sse < best[0]:
                    best = (sse, lvl, tr, p)
    _, lvl, tr, p = best
    return [lvl + sum(p ** i for i in range(1, h + 1)) * tr for h in range(1, 6)]


def _arima_numpy(y):
    d = np.diff(y)
    best = None
    for ar in FC.ARIMA_GRID:
        for ma in FC.ARIMA_GRID:
            c = d.mean() * (1 - ar)
            dp, e, sse = d[0], 0.0, 0.0
            for x in d[1:]:
                e = x - c - ar * dp - ma * e
                sse += e * e
                dp = x
            if best is None or sse < best[0]:
                best = (sse, c, ar, ma, dp, e)
    _, c, ar, ma, dp, e = best
    out, level = [], y[-1]
    for _ in range(5):
        step = c + ar * dp + ma * e
        level += step
        out.append(level)
        dp, e = step, 0.0
    return out


def test_holt_and_arima_match_numpy(spark):
    rng = np.random.default_rng(3)
    y = np.cumsum(rng.normal(1, 3, 40)) + 100
    rows = [("k", i, float(v)) for i, v in enumerate(y)]
    s = spark.createDataFrame(rows, "key string, i int, value double").withColumn(
        "bucket", F.timestamp_seconds(F.col("i") * 86400).cast("timestamp_ntz"))
    h = [r["value"] for r in FC.holt_fit(s, ["key"]).orderBy("step").collect()]
    a = [r["value"] for r in FC.arima_fit(s, ["key"]).orderBy("step").collect()]
    assert np.allclose(h, np.round(_holt_numpy(y), 4), atol=2e-4)
    assert np.allclose(a, np.round(_arima_numpy(y), 4), atol=2e-4)


def test_forecast_simple(small_df):
    s = TS.build_time_series(small_df, "sold_at", "amount", "D")
    f = FC.forecast_simple(s).collect()
    assert len(f) == 10 and {r["method"] for r in f} == {"naive", "moving_average"}
