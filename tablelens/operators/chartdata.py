"""Chart-ready tables (H1-H10): what each chart computes, not how it is drawn."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.functions.columns import col

from tablelens.functions.stats import attach, materialize, melt, ranked_values, rnd, value_counts
from tablelens.operators.groups import label


def _x(c):
    v = col(c).try_cast("double")
    return F.when(~F.isnan(v), v)


def histogram(df: DataFrame, col: str, bins: int = 40) -> DataFrame:
    """H1: equal-width bins between min and max (max folded into the last bin),
    every bin present: (bin, lower, upper, count)."""
    x = df.select(_x(col).alias("x")).filter(F.col("x").isNotNull())
    mm = x.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    b = F.when(F.col("hi") == F.col("lo"), F.lit(1)).otherwise(
        F.least(F.floor((F.col("x") - F.col("lo")) / width) + 1, F.lit(bins))).cast("int")
    counts = attach(x, mm).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    grid = mm.select("lo", "hi", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    g = grid.join(counts, "bin", "left")
    return g.select(F.col("bin").cast("long"), rnd(F.col("lo") + (F.col("bin") - 1) * width).alias("lower"),
                    rnd(F.col("lo") + F.col("bin") * width).alias("upper"),
                    F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count"))


def ecdf(df: DataFrame, col: str) -> DataFrame:
    """H2: ECDF at every distinct value: (value, ecdf) = share of values <= value."""
    long = melt(df, [col]).filter(F.col("value").isNotNull() & ~F.isnan("value"))
    vc = value_counts(long, ["column"])
    cum = ranked_values(vc, ["column"], "value")
    n = vc.agg(F.sum("cnt").alias("_n"))
    return attach(cum, n).select("value", rnd(F.col("_end") / F.col("_n"), 6).alias("ecdf"))


TERMS = 12  # of the series around a box's centre; with boxes of half a bandwidth it is cut off below 3e-12 of the kernel's peak
REACH = 9.0  # bandwidths; the kernel is below 3e-18 of its peak beyond


def kde(df: DataFrame, col: str, points: int = 200) -> DataFrame:
    """H3: Gaussian KDE on ``points`` grid points between min and max, Scott
    bandwidth h = std * n^(-1/5): (i, x, density).

    Values are summed once into boxes of h / 2: a box keeps the power sums of its values' distances s
    from its centre, in bandwidths, and gives the kernel sum at t bandwidths from the centre as
    exp(-t^2 / 2) * sum over p of He_p(t) * sum(s^p) / p!, He_p the Hermite polynomials. A box only meets the
    grid points within ``REACH``, so no value is copied per grid point. Missing and non-finite values take no part; the
    density is null where all values are equal."""
    x = df.select(_x(col).alias("x")).filter(F.abs("x") < float("inf"))
    st = x.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.stddev_samp("x").alias("sd"), F.count(F.lit(1)).alias("n"))
    st = st.select("lo", "n", F.expr("nullif(sd * pow(nullif(n, 0), -0.2D), 0D)").alias("h"),
                   ((F.col("hi") - F.col("lo")) / (points - 1)).alias("step"))
    st = materialize(st.where("n > 0"))  # one row
    boxed = attach(x, st).withColumn("box", F.floor((F.col("x") - F.col("lo")) / (F.col("h") / 2))).where("box is not null")
    s = (F.col("x") - F.col("lo")) / F.col("h") - (F.col("box") + 0.5) / 2
    sums = boxed.select("box", s.alias("s")).groupBy("box").agg(
        F.array(*[F.sum(F.pow("s", F.lit(float(p)))) / float(math.factorial(p)) for p in range(TERMS)]).alias("sums"))
    met = attach(sums, st).withColumn("at", (F.col("box") + 0.5) / 2)  # bandwidths from the minimum
    first = F.greatest(F.lit(0), F.ceil((F.col("at") - REACH) * F.col("h") / F.col("step")))
    last = F.least(F.lit(points - 1), F.floor((F.col("at") + REACH) * F.col("h") / F.col("step")))
    met = met.withColumn("first", first.cast("int")).withColumn("last", last.cast("int")).where("first <= last") \
        .select("sums", "at", "h", "step", F.explode(F.sequence("first", "last")).alias("i")) \
        .withColumn("t", F.col("i") * F.col("step") / F.col("h") - F.col("at"))
    series = F.aggregate("sums", F.struct(F.lit(0.0).alias("before"), F.lit(1.0).alias("he"), F.lit(0.0).alias("p"), F.lit(0.0).alias("total")),
                         lambda a, m: F.struct(a["he"].alias("before"), (F.col("t") * a["he"] - a["p"] * a["before"]).alias("he"),
                                               (a["p"] + 1.0).alias("p"), (a["total"] + a["he"] * m).alias("total")),
                         lambda a: a["total"])
    d = met.groupBy("i").agg(F.sum(F.exp(-0.5 * F.col("t") * F.col("t")) * series).alias("k"))
    grid = st.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).join(d, "i", "left")
    density = F.coalesce("k", F.lit(0.0)) / (F.col("n") * F.col("h") * math.sqrt(2 * math.pi))
    return grid.select(F.col("i").cast("long"), rnd(F.col("lo") + F.col("i") * F.col("step"), 6).alias("x"),
                       rnd(F.when(F.col("h").isNotNull(), density), 8).alias("density"))


def box_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """H4: (column, n, min, q1, median, mean, q3, max, lower_fence, upper_fence, n_outside)."""
    from tablelens.functions.summary import column_table
    from tablelens.operators.describe import outside, tukey
    r = column_table(df, cols, {"q1": 0.25, "median": 0.5, "q3": 0.75},
                     lambda x, own: {"n_outside": outside(x, *tukey(own, "q1", "q3"))})
    r = r.withColumn("lf", F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))) \
         .withColumn("uf", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    return r.select("column", F.col("n").cast("long"), rnd("min").alias("min"), rnd("q1").alias("q1"),
                    rnd("median").alias("median"), rnd("mean").alias("mean"), rnd("q3").alias("q3"),
                    rnd("max").alias("max"), rnd("lf").alias("lower_fence"), rnd("uf").alias("upper_fence"),
                    F.col("n_outside").cast("long"))


def ols_line(df: DataFrame, x: str, y: str) -> DataFrame:
    """H5: least-squares line of y on x over rows where both are numeric:
    (n, slope, intercept, r2)."""
    s = df.select(_x(x).alias("x"), _x(y).alias("y")).filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    return s.agg(F.count(F.lit(1)).cast("long").alias("n"), rnd(F.regr_slope("y", "x"), 6).alias("slope"),
                 rnd(F.regr_intercept("y", "x"), 6).alias("intercept"), rnd(F.regr_r2("y", "x"), 6).alias("r2"))


def scatter_points(df: DataFrame, x: str, y: str, n: int = 2000, seed: int = 42) -> DataFrame:
    """H5: the points that a scatter chart draws, with the height of the least-squares line at each: (x, y, fit).

    The ``n`` points of smallest digest among the rows where both are numeric (all, if fewer); the line is
    fitted to all rows. A line that does not exist (fewer than two different x) leaves ``fit`` null."""
    from tablelens.sources.sampling import sample_rows
    s = df.select(_x(x).alias("x"), _x(y).alias("y")).filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    line = s.agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"))
    return attach(sample_rows(s, n, seed), line).select("x", "y", rnd(F.col("slope") * F.col("x") + F.col("intercept"), 2).alias("fit"))


def frequency_bar(df: DataFrame, col: str) -> DataFrame:
    """H6: value frequencies, highest first: (category, count, rank). The rank is
    a cumulative count over the (distinct) categories, range-partitioned."""
    from tablelens.functions.stats import row_numbers
    g = df.groupBy(label(col).alias("category")).agg(F.count(F.lit(1)).alias("count"))
    r = row_numbers(g, [], [F.col("count").desc(), F.col("category")], "rank")
    return r.select("category", F.col("count").cast("long"), F.col("rank").cast("long"))


_AGG = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count,
        "median": F.median}


def grouped_bar(df: DataFrame, x: str, color: str, y: str, agg: str = "mean") -> DataFrame:
    """H7: (x, color, value) = agg(y) per (x, color)."""
    f = _AGG.get(agg, F.avg)
    g = df.groupBy(label(x).alias("x"), label(color).alias("color")).agg(f(_x(y)).alias("value"))
    return g.select("x", "color", rnd(F.col("value").cast("double")).alias("value"))


def heatmap_cells(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """H8: Pearson matrix cells rounded to 2 dp: (a, b, value)."""
    from tablelens.operators.relate import correlation_matrix
    return correlation_matrix(df, cols).withColumn("value", rnd("value", 2))


def time_series_overlay(series: DataFrame, horizon: int = 5) -> DataFrame:
    """Series, trailing moving average and naive/moving-average forecasts
    in one long table: (kind, ts, value)."""
    from tablelens.operators.forecast import forecast_simple
    from tablelens.operators.timeseries import rolling_mean
    rm = rolling_mean(series)
    fc = forecast_simple(series, horizon)
    return (series.select(F.lit("value").alias("kind"), F.col("bucket").alias("ts"), rnd("value").alias("value"))
            .unionByName(rm.select(F.lit("moving_average").alias("kind"), F.col("bucket").alias("ts"),
                                   F.col("rolling_mean").alias("value")))
            .unionByName(fc.select(F.concat(F.lit("forecast_"), F.col("method")).alias("kind"), "ts", "value")))

