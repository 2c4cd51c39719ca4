"""Univariate and distribution descriptives (A5-A10).

Moments and quantiles come from partial aggregates over the rows (:mod:`tablelens.functions.summary`); only
modes and ECDF points need the distinct values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.functions.columns import col
from tablelens.functions.stats import melt, modes, ranked_values, rnd, top_k, value_counts
from tablelens.functions.summary import column_numbers, column_table


def numeric_long(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, value) of non-null, non-NaN numeric values."""
    long = melt(df, cols, "double")
    return long.filter(F.col("value").isNotNull() & ~F.isnan("value"))


def outside(x, lo: float, hi: float):
    """How many values lie outside the fences."""
    return F.count_if((x < F.lit(lo)) | (x > F.lit(hi)))


def tukey(own: dict, lower: str, upper: str, k: float = 1.5) -> tuple[float, float]:
    """The fences of a column's numbers: k interquartile ranges beyond the quartiles."""
    iqr = own[upper] - own[lower]
    return own[lower] - k * iqr, own[upper] + k * iqr


def describe_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """count, mean, median, mode, std, variance, min, max, q25/q50/q75, skewness
    (population), kurtosis (excess, population) and iqr per column; 4 dp."""
    st = column_table(df, cols, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    out = st.join(modes(numeric_long(df, cols), ["column"]), "column")
    return out.select(
        "column", F.col("n").alias("count"), rnd("mean").alias("mean"),
        rnd("q50").alias("median"), rnd("mode").alias("mode"), rnd("std").alias("std"),
        rnd("var_samp").alias("variance"), rnd("min").alias("min"), rnd("max").alias("max"),
        rnd("q25").alias("q25"), rnd("q50").alias("q50"), rnd("q75").alias("q75"),
        rnd("skewness").alias("skewness"), rnd("kurtosis").alias("kurtosis"),
        rnd(F.col("q75") - F.col("q25")).alias("iqr"))


def distribution_summary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distribution table: percentiles, range, 1.5*IQR outlier count, shape, tails."""
    t = column_table(df, cols, {"p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95},
                     lambda x, own: {"outlier_count": outside(x, *tukey(own, "p25", "p75"))})
    skew, kurt = F.col("skewness"), F.col("kurtosis")
    return t.select(
        "column", F.col("n").alias("count"), rnd("mean").alias("mean"),
        rnd("p50").alias("median"), rnd("std").alias("std"), rnd("min").alias("min"),
        rnd("p5").alias("p5"), rnd("p25").alias("p25"), rnd("p50").alias("p50"),
        rnd("p75").alias("p75"), rnd("p95").alias("p95"), rnd("max").alias("max"),
        rnd(F.col("max") - F.col("min")).alias("range"),
        rnd(F.col("p75") - F.col("p25")).alias("iqr"),
        rnd(skew).alias("skewness"), rnd(kurt).alias("kurtosis"),
        F.col("outlier_count").cast("long").alias("outlier_count"),
        rnd(100.0 * F.col("outlier_count") / F.col("n"), 2).alias("outlier_pct"),
        F.when(skew > 0.5, "right-skewed").when(skew < -0.5, "left-skewed")
         .otherwise("symmetric").alias("shape"),
        F.when(F.abs(kurt) > 1.5, "heavy").when(F.abs(kurt) < 0.5, "light")
         .otherwise("normal").alias("tails"))


def describe_categorical(df: DataFrame, cols: Sequence[str], top_n: int = 10) -> DataFrame:
    """Top ``top_n`` values per column by count (ties: smallest value first) with
    their share of the column's non-null values (2 dp)."""
    long = melt(df, cols, "string")
    vc = value_counts(long, ["column"])
    nn = vc.groupBy("column").agg(F.sum("cnt").alias("_nn"))
    top = top_k(vc, ["column"], [F.col("cnt").desc(), F.col("value")], top_n)
    return top.join(nn, "column").select(
        "column", "value", F.col("cnt").cast("long").alias("count"),
        rnd(100.0 * F.col("cnt") / F.greatest(F.col("_nn"), F.lit(1)), 2).alias("pct"),
        F.col("rank").cast("long").alias("rank"))


def describe_text(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Character and whitespace-word lengths of text columns, plus missingness
    (one aggregate over all columns, one row per column)."""
    aggs, rows = [F.count(F.lit(1)).alias("_n")], []
    for i, c in enumerate(cols):
        s_ = col(c).cast("string")
        words = F.when(s_.isNotNull(), F.size(F.split(s_, r"\s+")))
        aggs += [F.count(s_).alias(f"c{i}"), F.avg(F.length(s_)).alias(f"al{i}"), F.max(F.length(s_)).alias(f"ml{i}"),
                 F.avg(words).alias(f"aw{i}"), F.max(words).alias(f"mw{i}")]
        rows.append(F.struct(F.lit(c).alias("column"), F.col(f"c{i}").cast("long").alias("count"),
                             rnd(f"al{i}").alias("avg_length"), F.col(f"ml{i}").cast("long").alias("max_length"),
                             rnd(f"aw{i}").alias("avg_word_count"), F.col(f"mw{i}").cast("long").alias("max_word_count"),
                             (F.col("_n") - F.col(f"c{i}")).cast("long").alias("missing"),
                             rnd(100.0 * (F.col("_n") - F.col(f"c{i}")) / F.col("_n"), 2).alias("missing_pct")))
    return df.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def ecdf_values(df: DataFrame, cols: Sequence[str], n: int = 500) -> DataFrame:
    """Empirical CDF points: at most ``n`` evenly spaced order statistics per column.

    (column, i, x, y): with N values, index ``int(i*(N-1)/(n-1))`` (numpy
    ``linspace`` then truncation, last index N-1), y = (i+1)/min(N, n)."""
    long = numeric_long(df, cols)
    vc = value_counts(long, ["column"])
    cum = ranked_values(vc, ["column"], "value", total="_n")
    # each distinct value finds the points i whose index falls in its span
    # [_start, _end) from a short candidate range (no join on the column key)
    big = F.col("_n") > n
    ratio = F.lit(float(n - 1)) / (F.col("_n") - 1)
    first = F.when(big, F.greatest(F.lit(0).cast("long"), F.floor(F.col("_start") * ratio) - 1)) \
             .otherwise(F.col("_start"))
    last = F.when(big, F.least(F.lit(n - 1).cast("long"), F.ceil(F.col("_end") * ratio) + 1)) \
            .otherwise(F.col("_end") - 1)
    c = cum.select("column", "value", "_start", "_end", "_n",
                   F.explode(F.sequence(first.cast("long"), last.cast("long"))).alias("i"))
    idx = (F.when(F.col("_n") <= n, F.col("i"))
            .when(F.col("i") == n - 1, F.col("_n") - 1)
            .otherwise(F.floor(F.col("i") * ((F.col("_n") - 1) / F.lit(float(n - 1))))))
    picked = c.filter((F.col("_start") <= idx) & (idx < F.col("_end")))
    return picked.select("column", F.col("i").cast("long").alias("i"), F.col("value").alias("x"),
                         ((F.col("i") + 1) / F.least(F.col("_n"), F.lit(n))).alias("y"))


def univariate_report(df: DataFrame, types: dict) -> dict:
    from tablelens.functions.types import categorical_cols, numeric_cols, text_cols
    out = {}
    if numeric_cols(types):
        out["numeric"] = describe_numeric(df, numeric_cols(types))
    if categorical_cols(types):
        out["categorical"] = describe_categorical(df, categorical_cols(types))
    if text_cols(types):
        out["text"] = describe_text(df, text_cols(types))
    return out


def quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Exact quantiles of numeric columns: (column, prob, q)."""
    numbers = column_numbers(df, cols, {str(i): p for i, p in enumerate(probs)})
    rows = [(c, float(p), float(own[str(i)])) for c, own in numbers.items() for i, p in enumerate(probs)]
    return df.sparkSession.createDataFrame(rows, "column string, prob double, q double")
