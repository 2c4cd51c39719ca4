"""Time series: bucketing, stats, growth, trend, seasonality, rolling mean and
additive decomposition (TS1-TS9, TS16).

A series is ``(bucket timestamp_ntz, value double, n_records long)``: the
group-by over raw rows is the only step that touches the data; every later
step works on buckets, whose number is set by the calendar span and the
frequency, not by the row count. Bucket sums are exact decimal sums, so a
series is identical however the rows are partitioned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablelens.functions.dates import parse_timestamp
from tablelens.functions.columns import col
from tablelens.functions.stats import attach, exact_mean, exact_sum, rnd

FREQ_UNIT = {"D": "day", "W": "week", "M": "month", "Q": "quarter", "Y": "year"}


def find_time_index(df: DataFrame, types: dict | None = None) -> str | None:
    """TS1: first DATETIME-typed column (semantic types), else None."""
    from tablelens.functions.types import DATETIME
    from tablelens.operators.schema import schema_types
    types = types if types is not None else schema_types(df)
    for c, t in types.items():
        if t == DATETIME:
            return c
    return None


def time_index(df: DataFrame, types: dict | None = None) -> DataFrame:
    """TS1 as a table: (time_column, first, last) of the column that :func:`find_time_index` picks; no row without one."""
    c = find_time_index(df, types)
    if c is None:
        return df.sparkSession.createDataFrame([], "time_column string, first timestamp_ntz, last timestamp_ntz")
    t = _time(df, c)
    return df.agg(F.lit(c).alias("time_column"), F.min(t).alias("first"), F.max(t).alias("last"))


def _time(df, c):
    dt = df.schema[c].dataType.simpleString()
    if dt in ("timestamp", "timestamp_ntz", "date"):
        return col(c).cast("timestamp_ntz")
    return parse_timestamp(col(c)).cast("timestamp_ntz")


def build_time_series(df: DataFrame, date_col: str, value_col: str | None = None, freq: str = "D",
                      keys=()) -> DataFrame:
    """TS2/TS3: per bucket the summed value (0 when all missing) and the count of
    numeric values; without ``value_col`` the value is the row count. Rows
    without a time are dropped; empty buckets are not filled."""
    unit = FREQ_UNIT.get(freq, "day")
    bucket = F.date_trunc(unit, _time(df, date_col)).cast("timestamp_ntz")
    if value_col is None:
        g = (df.select(*keys, bucket.alias("bucket")).filter(F.col("bucket").isNotNull())
               .groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("n")))
        return g.select(*keys, "bucket", F.col("n").cast("double").alias("value"),
                        F.col("n").cast("long").alias("n_records"))
    v = col(value_col).try_cast("double")
    g = (df.select(*keys, bucket.alias("bucket"), F.when(~F.isnan(v), v).alias("v"))
           .filter(F.col("bucket").isNotNull())
           .groupBy(*keys, "bucket").agg(exact_sum(F.col("v")).alias("value"), F.count("v").alias("n_records")))
    return g.select(*keys, "bucket", F.coalesce(F.col("value"), F.lit(0.0)).alias("value"),
                    F.col("n_records").cast("long"))


def _series(keys) -> "Window":
    """The buckets of each series in order. A series has one row per bucket, so the calendar bounds it."""
    return Window.partitionBy(*keys).orderBy("bucket")


def _beside(df: DataFrame, per_key: DataFrame, keys) -> DataFrame:
    """Append the columns of one row per series."""
    return df.join(per_key, list(keys)) if keys else attach(df, per_key)


def indexed(series: DataFrame, keys=()) -> DataFrame:
    """Adds ``idx`` (0-based position by bucket) and ``n`` (series length)."""
    w = _series(keys)
    return series.withColumn("idx", F.row_number().over(w).cast("long") - 1).withColumn(
        "n", F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))


def ts_stats(series: DataFrame, keys=()) -> DataFrame:
    """TS4: mean, median, std (n-1), min, max, total, count of bucket values."""
    return series.groupBy(*keys).agg(
        rnd(exact_mean(F.col("value"))).alias("mean"), rnd(F.median("value")).alias("median"),
        rnd(F.stddev_samp("value")).alias("std"), rnd(F.min("value")).alias("min"), rnd(F.max("value")).alias("max"),
        rnd(exact_sum(F.col("value"))).alias("total"), F.count("value").cast("long").alias("count"))


def growth(series: DataFrame, keys=()) -> DataFrame:
    """TS5: overall (last vs first) and last-period (last vs previous) growth in %;
    null with fewer than 2 points or a zero base."""
    before = series.withColumn("prev", F.lag("value").over(_series(keys)))
    r = before.groupBy(*keys).agg(F.min_by("value", "bucket").alias("first"), F.max_by("value", "bucket").alias("last"),
                                  F.max_by("prev", "bucket").alias("prev"), F.count(F.lit(1)).alias("n"))
    ok = F.col("n") >= 2

    def pct(new, old):
        return F.when(ok & (F.col(old) != 0), rnd((F.col(new) - F.col(old)) / F.abs(F.col(old)) * 100))

    return r.select(*keys, pct("last", "first").alias("overall_growth_pct"),
                    pct("last", "prev").alias("last_period_growth_pct"))


def trend(series: DataFrame, keys=()) -> DataFrame:
    """TS6: OLS of value on position: slope, r2, direction (insufficient < 3 points)."""
    r = indexed(series, keys).groupBy(*keys).agg(
        F.regr_slope("value", "idx").alias("slope"), F.regr_r2("value", "idx").alias("r2"), F.count(F.lit(1)).alias("n"))
    ok = F.col("n") >= 3
    direction = (F.when(~ok, "insufficient").when(F.col("slope") > 0, "increasing")
                 .when(F.col("slope") < 0, "decreasing").otherwise("flat"))
    return r.select(*keys, direction.alias("direction"), F.when(ok, rnd("slope")).alias("slope"),
                    F.when(ok, rnd("r2")).alias("r2"))


def seasonality(series: DataFrame, freq: str = "D", keys=()) -> DataFrame:
    """TS7: mean bucket value by weekday (D), month (W, M) or quarter (Q, Y):
    (period, key, value, rank) highest first."""
    if freq == "D":
        period, key = "weekday", F.date_format("bucket", "EEEE")
    elif freq in ("W", "M"):
        period, key = "month", F.month("bucket").cast("string")
    else:
        period, key = "quarter", F.quarter("bucket").cast("string")
    g = series.groupBy(*keys, key.alias("key")).agg(F.avg("value").alias("value"))
    w = Window.partitionBy(*keys).orderBy(F.col("value").desc(), F.col("key"))  # at most 12 rows
    return g.select(*keys, F.lit(period).alias("period"), "key", rnd("value").alias("value"),
                    F.row_number().over(w).cast("long").alias("rank"))


MAX_ROLLING = 7  # widest default window


def rolling_window(n: int) -> int:
    return max(2, min(MAX_ROLLING, n // 4))


def rolling_mean(series: DataFrame, window: int | None = None, keys=()) -> DataFrame:
    """TS8: trailing mean over ``window`` buckets (partial windows at the start);
    default window max(2, min(7, n // 4)).

    Each mean is taken over its own frame, not as a difference of running sums, so a huge or infinite
    value only shows in the frames that hold it."""
    ix, w = indexed(series, keys), _series(keys)
    mean = lambda k: F.avg("value").over(w.rowsBetween(1 - k, 0))
    if window is not None:
        rolled = mean(window)
    else:
        width = F.greatest(F.lit(2), F.least(F.lit(MAX_ROLLING), F.floor(F.col("n") / 4)))
        rolled = F.coalesce(*[F.when(width == k, mean(k)) for k in range(2, MAX_ROLLING + 1)])
    return ix.select(*keys, "bucket", "value", rnd(rolled).alias("rolling_mean"))


def _to_the_edges(t: DataFrame, keys, h: int, p: int) -> DataFrame:
    """Fill the ``h`` missing trend values at both ends from the least-squares lines through the ``p + 1`` nearest ones."""
    idx, near = F.col("idx"), {"front": F.col("idx") <= h + p, "back": F.col("idx") >= F.col("n") - 1 - h - p}
    lines = []
    for side, of in near.items():
        y = F.when(of, F.col("trend"))
        lines += [F.regr_slope(y, idx).alias(f"_{side}_k"), F.regr_intercept(y, idx).alias(f"_{side}_b")]
    line = lambda side: F.col(f"_{side}_k") * idx + F.col(f"_{side}_b")
    joined = _beside(t, t.groupBy(*keys).agg(*lines), keys)
    whole = F.when(idx < h, line("front")).when(idx > F.col("n") - 1 - h, line("back")).otherwise(F.col("trend"))
    return joined.withColumn("trend", whole).drop(*[f"_{s}_{x}" for s in near for x in "kb"])


def decompose(series: DataFrame, period: int | None = None, freq: str = "D", keys=()) -> DataFrame:
    """TS9: additive decomposition (bucket, value, trend, seasonal, resid).

    Trend: centred moving average (2 x MA for an even period), carried on to both ends by the least-squares
    lines through the period + 1 nearest trend values; seasonal: per-phase mean of the detrended values, centred
    to sum to zero; resid = value - trend - seasonal. Needs at least two periods."""
    p = period or (7 if freq == "D" else 4)
    h = p // 2
    ix = indexed(series, keys).filter(F.col("n") >= 2 * p)
    w = _series(keys)
    lag, lead = F.lag("value", h).over(w), F.lead("value", h).over(w)
    # exact (decimal) window sum: the trend of ordinary values does not depend on summation order
    box = exact_sum("value", w.rowsBetween(-h, h))
    if p % 2 == 1:
        tr = F.when(lag.isNotNull() & lead.isNotNull(), box / p)
    else:
        tr = F.when(lag.isNotNull() & lead.isNotNull(), (box - 0.5 * (lag + lead)) / p)
    t = _to_the_edges(ix.withColumn("trend", tr).withColumn("phase", F.col("idx") % p), keys, h, p)
    ph = t.groupBy(*keys, "phase").agg(F.avg(F.col("value") - F.col("trend")).alias("_pm"))
    centre = F.avg("_pm").over(Window.partitionBy(*keys))  # p rows a series
    ph = ph.select(*keys, "phase", (F.col("_pm") - centre).alias("seasonal"))
    out = t.join(ph, [*keys, "phase"])
    return out.select(*keys, "bucket", rnd("value").alias("value"), rnd("trend").alias("trend"),
                      rnd("seasonal").alias("seasonal"),
                      rnd(F.col("value") - F.col("trend") - F.col("seasonal")).alias("resid"))


def all_series(df: DataFrame, date_cols, value_cols, freq: str = "D") -> DataFrame:
    """The series of every (date column, numeric column) pair in one table: (date_col, metric, bucket, value, n_records).

    Each date column's rows are read once; the pairs are made after the rows were summed by bucket."""
    out = None
    for d in date_cols:
        bucket = F.date_trunc(FREQ_UNIT.get(freq, "day"), _time(df, d)).cast("timestamp_ntz")
        values = [col(v).try_cast("double") for v in value_cols]
        values = [F.when(~F.isnan(v), v) for v in values]
        g = df.select(bucket.alias("bucket"), *[v.alias(f"v{i}") for i, v in enumerate(values)]).filter("bucket is not null") \
            .groupBy("bucket").agg(*[x for i in range(len(values)) for x in (exact_sum(F.col(f"v{i}")).alias(f"s{i}"), F.count(f"v{i}").alias(f"n{i}"))])
        pairs = F.explode(F.array(*[F.struct(F.lit(v).alias("metric"), F.coalesce(F.col(f"s{i}"), F.lit(0.0)).alias("value"),
                                             F.col(f"n{i}").cast("long").alias("n_records")) for i, v in enumerate(value_cols)]))
        one = g.select(F.lit(d).alias("date_col"), "bucket", pairs.alias("p")).select("date_col", "p.metric", "bucket", "p.value", "p.n_records")
        out = one if out is None else out.unionByName(one)
    return out


def time_series_report(df: DataFrame, date_col: str, value_col: str | None, freq: str = "D") -> dict:
    """TS16: every series table for one (date, value) pair."""
    s = build_time_series(df, date_col, value_col, freq)
    return {"series": s, "stats": ts_stats(s), "growth": growth(s), "trend": trend(s),
            "seasonality": seasonality(s, freq), "rolling": rolling_mean(s),
            "decomposition": decompose(s, freq=freq)}
