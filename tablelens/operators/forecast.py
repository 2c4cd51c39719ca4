"""Forecasts on bucketed series (TS10-TS15).

naive / moving-average / confidence band are aggregates of one series.
Holt (additive damped trend) and ARIMA(1,1,1) are re-aimed as many-series
jobs: each key's *aggregated* series (one value per bucket) is folded with a
higher-order ``aggregate`` for every point of a parameter grid, and the grid
point with the smallest in-sample squared error wins (``min_by``), so the
work is spread over keys and grid points instead of one solver loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.functions.stats import attach, rnd
from tablelens.operators.timeseries import indexed

# Parameter grids of the two fitted models.
HOLT_ALPHA = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]
HOLT_BETA = [0.05, 0.1, 0.2, 0.3, 0.5]
HOLT_PHI = [0.8, 0.9, 0.95, 0.98]
ARIMA_GRID = [round(-0.9 + 0.1 * i, 1) for i in range(19)]


def _band(series):
    return series.agg((1.96 * F.stddev_samp("value")).alias("band"))


def _future(h: int):
    return F.explode(F.sequence(F.lit(1), F.lit(h))).alias("step")


def forecast_simple(series: DataFrame, horizon: int = 5) -> DataFrame:
    """TS10/11/14/15: naive and moving-average forecasts with the 1.96*std band,
    future buckets one day apart: (method, step, ts, value, lower, upper).
    Empty with fewer than 4 points."""
    ix = indexed(series)
    m = F.greatest(F.lit(2), F.least(F.lit(5), F.greatest(F.lit(1), F.floor(F.col("n") / 4))))
    a = ix.agg(F.max_by("value", "idx").alias("last"), F.max("bucket").alias("last_ts"),
               F.avg(F.when(F.col("idx") >= F.col("n") - m, F.col("value"))).alias("ma"),
               F.first("n").alias("n"))
    a = attach(a, _band(series)).filter(F.col("n") >= 4)
    rows = a.select("last_ts", "band", F.explode(F.array(
        F.struct(F.lit("naive").alias("method"), F.col("last").alias("v")),
        F.struct(F.lit("moving_average").alias("method"), F.col("ma").alias("v")))).alias("f"))
    rows = rows.select("last_ts", "band", "f.*", _future(horizon))
    ts = F.timestamp_add("DAY", F.col("step"), F.col("last_ts")).cast("timestamp_ntz")
    return rows.select("method", F.col("step").cast("long"), ts.alias("ts"), rnd("v").alias("value"),
                       rnd(F.col("v") - F.col("band")).alias("lower"), rnd(F.col("v") + F.col("band")).alias("upper"))


def _arrays(series: DataFrame, keys) -> DataFrame:
    """(keys..., ys) with ys the values ordered by bucket (one aggregated series per key)."""
    return series.groupBy(*keys).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("bucket", "value"))), lambda s: s["value"]).alias("ys"))


def holt_fit(series: DataFrame, keys=(), horizon: int = 5) -> DataFrame:
    """TS12: damped additive-trend exponential smoothing per key (>= 5 points):
    (keys..., method, step, value, alpha, beta, phi, sse)."""
    keys = list(keys)
    ys = _arrays(series, keys).filter(F.size("ys") >= 5)
    grid = F.array(*[F.struct(F.lit(a).alias("alpha"), F.lit(b).alias("beta"), F.lit(p).alias("phi"))
                     for a in HOLT_ALPHA for b in HOLT_BETA for p in HOLT_PHI])
    g = ys.select(*keys, "ys", F.explode(grid).alias("g")).select(*keys, "ys", "g.*")
    fold = F.expr("""aggregate(slice(ys, 3, size(ys)),
        named_struct('l', ys[1], 'b', ys[1] - ys[0], 'sse', 0D),
        (acc, y) -> named_struct(
            'l', alpha * y + (1 - alpha) * (acc.l + phi * acc.b),
            'b', beta * (alpha * y + (1 - alpha) * (acc.l + phi * acc.b) - acc.l) + (1 - beta) * phi * acc.b,
            'sse', acc.sse + pow(y - (acc.l + phi * acc.b), 2)))""")
    fit = g.select(*keys, "alpha", "beta", "phi", fold.alias("s"))
    best = fit.groupBy(*keys).agg(F.min_by(F.struct("alpha", "beta", "phi", "s"), F.col("s.sse")).alias("m"))
    steps = best.select(*keys, "m.*", _future(horizon))
    damp = F.expr("aggregate(sequence(1, step), 0D, (acc, i) -> acc + pow(phi, i))")
    return steps.select(*keys, F.lit("exponential_smoothing").alias("method"), F.col("step").cast("long"),
                        rnd(F.col("s.l") + damp * F.col("s.b")).alias("value"), "alpha", "beta", "phi",
                        rnd("s.sse").alias("sse"))


def arima_fit(series: DataFrame, keys=(), horizon: int = 5) -> DataFrame:
    """TS13: ARIMA(1,1,1) by conditional sum of squares on the differenced
    series over a (phi, theta) grid, per key (>= 12 points):
    (keys..., method, step, value, phi, theta, sse)."""
    keys = list(keys)
    ys = _arrays(series, keys).filter(F.size("ys") >= 12).withColumn(
        "d", F.expr("transform(sequence(1, size(ys) - 1), i -> ys[i] - ys[i - 1])"))
    grid = F.array(*[F.struct(F.lit(p).alias("ar"), F.lit(t).alias("ma")) for p in ARIMA_GRID for t in ARIMA_GRID])
    g = ys.select(*keys, "ys", "d", F.explode(grid).alias("g")).select(*keys, "ys", "d", "g.*")
    g = g.withColumn("c", F.expr("aggregate(d, 0D, (a, x) -> a + x) / size(d) * (1 - ar)"))
    fold = F.expr("""aggregate(slice(d, 2, size(d)),
        named_struct('dp', d[0], 'e', 0D, 'sse', 0D),
        (acc, x) -> named_struct('dp', x, 'e', x - c - ar * acc.dp - ma * acc.e,
                                 'sse', acc.sse + pow(x - c - ar * acc.dp - ma * acc.e, 2)))""")
    fit = g.select(*keys, "ys", "c", "ar", "ma", fold.alias("s"))
    best = fit.groupBy(*keys).agg(F.min_by(F.struct("ys", "c", "ar", "ma", "s"), F.col("s.sse")).alias("m"))
    path = F.expr(f"""aggregate(sequence(1, {horizon}),
        named_struct('y', element_at(m.ys, -1), 'dp', m.s.dp, 'e', m.s.e, 'out', cast(array() as array<double>)),
        (acc, i) -> named_struct(
            'y', acc.y + m.c + m.ar * acc.dp + m.ma * acc.e,
            'dp', m.c + m.ar * acc.dp + m.ma * acc.e, 'e', 0D,
            'out', array_append(acc.out, acc.y + m.c + m.ar * acc.dp + m.ma * acc.e))).out""")
    r = best.select(*keys, "m", F.posexplode(path).alias("pos", "v"))
    return r.select(*keys, F.lit("arima").alias("method"), (F.col("pos") + 1).cast("long").alias("step"),
                    rnd("v").alias("value"), F.col("m.ar").alias("phi"), F.col("m.ma").alias("theta"),
                    rnd("m.s.sse").alias("sse"))
