"""Time-series and forecast queries (TS1-TS16, G9 lives in groups)."""

from tablelens.catalog.base import register, sround, table
from tablelens.operators import fitted
from tablelens.operators import forecast as FC
from tablelens.operators import timeseries as TS


def _series_sql(unit, tbl="orders", ts="o_orderdate", val="o_totalprice"):
    if val is None:
        return (f"SELECT CAST(date_trunc('{unit}', {ts}) AS TIMESTAMP) AS bucket, CAST(count(*) AS DOUBLE) AS value, "
                f"CAST(count(*) AS BIGINT) AS n_records FROM {tbl} WHERE {ts} IS NOT NULL GROUP BY 1")
    return (f"SELECT CAST(date_trunc('{unit}', {ts}) AS TIMESTAMP) AS bucket, "
            f"coalesce(CAST(sum(CAST({val} AS DECIMAL(38,6))) AS DOUBLE), 0.0) AS value, "
            f"CAST(count({val}) AS BIGINT) AS n_records FROM {tbl} WHERE {ts} IS NOT NULL GROUP BY 1")


def orders_series(s, d, freq):
    return TS.build_time_series(table(s, d, "orders"), "o_orderdate", "o_totalprice", freq)


for _f, _u in TS.FREQ_UNIT.items():
    _name = {"D": "ts_daily", "W": "ts_weekly", "M": "ts_monthly", "Q": "ts_quarterly", "Y": "ts_yearly"}[_f]
    register(_name, _series_sql(_u))((lambda fr: lambda s, d: orders_series(s, d, fr))(_f))

register("ts_count", _series_sql("day", "events", "ts", None))(
    lambda s, d: TS.build_time_series(table(s, d, "events"), "ts", None, "D"))

M = f"({_series_sql('month')})"
register("ts_stats", f"""
SELECT {sround('CAST(sum(CAST(value AS DECIMAL(38,6))) AS DOUBLE) / count(value)')} AS mean,
       round(quantile_cont(value, 0.5), 4) AS median,
       round(stddev_samp(value), 4) AS std, round(min(value), 4) AS min, round(max(value), 4) AS max,
       {sround('CAST(sum(CAST(value AS DECIMAL(38,6))) AS DOUBLE)')} AS total,
       CAST(count(value) AS BIGINT) AS count FROM {M}
""")(lambda s, d: TS.ts_stats(orders_series(s, d, "M")))

register("growth", f"""
WITH a AS (SELECT min_by(value, bucket) AS first, max_by(value, bucket) AS last, max(bucket) AS lb, count(*) AS n FROM {M}),
p AS (SELECT max_by(value, bucket) AS prev FROM {M} WHERE bucket < (SELECT lb FROM a))
SELECT CASE WHEN n >= 2 AND first <> 0 THEN round((last - first) / abs(first) * 100, 4) END AS overall_growth_pct,
       CASE WHEN n >= 2 AND prev <> 0 THEN round((last - prev) / abs(prev) * 100, 4) END AS last_period_growth_pct
FROM a, p
""")(lambda s, d: TS.growth(orders_series(s, d, "M")))

register("trend", f"""
WITH ix AS (SELECT value, row_number() OVER (ORDER BY bucket) - 1 AS idx FROM {M}),
r AS (SELECT regr_slope(value, idx) AS slope, regr_r2(value, idx) AS r2, count(*) AS n FROM ix)
SELECT CASE WHEN n < 3 THEN 'insufficient' WHEN slope > 0 THEN 'increasing' WHEN slope < 0 THEN 'decreasing'
            ELSE 'flat' END AS direction,
       CASE WHEN n >= 3 THEN round(slope, 4) END AS slope, CASE WHEN n >= 3 THEN round(r2, 4) END AS r2 FROM r
""")(lambda s, d: TS.trend(orders_series(s, d, "M")))


def _season_sql(src, period, key):
    return f"""
WITH g AS (SELECT {key} AS key, avg(value) AS value FROM {src} GROUP BY 1)
SELECT '{period}' AS period, key, round(value, 4) AS value,
       CAST(row_number() OVER (ORDER BY value DESC, key) AS BIGINT) AS rank FROM g"""


register("seasonality_weekday", _season_sql(f"({_series_sql('day')})", "weekday", "dayname(bucket)"))(
    lambda s, d: TS.seasonality(orders_series(s, d, "D"), "D"))
register("seasonality_month", _season_sql(M, "month", "CAST(month(bucket) AS VARCHAR)"))(
    lambda s, d: TS.seasonality(orders_series(s, d, "M"), "M"))
register("seasonality_quarter", _season_sql(f"({_series_sql('quarter')})", "quarter",
                                            "CAST(quarter(bucket) AS VARCHAR)"))(
    lambda s, d: TS.seasonality(orders_series(s, d, "Q"), "Q"))

register("rolling_mean", f"""
WITH ix AS (SELECT bucket, value, row_number() OVER (ORDER BY bucket) - 1 AS idx, count(*) OVER () AS n FROM {M}),
w AS (SELECT *, greatest(2, least(7, n // 4)) AS w FROM ix)
SELECT a.bucket, a.value, round(avg(b.value), 4) AS rolling_mean
FROM w a JOIN w b ON b.idx <= a.idx AND b.idx > a.idx - a.w GROUP BY a.bucket, a.value
""")(lambda s, d: TS.rolling_mean(orders_series(s, d, "M")))


def _decomp_sql(src, p):
    h = p // 2
    box = (f"CAST(sum(CAST(value AS DECIMAL(38,6))) OVER (ORDER BY idx ROWS BETWEEN {h} PRECEDING "
           f"AND {h} FOLLOWING) AS DOUBLE)")
    lag, lead = f"lag(value, {h}) OVER (ORDER BY idx)", f"lead(value, {h}) OVER (ORDER BY idx)"
    tr = f"{box} / {p}" if p % 2 else f"({box} - 0.5 * ({lag} + {lead})) / {p}"
    front, back = f"trend, idx) FILTER (WHERE idx <= {h + p})", f"trend, idx) FILTER (WHERE idx >= n - 1 - {h + p})"
    return f"""
WITH ix AS (SELECT bucket, value, row_number() OVER (ORDER BY bucket) - 1 AS idx, count(*) OVER () AS n FROM {src}),
c AS (SELECT *, CASE WHEN {lag} IS NOT NULL AND {lead} IS NOT NULL THEN {tr} END AS trend, idx % {p} AS phase FROM ix),
e AS (SELECT regr_slope({front} AS fk, regr_intercept({front} AS fb, regr_slope({back} AS bk, regr_intercept({back} AS bb FROM c),
t AS (SELECT bucket, value, idx, n, phase, CASE WHEN idx < {h} THEN fk * idx + fb WHEN idx > n - 1 - {h} THEN bk * idx + bb ELSE trend END AS trend FROM c, e),
ph AS (SELECT phase, avg(value - trend) AS pm FROM t GROUP BY phase),
ph2 AS (SELECT phase, pm - (SELECT avg(pm) FROM ph) AS seasonal FROM ph)
SELECT bucket, {sround('value')} AS value, {sround('trend')} AS trend, {sround('seasonal')} AS seasonal,
       {sround('value - trend - seasonal')} AS resid
FROM t JOIN ph2 ON t.phase = ph2.phase WHERE n >= {2 * p}"""


register("decompose", _decomp_sql(M, 4))(lambda s, d: TS.decompose(orders_series(s, d, "M"), freq="M"))
register("decompose_daily", _decomp_sql(f"({_series_sql('day', 'events', 'ts', 'value')})", 7))(
    lambda s, d: TS.decompose(TS.build_time_series(table(s, d, "events"), "ts", "value", "D"), freq="D"))

register("forecast_simple", f"""
WITH ix AS (SELECT bucket, value, row_number() OVER (ORDER BY bucket) - 1 AS idx, count(*) OVER () AS n FROM {M}),
a AS (SELECT max_by(value, idx) AS last, max(bucket) AS last_ts,
             avg(CASE WHEN idx >= n - greatest(2, least(5, greatest(1, n // 4))) THEN value END) AS ma,
             max(n) AS n, 1.96 * stddev_samp(value) AS band FROM ix),
f AS (SELECT m.method, r.step, CASE m.method WHEN 'naive' THEN last ELSE ma END AS v, last_ts, band
      FROM a, (VALUES ('naive'), ('moving_average')) m(method), range(1, 6) r(step) WHERE n >= 4)
SELECT method, CAST(step AS BIGINT) AS step, last_ts + step * INTERVAL 1 DAY AS ts, round(v, 4) AS value,
       round(v - band, 4) AS lower, round(v + band, 4) AS upper FROM f
""")(lambda s, d: FC.forecast_simple(orders_series(s, d, "M")))


def _keyed(s, d):
    return TS.build_time_series(table(s, d, "orders"), "o_orderdate", "o_totalprice", "M", keys=["o_orderpriority"])


def _values(xs):
    return ", ".join(f"({x}::DOUBLE)" for x in xs)


_KEYED = _series_sql("month").replace("SELECT ", "SELECT o_orderpriority, ", 1).replace("GROUP BY 1", "GROUP BY ALL")
_LISTS = f"k AS (SELECT o_orderpriority, list(value ORDER BY bucket) AS ys FROM ({_KEYED}) GROUP BY 1)"
_AHEAD = "acc.l + phi * acc.b"  # the one-step forecast
_LEVEL = f"(alpha * y + (1 - alpha) * ({_AHEAD}))"
register("forecast_holt", f"""
WITH {_LISTS},
g AS (SELECT * FROM k, (VALUES {_values(FC.HOLT_ALPHA)}) a(alpha), (VALUES {_values(FC.HOLT_BETA)}) b(beta),
             (VALUES {_values(FC.HOLT_PHI)}) p(phi) WHERE len(ys) >= 5),
f AS (SELECT o_orderpriority, alpha, beta, phi, list_reduce(list_transform(ys[3:], lambda v: {{'l': v, 'b': 0.0::DOUBLE, 'sse': 0.0::DOUBLE}}),
        lambda acc, v: {{'l': {_LEVEL.replace(' y ', ' v.l ')},
                         'b': beta * ({_LEVEL.replace(' y ', ' v.l ')} - acc.l) + (1 - beta) * phi * acc.b,
                         'sse': acc.sse + (v.l - ({_AHEAD})) * (v.l - ({_AHEAD}))}},
        {{'l': ys[2], 'b': ys[2] - ys[1], 'sse': 0.0::DOUBLE}}) AS s FROM g),
m AS (SELECT o_orderpriority, arg_min({{'alpha': alpha, 'beta': beta, 'phi': phi, 's': s}}, s.sse) AS m FROM f GROUP BY 1)
SELECT o_orderpriority, 'exponential_smoothing' AS method, step,
       {sround('m.s.l + (SELECT sum(pow(m.phi, i)) FROM range(1, step + 1) r(i)) * m.s.b')} AS value,
       m.alpha AS alpha, m.beta AS beta, m.phi AS phi, {sround('m.s.sse')} AS sse
FROM m, range(1, 6) h(step)
""")(lambda s, d: FC.holt_fit(_keyed(s, d), ["o_orderpriority"]))

_ERROR = "(v.dp - c - ar * acc.dp - ma * acc.e)"
register("forecast_arima", f"""
WITH {_LISTS},
d AS (SELECT *, list_transform(range(2, len(ys) + 1), lambda i: ys[i] - ys[i - 1]) AS d FROM k WHERE len(ys) >= 12),
g AS (SELECT *, list_reduce(d, lambda a, x: a + x, 0.0::DOUBLE) / len(d) * (1 - ar) AS c
      FROM d, (VALUES {_values(FC.ARIMA_GRID)}) a(ar), (VALUES {_values(FC.ARIMA_GRID)}) b(ma)),
f AS (SELECT o_orderpriority, ys, c, ar, ma, list_reduce(list_transform(d[2:], lambda x: {{'dp': x, 'e': 0.0::DOUBLE, 'sse': 0.0::DOUBLE}}),
        lambda acc, v: {{'dp': v.dp, 'e': {_ERROR}, 'sse': acc.sse + {_ERROR} * {_ERROR}}},
        {{'dp': d[1], 'e': 0.0::DOUBLE, 'sse': 0.0::DOUBLE}}) AS s FROM g),
m AS (SELECT o_orderpriority, arg_min({{'ys': ys, 'c': c, 'ar': ar, 'ma': ma, 's': s}}, s.sse) AS m FROM f GROUP BY 1),
p AS (SELECT o_orderpriority, m, list_reduce(list_transform(range(1, 6), lambda i: {{'y': 0.0::DOUBLE, 'dp': 0.0::DOUBLE, 'e': 0.0::DOUBLE, 'path': []::DOUBLE[]}}),
        lambda acc, v: {{'y': acc.y + m.c + m.ar * acc.dp + m.ma * acc.e, 'dp': m.c + m.ar * acc.dp + m.ma * acc.e, 'e': 0.0::DOUBLE,
                         'path': list_append(acc.path, acc.y + m.c + m.ar * acc.dp + m.ma * acc.e)}},
        {{'y': m.ys[-1], 'dp': m.s.dp, 'e': m.s.e, 'path': []::DOUBLE[]}}).path AS path FROM m)
SELECT o_orderpriority, 'arima' AS method, step, {sround('path[step]')} AS value, m.ar AS phi, m.ma AS theta, {sround('m.s.sse')} AS sse
FROM p, range(1, 6) h(step)
""")(lambda s, d: FC.arima_fit(_keyed(s, d), ["o_orderpriority"]))

register("forecast_holt_fitted")(lambda s, d: fitted.holt_fitted(_keyed(s, d), ["o_orderpriority"]))
register("forecast_arima_exact")(lambda s, d: fitted.arima_exact(_keyed(s, d), ["o_orderpriority"]))


_SPIKE = "CASE WHEN month(bucket) = 3 THEN CAST('infinity' AS DOUBLE) ELSE value END"


def _spiky(s, d):
    return orders_series(s, d, "M").selectExpr("bucket", f"{_SPIKE} AS value", "n_records")


register("rolling_mean_extreme", f"""
WITH ix AS (SELECT bucket, {_SPIKE} AS value, row_number() OVER (ORDER BY bucket) - 1 AS idx FROM {M})
SELECT a.bucket, a.value, round(avg(b.value), 4) AS rolling_mean
FROM ix a JOIN ix b ON b.idx <= a.idx AND b.idx > a.idx - 3 GROUP BY a.bucket, a.value
""")(lambda s, d: TS.rolling_mean(_spiky(s, d), 3))

register("time_index", """
SELECT 'o_orderdate' AS time_column, CAST(min(o_orderdate) AS TIMESTAMP) AS first, CAST(max(o_orderdate) AS TIMESTAMP) AS last FROM orders
""")(lambda s, d: TS.time_index(table(s, d, "orders")))

_PAIRS = "(" + " UNION ALL ".join(
    f"SELECT 'o_orderdate' AS date_col, '{v}' AS metric, * FROM ({_series_sql('month', val=v)})" for v in ("o_totalprice", "o_custkey")) + ")"


def _pairs(s, d):
    return TS.all_series(table(s, d, "orders"), ["o_orderdate"], ["o_totalprice", "o_custkey"], "M")


PAIR = ["date_col", "metric"]
register("series_all_pairs", f"SELECT * FROM {_PAIRS}")(_pairs)
register("growth_all_pairs", f"""
WITH g AS (SELECT *, lag(value) OVER (PARTITION BY metric ORDER BY bucket) AS prev FROM {_PAIRS}),
a AS (SELECT date_col, metric, min_by(value, bucket) AS first, max_by(value, bucket) AS last, count(*) AS n, max(bucket) AS lb FROM g GROUP BY ALL)
SELECT a.date_col, a.metric, CASE WHEN n >= 2 AND first <> 0 THEN round((last - first) / abs(first) * 100, 4) END AS overall_growth_pct,
       CASE WHEN n >= 2 AND prev <> 0 THEN round((last - prev) / abs(prev) * 100, 4) END AS last_period_growth_pct
FROM a JOIN g ON g.metric = a.metric AND g.bucket = a.lb
""")(lambda s, d: TS.growth(_pairs(s, d), PAIR))
register("ts_stats_all_pairs", f"""
SELECT date_col, metric, {sround('CAST(sum(CAST(value AS DECIMAL(38,6))) AS DOUBLE) / count(value)')} AS mean, round(quantile_cont(value, 0.5), 4) AS median,
       round(stddev_samp(value), 4) AS std, round(min(value), 4) AS min, round(max(value), 4) AS max,
       {sround('CAST(sum(CAST(value AS DECIMAL(38,6))) AS DOUBLE)')} AS total, CAST(count(value) AS BIGINT) AS count FROM {_PAIRS} GROUP BY ALL
""")(lambda s, d: TS.ts_stats(_pairs(s, d), PAIR))
