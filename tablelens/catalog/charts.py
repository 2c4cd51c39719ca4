"""Chart-data queries."""

from tablelens.catalog.base import digest_sql, register, sround, table
from tablelens.catalog.timeseries import M, orders_series
from tablelens.operators import chartdata as H

LI = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

register("histogram", """
WITH x AS (SELECT l_extendedprice AS x FROM lineitem WHERE l_extendedprice IS NOT NULL AND NOT isnan(l_extendedprice)),
mm AS (SELECT min(x) AS lo, max(x) AS hi FROM x),
b AS (SELECT CASE WHEN hi = lo THEN 1 ELSE least(floor((x - lo) / ((hi - lo) / 40)) + 1, 40) END AS bin, count(*) AS c
      FROM x, mm GROUP BY 1),
g AS (SELECT unnest(range(1, 41)) AS bin)
SELECT CAST(g.bin AS BIGINT) AS bin, round(lo + (g.bin - 1) * ((hi - lo) / 40), 4) AS lower,
       round(lo + g.bin * ((hi - lo) / 40), 4) AS upper, CAST(coalesce(c, 0) AS BIGINT) AS count
FROM g CROSS JOIN mm LEFT JOIN b ON g.bin = b.bin
""")(lambda s, d: H.histogram(table(s, d, "lineitem"), "l_extendedprice"))

register("ecdf_distinct", """
WITH v AS (SELECT l_quantity AS value, count(*) AS c FROM lineitem WHERE l_quantity IS NOT NULL GROUP BY 1)
SELECT value, round(sum(c) OVER (ORDER BY value) / sum(c) OVER (), 6) AS ecdf FROM v
""")(lambda s, d: H.ecdf(table(s, d, "lineitem"), "l_quantity"))

register("kde", """
WITH v AS (SELECT l_quantity AS value, count(*) AS cnt FROM lineitem WHERE l_quantity IS NOT NULL GROUP BY 1),
st AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi, count(*) AS n,
              stddev_samp(l_quantity) * pow(count(*), -0.2) AS h FROM lineitem WHERE l_quantity IS NOT NULL),
g AS (SELECT unnest(range(0, 200)) AS i),
c AS (SELECT i, lo + i * ((hi - lo) / 199) AS x, n, h,
             sum(cnt * exp(-0.5 * pow(((lo + i * ((hi - lo) / 199)) - value) / h, 2))) AS s
      FROM g, st, v GROUP BY i, lo, hi, n, h)
SELECT CAST(i AS BIGINT) AS i, round(x, 6) AS x, round(s / (n * h * sqrt(2 * pi())), 8) AS density FROM c
""")(lambda s, d: H.kde(table(s, d, "lineitem"), "l_quantity"))

register("kde_price", """
WITH v AS (SELECT l_extendedprice AS value, count(*) AS cnt FROM lineitem WHERE l_extendedprice IS NOT NULL GROUP BY 1),
st AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, count(*) AS n,
              stddev_samp(l_extendedprice) * pow(count(*), -0.2) AS h FROM lineitem WHERE l_extendedprice IS NOT NULL),
g AS (SELECT unnest(range(0, 200)) AS i),
c AS (SELECT i, lo + i * ((hi - lo) / 199) AS x, n, h,
             sum(cnt * exp(-0.5 * pow(((lo + i * ((hi - lo) / 199)) - value) / h, 2))) AS s
      FROM g, st, v GROUP BY i, lo, hi, n, h)
SELECT CAST(i AS BIGINT) AS i, round(x, 6) AS x, round(s / (n * h * sqrt(2 * pi())), 8) AS density FROM c
""")(lambda s, d: H.kde(table(s, d, "lineitem"), "l_extendedprice"))

_parts = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS v FROM lineitem" for c in LI)
register("box_stats", f"""
WITH m AS ({_parts}),
s AS (SELECT "column", count(v) AS n, min(v) AS mn, max(v) AS mx, avg(v) AS mean, quantile_cont(v, 0.25) AS q1,
             quantile_cont(v, 0.5) AS med, quantile_cont(v, 0.75) AS q3 FROM m GROUP BY 1),
o AS (SELECT m."column", count_if(v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS n_out
      FROM m JOIN s ON m."column" = s."column" GROUP BY 1)
SELECT s."column", CAST(n AS BIGINT) AS n, round(mn, 4) AS min, round(q1, 4) AS q1, round(med, 4) AS median,
       round(mean, 4) AS mean, round(q3, 4) AS q3, round(mx, 4) AS max,
       {sround('q1 - 1.5 * (q3 - q1)')} AS lower_fence,
       {sround('q3 + 1.5 * (q3 - q1)')} AS upper_fence, CAST(n_out AS BIGINT) AS n_outside
FROM s JOIN o ON s."column" = o."column"
""")(lambda s, d: H.box_stats(table(s, d, "lineitem"), LI))

register("ols_line", """
SELECT CAST(count(*) AS BIGINT) AS n, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope,
       round(regr_intercept(l_extendedprice, l_quantity), 6) AS intercept,
       round(regr_r2(l_extendedprice, l_quantity), 6) AS r2
FROM lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL
""")(lambda s, d: H.ols_line(table(s, d, "lineitem"), "l_quantity", "l_extendedprice"))

register("scatter_points", f"""
WITH p AS (SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL),
l AS (SELECT regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept FROM p),
s AS (SELECT x, y FROM p ORDER BY {digest_sql(['x', 'y'], 42)} LIMIT 2000)
SELECT x, y, {sround('slope * x + intercept', 2)} AS fit FROM s, l
""")(lambda s, d: H.scatter_points(table(s, d, "lineitem"), "l_quantity", "l_extendedprice"))

register("frequency_bar", """
WITH g AS (SELECT coalesce(CAST(p_type AS VARCHAR), '(null)') AS category, count(*) AS c FROM part GROUP BY 1)
SELECT category, CAST(c AS BIGINT) AS count, CAST(row_number() OVER (ORDER BY c DESC, category) AS BIGINT) AS rank FROM g
""")(lambda s, d: H.frequency_bar(table(s, d, "part"), "p_type"))

register("grouped_bar", """
SELECT coalesce(CAST(l_returnflag AS VARCHAR), '(null)') AS x, coalesce(CAST(l_linestatus AS VARCHAR), '(null)') AS color,
       round(avg(l_extendedprice), 4) AS value FROM lineitem GROUP BY 1, 2
""")(lambda s, d: H.grouped_bar(table(s, d, "lineitem"), "l_returnflag", "l_linestatus", "l_extendedprice"))


def _pairs(cols):
    out = []
    for i, a in enumerate(cols):
        for b in cols[i:]:
            e = (f"CASE WHEN stddev_pop({a}) * stddev_pop({b}) = 0 THEN NULL "
                 f"ELSE covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b})) END")
            out.append(f"SELECT '{a}' AS a, '{b}' AS b, {e} AS v FROM lineitem")
            if a != b:
                out.append(f"SELECT '{b}' AS a, '{a}' AS b, {e} AS v FROM lineitem")
    return " UNION ALL ".join(out)


register("heatmap", f"SELECT a, b, round(round(v, 4), 2) + 0.0 AS value FROM ({_pairs(LI)})")(
    lambda s, d: H.heatmap_cells(table(s, d, "lineitem"), LI))

register("ts_overlay", f"""
WITH ix AS (SELECT bucket, value, row_number() OVER (ORDER BY bucket) - 1 AS idx, count(*) OVER () AS n FROM {M}),
w AS (SELECT *, greatest(2, least(7, n // 4)) AS w FROM ix),
rm AS (SELECT a.bucket, round(avg(b.value), 4) AS v FROM w a JOIN w b ON b.idx <= a.idx AND b.idx > a.idx - a.w
       GROUP BY a.bucket),
a AS (SELECT max_by(value, idx) AS last, max(bucket) AS last_ts,
             avg(CASE WHEN idx >= n - greatest(2, least(5, greatest(1, n // 4))) THEN value END) AS ma,
             max(n) AS n FROM ix),
f AS (SELECT 'forecast_' || m.method AS kind, last_ts + r.step * INTERVAL 1 DAY AS ts,
             round(CASE m.method WHEN 'naive' THEN last ELSE ma END, 4) AS value
      FROM a, (VALUES ('naive'), ('moving_average')) m(method), range(1, 6) r(step) WHERE n >= 4)
SELECT 'value' AS kind, bucket AS ts, round(value, 4) AS value FROM ix
UNION ALL SELECT 'moving_average', bucket, v FROM rm
UNION ALL SELECT kind, ts, value FROM f
""")(lambda s, d: H.time_series_overlay(orders_series(s, d, "M")))
