"""Univariate / distribution queries (A5-A10)."""

from tablelens.catalog.base import register, sql_melt, table
from tablelens.operators import describe as D

LINEITEM_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

_NUM_BASE = f"""
WITH m AS ({sql_melt('lineitem', LINEITEM_NUM)}),
f AS (SELECT * FROM m WHERE value IS NOT NULL AND NOT isnan(value)),
s AS (SELECT "column", count(value) AS n, avg(value) AS mean, stddev_samp(value) AS std,
             var_samp(value) AS variance, var_pop(value) AS vp, min(value) AS mn, max(value) AS mx,
             quantile_cont(value, 0.05) AS p5, quantile_cont(value, 0.25) AS q25,
             quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.75) AS q75,
             quantile_cont(value, 0.95) AS p95
      FROM f GROUP BY "column"),
cm AS (SELECT f."column", avg(power(f.value - s.mean, 3)) AS m3, avg(power(f.value - s.mean, 4)) AS m4
       FROM f JOIN s ON f."column" = s."column" GROUP BY f."column"),
k AS (SELECT s.*, cm.m3 / nullif(power(s.vp, 1.5), 0) AS skew, cm.m4 / nullif(s.vp * s.vp, 0) - 3 AS kurt
      FROM s JOIN cm ON s."column" = cm."column")
"""

register("describe_numeric", _NUM_BASE + """,
mo AS (SELECT "column", value AS mode FROM (
         SELECT "column", value, row_number() OVER (PARTITION BY "column" ORDER BY count(*) DESC, value) AS rn
         FROM f GROUP BY "column", value) WHERE rn = 1)
SELECT k."column", n AS count, round(mean, 4) AS mean, round(q50, 4) AS median, round(mode, 4) AS mode,
       round(std, 4) AS std, round(variance, 4) AS variance, round(mn, 4) AS min, round(mx, 4) AS max,
       round(q25, 4) AS q25, round(q50, 4) AS q50, round(q75, 4) AS q75,
       round(skew, 4) AS skewness, round(kurt, 4) AS kurtosis, round(q75 - q25, 4) AS iqr
FROM k JOIN mo ON k."column" = mo."column"
""")(lambda spark, d: D.describe_numeric(table(spark, d, "lineitem"), LINEITEM_NUM))

register("distribution_summary", _NUM_BASE + """,
o AS (SELECT f."column", sum(CASE WHEN f.value < k.q25 - 1.5 * (k.q75 - k.q25)
                                   OR f.value > k.q75 + 1.5 * (k.q75 - k.q25) THEN 1 ELSE 0 END) AS oc
      FROM f JOIN k ON f."column" = k."column" GROUP BY f."column")
SELECT k."column", n AS count, round(mean, 4) AS mean, round(q50, 4) AS median, round(std, 4) AS std,
       round(mn, 4) AS min, round(p5, 4) AS p5, round(q25, 4) AS p25, round(q50, 4) AS p50,
       round(q75, 4) AS p75, round(p95, 4) AS p95, round(mx, 4) AS max, round(mx - mn, 4) AS range,
       round(q75 - q25, 4) AS iqr, round(skew, 4) AS skewness, round(kurt, 4) AS kurtosis,
       CAST(oc AS BIGINT) AS outlier_count, round(100.0 * oc / n, 2) AS outlier_pct,
       CASE WHEN skew > 0.5 THEN 'right-skewed' WHEN skew < -0.5 THEN 'left-skewed' ELSE 'symmetric' END AS shape,
       CASE WHEN abs(kurt) > 1.5 THEN 'heavy' WHEN abs(kurt) < 0.5 THEN 'light' ELSE 'normal' END AS tails
FROM k JOIN o ON k."column" = o."column"
""")(lambda spark, d: D.distribution_summary(table(spark, d, "lineitem"), LINEITEM_NUM))

register("describe_categorical", f"""
WITH m AS ({sql_melt('orders', ['o_orderstatus', 'o_orderpriority'], 'VARCHAR')}),
vc AS (SELECT "column", value, count(*) AS cnt FROM m WHERE value IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY cnt DESC, value) AS rank,
             sum(cnt) OVER (PARTITION BY "column") AS nn FROM vc)
SELECT "column", value, CAST(cnt AS BIGINT) AS count, round(100.0 * cnt / greatest(nn, 1), 2) AS pct,
       CAST(rank AS BIGINT) AS rank
FROM r WHERE rank <= 10
""")(lambda spark, d: D.describe_categorical(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"]))

register("describe_categorical_wide", f"""
WITH m AS ({sql_melt('part', ['p_brand', 'p_type', 'p_size'], 'VARCHAR')}),
vc AS (SELECT "column", value, count(*) AS cnt FROM m WHERE value IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY cnt DESC, value) AS rank,
             sum(cnt) OVER (PARTITION BY "column") AS nn FROM vc)
SELECT "column", value, CAST(cnt AS BIGINT) AS count, round(100.0 * cnt / greatest(nn, 1), 2) AS pct,
       CAST(rank AS BIGINT) AS rank
FROM r WHERE rank <= 10
""")(lambda spark, d: D.describe_categorical(table(spark, d, "part"), ["p_brand", "p_type", "p_size"]))

register("describe_text", """
SELECT 'text' AS "column", count(text) AS count, round(avg(length(text)), 4) AS avg_length,
       CAST(max(length(text)) AS BIGINT) AS max_length,
       round(avg(len(regexp_split_to_array(text, '\\s+'))), 4) AS avg_word_count,
       CAST(max(len(regexp_split_to_array(text, '\\s+'))) AS BIGINT) AS max_word_count,
       CAST(count(*) - count(text) AS BIGINT) AS missing,
       round(100.0 * (count(*) - count(text)) / count(*), 2) AS missing_pct
FROM documents
""")(lambda spark, d: D.describe_text(table(spark, d, "documents"), ["text"]))

register("ecdf", f"""
WITH m AS ({sql_melt('lineitem', ['l_extendedprice', 'l_quantity'])}),
f AS (SELECT "column", value, row_number() OVER (PARTITION BY "column" ORDER BY value) - 1 AS idx,
             count(*) OVER (PARTITION BY "column") AS n
      FROM m WHERE value IS NOT NULL AND NOT isnan(value)),
t AS (SELECT DISTINCT "column", n FROM f),
g AS (SELECT t."column", t.n, i.i FROM t, LATERAL (SELECT unnest(range(least(t.n, 500))) AS i) i),
gi AS (SELECT "column", n, i, CASE WHEN n <= 500 THEN i WHEN i = 499 THEN n - 1
                                   ELSE floor(i * ((n - 1) / 499.0)) END AS idx FROM g)
SELECT gi."column", CAST(gi.i AS BIGINT) AS i, f.value AS x, (gi.i + 1) / least(gi.n, 500) AS y
FROM gi JOIN f ON gi."column" = f."column" AND gi.idx = f.idx
""")(lambda spark, d: D.ecdf_values(table(spark, d, "lineitem"), ["l_extendedprice", "l_quantity"]))
