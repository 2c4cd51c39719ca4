"""Composition and comparison queries."""

from tablelens.catalog.base import register, sround, table
from tablelens.operators import groups as G


def _lbl(c):
    return f"coalesce(CAST({c} AS VARCHAR), '(null)')"


def _composition_sql(tbl, cat, value=None, top_n=15):
    m = "count(*)" if value is None else f"sum(TRY_CAST({value} AS DOUBLE))"
    having = "" if value is None else " HAVING m IS NOT NULL"
    out = "CAST(m AS BIGINT) AS count" if value is None else "round(m, 4) AS value"
    return f"""
WITH g AS (SELECT {_lbl(cat)} AS category, {m} AS m FROM {tbl} GROUP BY 1{having}),
r AS (SELECT *, row_number() OVER (ORDER BY m DESC, category) AS rank, sum(m) OVER () AS tot FROM g),
f AS (SELECT category, m, rank, tot FROM r WHERE rank <= {top_n}
      UNION ALL
      SELECT 'Other', sum(m), {top_n + 1}, max(tot) FROM r WHERE rank > {top_n} HAVING count(*) > 0)
SELECT category, {out}, CASE WHEN tot <> 0 THEN round(100.0 * m / tot, 2) ELSE 0.0 END AS share_pct,
       CAST(rank AS BIGINT) AS rank
FROM f"""


register("composition_count", _composition_sql("customer", "c_mktsegment"))(
    lambda s, d: G.composition(table(s, d, "customer"), "c_mktsegment"))
register("composition_value", _composition_sql("customer", "c_mktsegment", "c_acctbal"))(
    lambda s, d: G.composition(table(s, d, "customer"), "c_mktsegment", "c_acctbal"))
register("composition_other", _composition_sql("part", "p_brand"))(
    lambda s, d: G.composition(table(s, d, "part"), "p_brand"))
register("composition_other_value", _composition_sql("part", "p_brand", "p_retailprice"))(
    lambda s, d: G.composition(table(s, d, "part"), "p_brand", "p_retailprice"))

_PART_CATS = ["p_brand", "p_type", "p_size"]
_m = "\n  UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {_lbl(c)} AS category, p_retailprice AS v FROM part" for c in _PART_CATS)
register("composition_report", f"""
WITH m AS ({_m}),
g AS (SELECT "column", category, count(*) AS cnt, sum(TRY_CAST(v AS DOUBLE)) AS vsum FROM m GROUP BY ALL),
t AS (SELECT "column", 'count' AS metric, category, CAST(cnt AS DOUBLE) AS m FROM g
      UNION ALL SELECT "column", 'p_retailprice', category, vsum FROM g WHERE vsum IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY "column", metric ORDER BY m DESC, category) AS rank,
             sum(m) OVER (PARTITION BY "column", metric) AS tot FROM t),
f AS (SELECT "column", metric, CASE WHEN rank > 15 THEN 'Other' ELSE category END AS category,
             least(rank, 16) AS rank, sum(m) AS m, max(tot) AS tot
      FROM r GROUP BY "column", metric, CASE WHEN rank > 15 THEN 'Other' ELSE category END, least(rank, 16))
SELECT "column", metric, category, round(m, 4) AS value,
       CASE WHEN tot <> 0 THEN round(100.0 * m / tot, 2) ELSE 0.0 END AS share_pct, CAST(rank AS BIGINT) AS rank
FROM f
""")(lambda s, d: G.composition_report(table(s, d, "part"), _PART_CATS, "p_retailprice"))

_O_CATS = ["o_orderstatus", "o_orderpriority"]
_m2 = "\n  UNION ALL ".join(f"SELECT '{c}' AS \"column\", {_lbl(c)} AS category FROM orders" for c in _O_CATS)
register("composition_insights", f"""
WITH m AS ({_m2}),
g AS (SELECT "column", category, count(*) AS cnt FROM m GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY cnt DESC, category) AS rank,
             sum(cnt) OVER (PARTITION BY "column") AS n FROM g)
SELECT "column", category, round(100.0 * cnt / n, 2) AS pct, CAST(rank AS BIGINT) AS rank FROM r WHERE rank <= 5
""")(lambda s, d: G.composition_insights(table(s, d, "orders"), _O_CATS))

_SQL_AGG = {
    "mean": "avg(x)", "sum": "coalesce(sum(x), 0.0)", "median": "quantile_cont(x, 0.5)",
    "min": "min(x)", "max": "max(x)", "count": "CAST(count(x) AS DOUBLE)", "std": "stddev_samp(x)",
}


def _compare_sql(tbl, grp, val, agg, top_n=15):
    tot = "sum(value)" if agg == "sum" else "avg(value)"
    return f"""
WITH s AS (SELECT {_lbl(grp)} AS "group", TRY_CAST({val} AS DOUBLE) AS x FROM {tbl}),
g AS (SELECT "group", {_SQL_AGG[agg]} AS value FROM s GROUP BY 1),
f AS (SELECT * FROM g WHERE value IS NOT NULL AND NOT isnan(value)),
t AS (SELECT {tot} AS tot FROM f),
r AS (SELECT f.*, row_number() OVER (ORDER BY value DESC, "group") AS rank FROM f)
SELECT "group", round(value, 4) AS value,
       CASE WHEN tot <> 0 THEN round(100.0 * value / tot, 2) ELSE 0.0 END AS summary, CAST(rank AS BIGINT) AS rank
FROM r, t WHERE rank <= {top_n}"""


for _agg in ["mean", "sum", "median", "min", "max", "count", "std"]:
    register(f"compare_{_agg}", _compare_sql("part", "p_brand", "p_retailprice", _agg))(
        (lambda a: lambda s, d: G.compare_groups(table(s, d, "part"), "p_brand", "p_retailprice", a))(_agg))


def _report_sql(tbl, groups, values, top_n, top, bottom, extra=""):
    parts = []
    for g in groups:
        for v in values:
            parts.append(f"SELECT '{g}' AS group_col, '{v}' AS value_col, {_lbl(g)} AS \"group\", "
                         f"avg(TRY_CAST({v} AS DOUBLE)) AS value FROM {tbl} GROUP BY 3")
    u = "\n  UNION ALL ".join(parts)
    return f"""
WITH a AS ({u}),
f AS (SELECT * FROM a WHERE value IS NOT NULL AND NOT isnan(value)),
r AS (SELECT *, row_number() OVER (PARTITION BY group_col, value_col ORDER BY value DESC, "group") AS rank,
             count(*) OVER (PARTITION BY group_col, value_col) AS n_groups,
             avg(value) OVER (PARTITION BY group_col, value_col) AS tot FROM f)
SELECT group_col, value_col, "group", round(value, 4) AS value,
       CASE WHEN tot <> 0 THEN round(100.0 * value / tot, 2) ELSE 0.0 END AS summary,
       CAST(rank AS BIGINT) AS rank, CAST(n_groups AS BIGINT) AS n_groups,
       rank <= {top} AS is_top, rank > n_groups - {bottom} AS is_bottom{extra}
FROM r WHERE rank <= {top_n} OR rank > n_groups - {bottom}"""


register("comparison_report", _report_sql("part", _PART_CATS, ["p_retailprice", "p_partkey"], 15, 5, 3))(
    lambda s, d: G.comparison_report(table(s, d, "part"), _PART_CATS, ["p_retailprice", "p_partkey"]))

_LI_G = ["l_returnflag", "l_linestatus"]
_LI_V = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
register("comparison_report_lineitem", _report_sql("lineitem", _LI_G, _LI_V, 15, 5, 3))(
    lambda s, d: G.comparison_report(table(s, d, "lineitem"), _LI_G, _LI_V))

_ins = _report_sql("part", _PART_CATS, ["p_retailprice"], 5, 5, 1)
_ins = (f"WITH rep AS ({_ins}) SELECT group_col, \"group\", value, rank, 'top' AS kind FROM rep WHERE is_top "
        "UNION ALL SELECT group_col, \"group\", value, rank, 'bottom' AS kind FROM rep WHERE is_bottom")
register("comparison_insights", _ins)(
    lambda s, d: G.comparison_insights(table(s, d, "part"), _PART_CATS, "p_retailprice"))

register("daily_mean_gapfilled", f"""
WITH g AS (SELECT CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS day,
                  CAST(sum(CAST(o_totalprice AS DECIMAL(38,6))) AS DOUBLE) / count(o_totalprice) AS value, count(o_totalprice) AS n
           FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1),
d AS (SELECT unnest(generate_series((SELECT min(day) FROM g), (SELECT max(day) FROM g), INTERVAL 1 DAY)) AS day)
SELECT d.day, {sround('g.value')} AS value, CAST(coalesce(g.n, 0) AS BIGINT) AS n_records
FROM d LEFT JOIN g ON d.day = g.day
""")(lambda s, d: G.daily_mean(table(s, d, "orders"), "o_orderdate", "o_totalprice"))
