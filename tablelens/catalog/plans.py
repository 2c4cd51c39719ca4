"""Planning, chart rules, reporting and pipeline queries."""

from pyspark.sql import functions as F

from tablelens.catalog.base import register, table
from tablelens.catalog.clean import TITLE, _quality_sql
from tablelens.catalog.fixtures import DIRTY_EVENTS_SQL, dirty_events
from tablelens.catalog.profile import DIRTY_EVENTS_F, ORDERS_F, profile_sql, schema_sql
from tablelens.operators import profile as P
from tablelens.operators import schema as S
from tablelens.plans import auto, charts, planner, report

_NUM = "('NUMERIC', 'CURRENCY', 'PERCENTAGE')"
_CAT = "('CATEGORICAL', 'BOOLEAN')"

_steps = []
_always = "true", "'always used'"
_rule = {
    "detect_outliers": ("n > 0", "n || ' numeric column(s)'"),
    "analyze_distribution": ("n > 0", "n || ' numeric column(s)'"),
    "analyze_composition": ("k > 0", "k || ' categorical column(s)'"),
    "analyze_comparison": ("k > 0 AND n > 0", "k || ' categorical x ' || n || ' numeric'"),
    "analyze_relationships": ("n >= 2", "n || ' numeric column(s) for correlation'"),
    "analyze_time_series": ("d > 0", "d || ' datetime column(s)'"),
    "analyze_sentiment": ("x > 0", "x || ' text column(s)'"),
    "detect_anomalies": ("n > 0", "n || ' numeric column(s)'"),
    "generate_business_insights": ("true", "'rule-based findings over computed results'"),
}
for _i, _t in enumerate(planner.STEPS):
    _r, _why = _rule.get(_t, _always)
    _steps.append(f"SELECT CAST({_i + 1} AS BIGINT) AS step, '{_t}' AS tool, {_r} AS run, {_why} AS reason FROM c")

register("plan", f"""WITH {schema_sql('orders', ORDERS_F)},
c AS (SELECT count_if(semantic_type IN {_NUM}) AS n, count_if(semantic_type IN {_CAT}) AS k,
             count_if(semantic_type = 'DATETIME') AS d, count_if(semantic_type = 'TEXT') AS x FROM sch)
{' UNION ALL '.join(_steps)}
""")(lambda s, d: planner.build_plan(S.detect_schema(table(s, d, "orders"))))

_CCAT = "('CATEGORICAL', 'BOOLEAN', 'ID')"
_PAIR = f"""CASE WHEN x.semantic_type IN {_NUM} AND y.semantic_type IN {_NUM} THEN 'scatter|Both variables are numeric -> scatter plot'
     WHEN x.semantic_type IN {_CCAT} AND y.semantic_type IN {_NUM} THEN 'bar|Categorical x numeric -> bar chart'
     WHEN x.semantic_type IN {_NUM} AND y.semantic_type IN {_CCAT} THEN 'bar|Numeric x categorical -> bar chart (swapped)'
     WHEN x.semantic_type = 'DATETIME' AND y.semantic_type IN {_NUM} THEN 'line|Datetime x numeric -> line chart'
     WHEN x.semantic_type IN {_NUM} AND y.semantic_type = 'DATETIME' THEN 'line|Numeric x datetime -> line chart (swapped)'
     WHEN x.semantic_type IN {_CCAT} AND y.semantic_type IN {_CCAT} THEN 'grouped_bar|Two categoricals -> grouped/stacked bar'
     WHEN x.semantic_type = 'DATETIME' AND y.semantic_type IN {_CCAT} THEN 'line|Datetime x categorical -> line/trend chart'
     WHEN x.semantic_type = 'TEXT' THEN 'bar|Text column -> frequency bar chart'
     ELSE 'table|No strong chart recommendation; showing table' END"""
_SINGLE = f"""CASE WHEN semantic_type IN {_NUM} THEN 'histogram|Numeric single variable -> histogram/KDE'
     WHEN semantic_type IN {_CCAT} THEN 'bar|Categorical single variable -> frequency bar'
     WHEN semantic_type = 'DATETIME' THEN 'line|Datetime single variable -> line over time'
     WHEN semantic_type = 'TEXT' THEN 'word_freq|Text column -> top terms bar' ELSE 'table|default table' END"""
register("chart_rules", f"""WITH {schema_sql('orders', ORDERS_F)},
p AS (SELECT x."column" AS x, y."column" AS y, x.semantic_type AS x_type, y.semantic_type AS y_type, {_PAIR} AS r
      FROM sch x, sch y WHERE x.pos <> y.pos
      UNION ALL
      SELECT "column", NULL, semantic_type, NULL, {_SINGLE} FROM sch)
SELECT x, y, x_type, y_type, split_part(r, '|', 1) AS chart, split_part(r, '|', 2) AS reason FROM p
""")(lambda s, d: charts.chart_rules(S.detect_schema(table(s, d, "orders"))))

register("four_dimension_charts", f"""WITH {schema_sql('orders', ORDERS_F)},
a AS (SELECT list("column" ORDER BY pos) FILTER (WHERE semantic_type IN {_NUM}) AS num,
             list("column" ORDER BY pos) FILTER (WHERE semantic_type IN {_CAT}) AS cat,
             list("column" ORDER BY pos) FILTER (WHERE semantic_type = 'DATETIME') AS dt FROM sch),
r AS (SELECT 'composition' AS dimension, 'default' AS name, 'donut' AS chart, cat[1] AS columns, len(cat) > 0 AS ok FROM a
      UNION ALL SELECT 'comparison', 'default', 'bar', concat_ws(',', cat[1], num[1]), len(cat) > 0 FROM a
      UNION ALL SELECT 'distribution', 'default', 'histogram', num[1], len(num) > 0 FROM a
      UNION ALL SELECT 'relationship', 'default', 'heatmap', NULL, len(num) > 0 FROM a
      UNION ALL SELECT 'relationship', 'scatter', 'scatter', concat_ws(',', num[1], num[-1]), len(num) > 0 FROM a
      UNION ALL SELECT 'comparison', 'time', 'line', concat_ws(',', dt[1], num[1]), len(dt) > 0 AND len(num) > 0 FROM a)
SELECT dimension, name, chart, columns FROM r WHERE ok
""")(lambda s, d: charts.four_dimension_charts(S.detect_schema(table(s, d, "orders"))))


def _kpis(s, d):
    df = dirty_events(s, d)
    return report.kpis(P.dataset_profile(df), P.assess_quality(df), S.schema_summary(S.detect_schema(df)))


def _summary(s, d):
    df = dirty_events(s, d)
    return report.summary_metrics(P.dataset_profile(df), P.assess_quality(df), S.schema_summary(S.detect_schema(df)))


_DE_PARTS = f"""WITH {schema_sql(DIRTY_EVENTS_SQL, DIRTY_EVENTS_F)},
p AS ({profile_sql(DIRTY_EVENTS_SQL, DIRTY_EVENTS_F)}),
q AS ({_quality_sql(DIRTY_EVENTS_SQL, DIRTY_EVENTS_F)}),
c AS (SELECT count_if(semantic_type IN {_NUM}) AS n, count_if(semantic_type = 'CATEGORICAL') AS k,
             count_if(semantic_type = 'DATETIME') AS d FROM sch)"""

register("kpis", _DE_PARTS + """
SELECT CAST(1 AS BIGINT) AS pos, 'Records' AS label, format('{:,}', rows) AS value FROM p
UNION ALL SELECT 2, 'Columns', CAST(columns AS VARCHAR) FROM p
UNION ALL SELECT 3, 'Data Quality', CAST(score AS VARCHAR) || ' (Grade ' || grade || ')' FROM q
UNION ALL SELECT 4, 'Missing', CAST(missing_total_pct AS VARCHAR) || '%' FROM p
UNION ALL SELECT 5, 'Duplicates', format('{:,}', duplicates) FROM p
UNION ALL SELECT 6, 'Numeric', CAST(n AS VARCHAR) FROM c
UNION ALL SELECT 7, 'Categorical', CAST(k AS VARCHAR) FROM c
UNION ALL SELECT 8, 'Date cols', CAST(d AS VARCHAR) FROM c
""")(_kpis)

register("summary_metrics", _DE_PARTS + """
SELECT 'dataset' AS section, 'records' AS metric, CAST(rows AS VARCHAR) AS value FROM p
UNION ALL SELECT 'dataset', 'columns', CAST(columns AS VARCHAR) FROM p
UNION ALL SELECT 'dataset', 'missing_pct', CAST(missing_total_pct AS VARCHAR) FROM p
UNION ALL SELECT 'dataset', 'duplicate_rows', CAST(duplicates AS VARCHAR) FROM p
UNION ALL SELECT 'quality', 'score', CAST(score AS VARCHAR) FROM q
UNION ALL SELECT 'quality', 'grade', grade FROM q
UNION ALL SELECT 'schema', semantic_type, CAST(count(*) AS VARCHAR) FROM sch GROUP BY semantic_type
""")(_summary)


def _analysis(s, d):
    return auto.Analysis(table(s, d, "orders"), freq="M")


def _executed(name):
    return lambda s, d: _analysis(s, d).table(name)


def _status(s, d):
    a = _analysis(s, d)
    a.run()
    return a.status()


register("auto_eda")(_status)
# one query for each kind of result; the others are the operators' own queries on the same frame
for _name in ("findings", "insights", "report_text", "bundle", "anomaly_rows"):
    register({"bundle": "report_bundle", "anomaly_rows": "auto_anomaly_rows"}.get(_name, _name))(_executed(_name))
register("sections")(lambda s, d: report.parse_sections(_analysis(s, d).table("report_text"), "doc", "text"))

# the cleaned orders have the rows of the orders: no gaps, no repeated rows
_CATS, _NUMS = ("o_orderstatus", "o_orderpriority"), ("o_custkey", "o_totalprice")
_SERIES = "(" + " UNION ALL ".join(
    f"SELECT 'o_orderdate' AS date_col, '{v}' AS metric, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS bucket, "
    f"CAST(sum(CAST({v} AS DECIMAL(38,6))) AS DOUBLE) AS value FROM orders GROUP BY 3" for v in _NUMS) + ")"
register("auto_trend", f"""
WITH ix AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY bucket) - 1 AS idx FROM {_SERIES}),
r AS (SELECT date_col, metric, regr_slope(value, idx) AS slope, regr_r2(value, idx) AS r2, count(*) AS n FROM ix GROUP BY ALL)
SELECT date_col, metric, CASE WHEN n < 3 THEN 'insufficient' WHEN slope > 0 THEN 'increasing' WHEN slope < 0 THEN 'decreasing' ELSE 'flat' END AS direction,
       CASE WHEN n >= 3 THEN round(slope, 4) END AS slope, CASE WHEN n >= 3 THEN round(r2, 4) END AS r2 FROM r
""")(_executed("trend"))
register("auto_rolling_mean", f"""
WITH ix AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY bucket) - 1 AS idx, count(*) OVER (PARTITION BY metric) AS n FROM {_SERIES}),
w AS (SELECT *, greatest(2, least(7, n // 4)) AS w FROM ix)
SELECT a.date_col, a.metric, a.bucket, a.value, round(avg(b.value), 4) AS rolling_mean
FROM w a JOIN w b ON a.metric = b.metric AND b.idx <= a.idx AND b.idx > a.idx - a.w GROUP BY ALL
""")(_executed("rolling_mean"))
# cleaning writes category names in title case
_CLEANED = "(SELECT o_orderkey, o_custkey, {0} AS o_orderstatus, o_totalprice, o_orderdate, {1} AS o_orderpriority FROM orders)".format(
    *[TITLE.format(x=c) for c in _CATS])
register("auto_univariate_categorical", f"""
WITH m AS ({" UNION ALL ".join(f"SELECT '{c}' AS col, {c} AS value FROM {_CLEANED}" for c in _CATS)}),
vc AS (SELECT col, value, count(*) AS cnt FROM m GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY cnt DESC, value) AS rank, sum(cnt) OVER (PARTITION BY col) AS nn FROM vc)
SELECT col AS "column", value, CAST(cnt AS BIGINT) AS count, round(100.0 * cnt / nn, 2) AS pct, CAST(rank AS BIGINT) AS rank FROM r WHERE rank <= 10
""")(_executed("univariate_categorical"))
register("auto_cleaned", f"SELECT * FROM {_CLEANED}")(_executed("cleaned"))
register("auto_anomaly_notes", "SELECT 'isolation_forest' AS method, 'contamination' AS parameter, 0.02::DOUBLE AS value FROM orders LIMIT 1")(
    _executed("anomaly_notes"))
