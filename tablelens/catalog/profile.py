"""Schema detection, profile, missingness, duplicates and quality queries."""

from tablelens.catalog.base import register, table
from tablelens.catalog.fixtures import DIRTY_EVENTS_SQL, DIRTY_ORDERS_SQL, dirty_events, dirty_orders
from tablelens.operators import profile as P
from tablelens.operators import schema as S

ORDERS_F = [("o_orderkey", "bigint", "int"), ("o_custkey", "bigint", "int"),
            ("o_orderstatus", "string", "string"), ("o_totalprice", "double", "float"),
            ("o_orderdate", "timestamp_ntz", "datetime"), ("o_orderpriority", "string", "string")]
CUSTOMER_F = [("c_custkey", "bigint", "int"), ("c_name", "string", "string"), ("c_nationkey", "int", "int"),
              ("c_acctbal", "double", "float"), ("c_mktsegment", "string", "string")]
EVENTS_F = [("event_id", "bigint", "int"), ("ts", "timestamp_ntz", "datetime"), ("user_id", "bigint", "int"),
            ("event_type", "string", "string"), ("value", "double", "float"), ("props", "string", "string")]
DIRTY_EVENTS_F = EVENTS_F + [("const_col", "int", "int"), ("empty_col", "string", "string")]
DIRTY_ORDERS_F = [("o_orderkey", "bigint", "int"), ("priority", "string", "string"),
                  ("amount", "string", "string"), ("order_day", "string", "string"),
                  ("status", "string", "string"), ("o_totalprice", "double", "float")]
_BOOLS = ", ".join(f"'{w}'" for w in S.BOOL_WORDS)


def _stats_sql(src, fields):
    parts = []
    for i, (c, dt, kind) in enumerate(fields):
        isnull = f"({c} IS NULL OR isnan({c}))" if kind == "float" else f"({c} IS NULL)"
        present = f"NOT {isnull}"
        num = kind in ("int", "float")
        vmin = f"CAST(min(CASE WHEN {present} THEN {c} END) AS DOUBLE)" if num else "CAST(NULL AS DOUBLE)"
        vmax = f"CAST(max(CASE WHEN {present} THEN {c} END) AS DOUBLE)" if num else "CAST(NULL AS DOUBLE)"
        if kind == "string":
            date_ok = f"count_if({c} IS NOT NULL AND TRY_CAST(trim({c}) AS TIMESTAMP) IS NOT NULL)"
            num_err = f"count_if({c} IS NOT NULL AND TRY_CAST({c} AS DOUBLE) IS NULL)"
            bool_bad = (f"count_if({c} IS NOT NULL AND lower(regexp_replace({c}, '^\\s+|\\s+$', '', 'g')) "
                        f"NOT IN ({_BOOLS}))")
        elif kind == "int":
            date_ok, num_err = "0", "0"
            bool_bad = f"count_if({c} IS NOT NULL AND {c} NOT IN (0, 1))"
        else:
            date_ok, num_err, bool_bad = "0", "0", f"count_if({c} IS NOT NULL)"
        parts.append(
            f"SELECT {i} AS pos, '{c}' AS \"column\", '{dt}' AS dtype, '{kind}' AS kind, count(*) AS n_rows, "
            f"count_if({isnull}) AS missing, count(DISTINCT CASE WHEN {present} THEN {c} END) AS dist, "
            f"{vmin} AS vmin, {vmax} AS vmax, {date_ok} AS date_ok, {num_err} AS num_err, "
            f"{bool_bad} AS bool_bad FROM {src}")
    return "\n  UNION ALL ".join(parts)


def schema_sql(src, fields):
    """CTE ``sch`` with the detect_schema columns."""
    idn, bln, cur, txt = S.ID_NAME, S.BOOL_NAME, S.CURRENCY_NAME, S.TEXT_NAME
    return f"""
st AS ({_stats_sql(src, fields)}),
st2 AS (SELECT *, lower(trim("column")) AS lname, n_rows - missing AS nonnull FROM st),
sch AS (SELECT "column", dtype,
  CASE WHEN kind = 'bool' THEN 'BOOLEAN'
       WHEN kind IN ('int', 'float') THEN CASE
            WHEN regexp_matches(lname, '{bln}') OR bool_bad = 0 THEN 'BOOLEAN'
            WHEN regexp_matches(lname, '{idn}') AND dist >= n_rows * 0.8 THEN 'ID'
            WHEN regexp_matches(lname, '{cur}') THEN 'CURRENCY'
            WHEN contains(lname, '%') OR contains(lname, 'percent') OR ends_with(lname, '_rate')
                 OR ends_with(lname, '_ratio') OR (nonnull > 0 AND vmin >= 0 AND vmax <= 1) THEN 'PERCENTAGE'
            ELSE 'NUMERIC' END
       WHEN kind = 'datetime' THEN 'DATETIME'
       WHEN kind = 'string' THEN CASE
            WHEN nonnull > 0 AND date_ok >= 0.85 * nonnull THEN 'DATETIME'
            WHEN num_err = 0 THEN 'NUMERIC'
            WHEN regexp_matches(lname, '{idn}') THEN 'ID'
            WHEN regexp_matches(lname, '{bln}') OR bool_bad = 0 THEN 'BOOLEAN'
            WHEN regexp_matches("column", '{txt}') OR dist > 60 THEN 'TEXT'
            ELSE 'CATEGORICAL' END
       ELSE 'UNKNOWN' END AS semantic_type,
  CAST(dist AS BIGINT) AS cardinality, CAST(missing AS BIGINT) AS missing,
  round(missing / n_rows, 4) AS missing_pct, CAST(dist AS BIGINT) AS "unique", CAST(pos AS BIGINT) AS pos
FROM st2)"""


_SCHEMA_CASES = {
    "orders": ("orders", ORDERS_F, lambda s, d: table(s, d, "orders")),
    "customer": ("customer", CUSTOMER_F, lambda s, d: table(s, d, "customer")),
    "events": ("events", EVENTS_F, lambda s, d: table(s, d, "events")),
    "dirty_events": (DIRTY_EVENTS_SQL, DIRTY_EVENTS_F, dirty_events),
    "dirty_orders": (DIRTY_ORDERS_SQL, DIRTY_ORDERS_F, dirty_orders),
}

for _k, (_src, _f, _load) in _SCHEMA_CASES.items():
    register(f"detect_schema_{_k}", f"WITH {schema_sql(_src, _f)} SELECT * FROM sch")(
        (lambda ld: lambda s, d: S.detect_schema(ld(s, d)))(_load))

register("schema_summary", f"""WITH {schema_sql(DIRTY_EVENTS_SQL, DIRTY_EVENTS_F)}
SELECT 'total_columns' AS metric, CAST(count(*) AS BIGINT) AS value FROM sch
UNION ALL SELECT 'numeric', CAST(count_if(semantic_type IN ('NUMERIC', 'CURRENCY', 'PERCENTAGE')) AS BIGINT) FROM sch
UNION ALL SELECT 'categorical', CAST(count_if(semantic_type = 'CATEGORICAL') AS BIGINT) FROM sch
UNION ALL SELECT 'datetime', CAST(count_if(semantic_type = 'DATETIME') AS BIGINT) FROM sch
UNION ALL SELECT 'text', CAST(count_if(semantic_type = 'TEXT') AS BIGINT) FROM sch
UNION ALL SELECT 'boolean', CAST(count_if(semantic_type = 'BOOLEAN') AS BIGINT) FROM sch
UNION ALL SELECT 'id', CAST(count_if(semantic_type = 'ID') AS BIGINT) FROM sch
UNION ALL SELECT 'type:' || semantic_type, CAST(count(*) AS BIGINT) FROM sch GROUP BY semantic_type
""")(lambda s, d: S.schema_summary(S.detect_schema(dirty_events(s, d))))

register("columns_by_type", f"""WITH {schema_sql('orders', ORDERS_F)}
SELECT semantic_type, CAST(count(*) AS BIGINT) AS n_columns, string_agg("column", ',' ORDER BY pos) AS columns
FROM sch GROUP BY semantic_type
""")(lambda s, d: S.columns_by_type(S.detect_schema(table(s, d, "orders"))))


def _num_stats_sql(src, fields):
    parts = []
    for c, dt, kind in fields:
        if kind not in ("int", "float"):
            continue
        v = f"CAST({c} AS DOUBLE)"
        parts.append(f"SELECT '{c}' AS \"column\", min({v}) AS mn, max({v}) AS mx, avg({v}) AS mean, "
                     f"quantile_cont({v}, 0.5) AS med, stddev_samp({v}) AS sd FROM {src} "
                     f"WHERE {c} IS NOT NULL AND NOT isnan({v})")
    return "\n  UNION ALL ".join(parts)


register("profile_columns", f"""WITH {schema_sql('customer', CUSTOMER_F)},
ns AS ({_num_stats_sql('customer', CUSTOMER_F)})
SELECT sch."column", dtype, semantic_type, cardinality, missing, missing_pct, "unique",
       round(mn, 4) AS min, round(mx, 4) AS max, round(mean, 4) AS mean, round(med, 4) AS median,
       round(sd, 4) AS std
FROM sch LEFT JOIN ns ON sch."column" = ns."column"
""")(lambda s, d: P.profile_columns(table(s, d, "customer")))

_DE_COLS = [c for c, _, _ in DIRTY_EVENTS_F]


def _missing_sql(src, fields):
    parts = []
    for i, (c, dt, kind) in enumerate(fields):
        isnull = f"({c} IS NULL OR isnan({c}))" if kind == "float" else f"({c} IS NULL)"
        parts.append(f"SELECT {i} AS pos, '{c}' AS \"column\", count_if({isnull}) AS missing, "
                     f"count(*) AS n_rows FROM {src}")
    return "\n  UNION ALL ".join(parts)


register("missing_report", f"""WITH m AS ({_missing_sql(DIRTY_EVENTS_SQL, DIRTY_EVENTS_F)})
SELECT "column", CAST(missing AS BIGINT) AS missing, round(100.0 * missing / n_rows, 2) AS missing_pct,
       CAST(row_number() OVER (ORDER BY missing DESC, pos) AS BIGINT) AS rank
FROM m
""")(lambda s, d: P.missing_report(dirty_events(s, d)))

_dup_sql = f"""(SELECT CAST(count(*) AS BIGINT) AS rows, CAST((SELECT count(*) FROM (SELECT DISTINCT * FROM
  {DIRTY_EVENTS_SQL})) AS BIGINT) AS distinct_rows FROM {DIRTY_EVENTS_SQL})"""
register("duplicate_count", f"""
SELECT rows, distinct_rows, rows - distinct_rows AS duplicates FROM {_dup_sql}
""")(lambda s, d: P.duplicate_rows(dirty_events(s, d)))

def profile_sql(src, fields):
    dup = f"""(SELECT CAST(count(*) AS BIGINT) AS rows, CAST((SELECT count(*) FROM (SELECT DISTINCT * FROM
  {src})) AS BIGINT) AS distinct_rows FROM {src})"""
    return f"""WITH m AS ({_missing_sql(src, fields)}),
d AS {dup}
SELECT rows, CAST({len(fields)} AS BIGINT) AS columns, rows - distinct_rows AS duplicates,
       CAST((SELECT sum(missing) FROM m) AS BIGINT) AS missing_total,
       round(100.0 * (SELECT avg(missing / n_rows) FROM m), 2) AS missing_total_pct
FROM d"""


register("dataset_profile", profile_sql(DIRTY_EVENTS_SQL, DIRTY_EVENTS_F))(lambda s, d: P.dataset_profile(dirty_events(s, d)))
