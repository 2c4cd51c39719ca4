"""Cleaning and quality queries (C1-C13, A4) over the dirt fixtures."""

from tablelens.catalog.base import register, sround
from tablelens.catalog.fixtures import DIRTY_EVENTS_SQL, DIRTY_ORDERS_SQL, dirty_events, dirty_orders
from tablelens.catalog.profile import DIRTY_EVENTS_F, DIRTY_ORDERS_F, schema_sql
from tablelens.functions.types import DATETIME, NUMERIC
from tablelens.operators import clean as C
from tablelens.operators import profile as P

PYTRIM = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
TITLE = ("array_to_string(list_transform(regexp_extract_all({x}, '(\\p{{L}}+|[^\\p{{L}}]+)', 1), "
         "lambda w: upper(w[1]) || lower(w[2:])), '')")


def _trim_case(s, d):
    df = dirty_orders(s, d).select("o_orderkey", "priority")
    df, _ = C.trim_strings(df)
    df, _ = C.normalize_case(df, ["priority"])
    return df


register("trim_case", f"""
SELECT o_orderkey, {TITLE.format(x=PYTRIM.format(x='priority'))} AS priority FROM {DIRTY_ORDERS_SQL}
""")(_trim_case)

register("parse_dates", f"""
SELECT o_orderkey, TRY_CAST(trim(order_day) AS TIMESTAMP) AS order_day FROM {DIRTY_ORDERS_SQL}
""")(lambda s, d: C.parse_dates(dirty_orders(s, d).select("o_orderkey", "order_day"), ["order_day"])[0])

register("coerce_numeric", f"""
SELECT o_orderkey, TRY_CAST(replace(replace(amount, ',', ''), '$', '') AS DOUBLE) AS amount FROM {DIRTY_ORDERS_SQL}
""")(lambda s, d: C.coerce_numeric(dirty_orders(s, d).select("o_orderkey", "amount"), ["amount"])[0])

_DE = "event_id, ts, user_id, event_type, value, props, const_col, empty_col"
register("dup_mask", f"""
SELECT {_DE}, row_number() OVER (PARTITION BY {_DE}) > 1 AS is_duplicate FROM {DIRTY_EVENTS_SQL}
""")(lambda s, d: C.duplicate_mask(dirty_events(s, d)))

register("drop_dups", f"SELECT DISTINCT * FROM {DIRTY_EVENTS_SQL}")(
    lambda s, d: C.remove_duplicates(dirty_events(s, d))[0])

register("fill_median", f"""
SELECT event_id, coalesce(value, (SELECT quantile_cont(value, 0.5) FROM {DIRTY_EVENTS_SQL}
                                  WHERE value IS NOT NULL AND NOT isnan(value))) AS value
FROM {DIRTY_EVENTS_SQL}
""")(lambda s, d: C.fill_missing(dirty_events(s, d).select("event_id", "value"),
                                 {"event_id": "ID", "value": NUMERIC}, "median")[0])

register("fill_mean", f"""
SELECT event_id, coalesce(value, (SELECT avg(value) FROM {DIRTY_EVENTS_SQL}
                                  WHERE value IS NOT NULL AND NOT isnan(value))) AS value
FROM {DIRTY_EVENTS_SQL}
""")(lambda s, d: C.fill_missing(dirty_events(s, d).select("event_id", "value"),
                                 {"event_id": "ID", "value": NUMERIC}, "mean")[0])

register("fill_mode", f"""
SELECT event_id, coalesce(event_type, (SELECT event_type FROM {DIRTY_EVENTS_SQL} WHERE event_type IS NOT NULL
                                       GROUP BY 1 ORDER BY count(*) DESC, event_type LIMIT 1)) AS event_type
FROM {DIRTY_EVENTS_SQL}
""")(lambda s, d: C.fill_missing(dirty_events(s, d).select("event_id", "event_type"),
                                 {"event_id": "ID", "event_type": "CATEGORICAL"})[0])

for _dir, _frame in (("ffill", "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"),
                     ("bfill", "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING")):
    _fn = "last_value" if _dir == "ffill" else "first_value"
    register(_dir, f"""
SELECT event_id, {_fn}(ts IGNORE NULLS) OVER (ORDER BY event_id {_frame}) AS ts FROM {DIRTY_EVENTS_SQL}
""")((lambda dr: lambda s, d: C.fill_missing(dirty_events(s, d).select("event_id", "ts"),
                                              {"event_id": "ID", "ts": DATETIME},
                                              datetime_strategy=dr, order_by="event_id")[0])(_dir))

register("drop_constant", f"""
SELECT event_id, ts, user_id, event_type, value, props FROM {DIRTY_EVENTS_SQL}
""")(lambda s, d: C.drop_constant_columns(dirty_events(s, d))[0])

register("clean_profile_summary", f"""
WITH m AS (SELECT {' UNION ALL SELECT '.join(
    f"count_if({c} IS NULL{' OR isnan(' + c + ')' if k == 'float' else ''}) AS mi, count(*) AS n FROM {DIRTY_EVENTS_SQL}"
    for c, _, k in DIRTY_EVENTS_F)})
SELECT CAST((SELECT count(*) FROM {DIRTY_EVENTS_SQL}) AS BIGINT) AS rows, CAST(8 AS BIGINT) AS columns,
       CAST((SELECT sum(mi) FROM m) AS BIGINT) AS missing,
       round(100.0 * (SELECT avg(mi / n) FROM m), 2) AS missing_pct,
       CAST((SELECT count(*) FROM {DIRTY_EVENTS_SQL}) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {DIRTY_EVENTS_SQL}))
            AS BIGINT) AS duplicates,
       CAST(4 AS BIGINT) AS numeric_cols
""")(lambda s, d: C.profile_summary(dirty_events(s, d)))


def _pipeline_log(s, d):
    return C.clean_dataset(dirty_orders(s, d)).log


def _pipeline_summary(s, d):
    return C.clean_dataset(dirty_events(s, d), order_by="event_id").summary()


register("clean_summary")(_pipeline_summary)


def _quality_sql(src, fields):
    per = []
    for c, _, k in fields:
        isnull = f"({c} IS NULL OR isnan({c}))" if k == "float" else f"({c} IS NULL)"
        t = f"(SELECT semantic_type FROM sch WHERE \"column\" = '{c}')"
        if k == "string":
            inv = (f"CASE WHEN {t} IN ('NUMERIC', 'CURRENCY', 'PERCENTAGE') "
                   f"THEN count_if(TRY_CAST({c} AS DOUBLE) IS NULL) ELSE 0 END")
            cons = (f"CASE WHEN {t} = 'CATEGORICAL' AND count({c}) > 0 THEN "
                    f"(count({c}) - count(DISTINCT lower({PYTRIM.format(x=c)}))) / count({c}) END")
        else:
            inv, cons = "0", "CAST(NULL AS DOUBLE)"
        per.append(f"SELECT count(*) AS n, count_if({isnull}) AS miss, count_if(NOT {isnull}) AS nn, "
                   f"count(DISTINCT CASE WHEN NOT {isnull} THEN {c} END) AS d, {inv} AS inv, {cons} AS cons "
                   f"FROM {src}")
    u = "\n  UNION ALL ".join(per)
    n_cols = len(fields)
    return f"""WITH {schema_sql(src, fields)},
per AS ({u}),
a AS (SELECT max(n) AS n, avg(miss / n) AS mr, sum(nn) AS tot_nn, sum(inv) AS inv, count(cons) AS n_cons,
             coalesce(sum(cons), 0) AS pen, count_if(d <= 1) AS ne FROM per),
dup AS (SELECT (SELECT count(*) FROM {src}) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {src})) AS dups),
r AS (SELECT a.*, dup.dups / a.n AS dr, CASE WHEN tot_nn > 0 THEN inv / tot_nn ELSE 0.0 END AS ir FROM a, dup),
sc AS (SELECT r.*, greatest(0.0, least(100.0, 100 - mr * 100)) AS missing_score,
              greatest(0.0, least(100.0, 100 - dr * 100)) AS duplicate_score,
              greatest(0.0, least(100.0, 100 - ir * 100)) AS invalid_score,
              greatest(0.0, least(100.0, CASE WHEN n_cons > 0 THEN 100 - 100.0 * pen / n_cons ELSE 100.0 END))
                AS consistency_score,
              greatest(0.0, least(100.0, 100 - 100.0 * ne / {n_cols})) AS emptiness_score FROM r),
s2 AS (SELECT sc.*, {sround('0.30 * missing_score + 0.20 * duplicate_score + 0.20 * invalid_score '
                            '+ 0.15 * consistency_score + 0.15 * emptiness_score', 1)} AS score FROM sc)
SELECT score, CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C'
                   WHEN score >= 45 THEN 'D' ELSE 'F' END AS grade,
       round(missing_score, 4) AS missing_score, round(duplicate_score, 4) AS duplicate_score,
       round(invalid_score, 4) AS invalid_score, round(consistency_score, 4) AS consistency_score,
       round(emptiness_score, 4) AS emptiness_score, round(mr * 100, 2) AS missing_pct,
       round(dr * 100, 2) AS duplicate_rate, round(ir * 100, 2) AS invalid_rate,
       concat_ws('; ',
         CASE WHEN mr > 0.05 THEN 'missing: ' || printf('%.1f', mr * 100) || '% of cells are missing' END,
         CASE WHEN dr > 0.02 THEN 'duplicates: ' || printf('%.1f', dr * 100) || '% duplicate rows' END,
         CASE WHEN ir > 0.02 THEN 'invalid: ' || printf('%.1f', ir * 100) || '% invalid numeric values' END,
         CASE WHEN ne > 0 THEN 'emptiness: ' || CAST(ne AS VARCHAR) || ' empty/constant column(s)' END) AS issues
FROM s2"""


register("data_quality", _quality_sql(DIRTY_EVENTS_SQL, DIRTY_EVENTS_F))(
    lambda s, d: P.assess_quality(dirty_events(s, d)))
register("data_quality_orders", _quality_sql(DIRTY_ORDERS_SQL, DIRTY_ORDERS_F))(
    lambda s, d: P.assess_quality(dirty_orders(s, d)))


def _cleaning_log_sql(src, fields):
    """The clean_dataset audit log computed in SQL; each step's applicability
    comes from the semantic types of the ``sch`` CTE."""
    def typ(c):
        return f"(SELECT semantic_type FROM sch WHERE \"column\" = '{c}')"
    num_types = "('NUMERIC', 'CURRENCY', 'PERCENTAGE')"
    strings = [(i, c) for i, (c, _, k) in enumerate(fields) if k == "string"]
    tr = {c: PYTRIM.format(x=c) for _, c in strings}
    parts = []
    for i, c in strings:
        parts.append(f"SELECT 1 AS st, {i} AS pos, '{c}' AS col, 'trim_whitespace' AS op, count_if({c} <> {tr[c]}) AS n, "
                     f"'trimmed surrounding whitespace' AS reason FROM {src}")
        parts.append(f"SELECT 2, {i}, '{c}', 'normalize_category_case', "
                     f"CASE WHEN {typ(c)} = 'CATEGORICAL' THEN count_if({tr[c]} <> {TITLE.format(x=tr[c])}) ELSE 0 END, "
                     f"'normalised inconsistent capitalisation' FROM {src}")
        parsed = f"count(TRY_CAST(trim({tr[c]}) AS TIMESTAMP))"
        parts.append(f"SELECT 3, {i}, '{c}', 'parse_datetime', CASE WHEN {typ(c)} = 'DATETIME' THEN {parsed} ELSE 0 END, "
                     f"'parsed ' || {parsed} || ' values to datetime' FROM {src}")
        coerced = f"count(TRY_CAST(replace(replace({tr[c]}, ',', ''), '$', '') AS DOUBLE))"
        parts.append(f"SELECT 4, {i}, '{c}', 'coerce_numeric', CASE WHEN {typ(c)} IN {num_types} THEN {coerced} ELSE 0 END, "
                     f"'converted numeric strings to numbers' FROM {src}")
    # the cleaned values of every column (strings: trimmed, title-cased, parsed or coerced by type)
    vals = []
    for c, _, k in fields:
        if k != "string":
            vals.append(f"{c}")
            continue
        vals.append(f"""CASE {typ(c)} WHEN 'CATEGORICAL' THEN {TITLE.format(x=tr[c])}
            WHEN 'DATETIME' THEN CAST(TRY_CAST(trim({tr[c]}) AS TIMESTAMP) AS VARCHAR)
            ELSE CASE WHEN {typ(c)} IN {num_types}
                      THEN CAST(TRY_CAST(replace(replace({tr[c]}, ',', ''), '$', '') AS DOUBLE) AS VARCHAR)
                      ELSE {tr[c]} END END AS {c}""")
    cleaned = f"(SELECT {', '.join(vals)} FROM {src})"
    parts.append(f"SELECT 5, 0, 'ALL_ROWS', 'remove_exact_duplicates', "
                 f"(SELECT count(*) FROM {cleaned}) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {cleaned})), "
                 f"'removed ' || ((SELECT count(*) FROM {cleaned}) - (SELECT count(*) FROM (SELECT DISTINCT * FROM "
                 f"{cleaned}))) || ' exact duplicate row(s)'")
    dedup = f"(SELECT DISTINCT * FROM {cleaned})"
    for i, (c, _, k) in enumerate(fields):
        miss = f"count_if({c} IS NULL{' OR isnan(' + c + ')' if k == 'float' else ''})"
        parts.append(f"SELECT 6, {i}, '{c}', CASE WHEN {typ(c)} = 'DATETIME' THEN 'datetime_none' ELSE 'fill_mode' END, "
                     f"CASE WHEN {typ(c)} = 'DATETIME' OR {typ(c)} NOT IN {num_types} THEN {miss} ELSE 0 END, "
                     f"CASE WHEN {typ(c)} = 'DATETIME' THEN 'datetime not imputed blindly' "
                     f"ELSE 'imputed with mode ''' || coalesce((SELECT CAST({c} AS VARCHAR) FROM {dedup} "
                     f"WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), '') || '''' END FROM {dedup}")
    consts = " + ".join(f"(SELECT CASE WHEN count(DISTINCT {c}) <= 1 THEN 1 ELSE 0 END FROM {dedup})"
                        for c, _, _ in fields)
    parts.append(f"SELECT 7, 0, 'ALL_COLUMNS', 'drop_empty_or_constant', {consts}, "
                 f"'dropped ' || ({consts}) || ' empty/constant column(s)'")
    u = "\n  UNION ALL ".join(parts)
    return f"""WITH {schema_sql(src, fields)},
lg AS ({u})
SELECT CAST(row_number() OVER (ORDER BY st, pos) AS INTEGER) AS seq, col AS "column", op AS operation,
       CAST(n AS BIGINT) AS rows_affected, reason
FROM lg WHERE n > 0"""


register("cleaning_log", _cleaning_log_sql(DIRTY_ORDERS_SQL, DIRTY_ORDERS_F))(_pipeline_log)
