"""Outlier, relationship and anomaly queries."""

from pyspark.sql import functions as F

from tablelens.catalog.base import ORACLE, qcont, register, sround, table
from tablelens.catalog.fixtures import SPIKY_EVENTS_SQL, spiky_events
from tablelens.operators import anomaly as N
from tablelens.operators import outliers as O
from tablelens.operators import relate as R

SE = SPIKY_EVENTS_SQL
LI = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _bounds_cte(src, cols, name="bnd"):
    parts = [f"SELECT '{c}' AS \"column\", n, mean, std_pop, {qcont('l', 'n', 0.25)} AS q1, "
             f"{qcont('l', 'n', 0.75)} AS q3 FROM (SELECT count(v) AS n, avg(v) AS mean, stddev_pop(v) AS std_pop, "
             f"list_sort(list(v)) AS l FROM (SELECT TRY_CAST({c} AS DOUBLE) AS v FROM {src}) "
             f"WHERE v IS NOT NULL AND NOT isnan(v))" for c in cols]
    return f"{name} AS ({' UNION ALL '.join(parts)})"


register("iqr_bounds", f"""WITH {_bounds_cte(SE, ['value', 'user_id'])}
SELECT "column", {sround('q1')} AS q1, {sround('q3')} AS q3, {sround('q3 - q1')} AS iqr,
       {sround('q1 - 1.5 * (q3 - q1)')} AS lower, {sround('q3 + 1.5 * (q3 - q1)')} AS upper FROM bnd
""")(lambda s, d: O.iqr_bounds(spiky_events(s, d), ["value", "user_id"]))


def _classify_sql(method):
    if method == "zscore":
        z = "CASE WHEN std_pop > 0 THEN (value - mean) / std_pop ELSE 0.0 END"
        cls = f"""CASE WHEN n < 4 OR value IS NULL THEN 'normal' WHEN abs({z}) > 4.5 THEN 'extreme'
                       WHEN abs({z}) > 3.0 THEN 'potential' ELSE 'normal' END"""
        score = z
    else:
        cls = """CASE WHEN n < 4 OR value IS NULL THEN 'normal'
                      WHEN value < q1 - 3 * (q3 - q1) OR value > q3 + 3 * (q3 - q1) THEN 'extreme'
                      WHEN value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) THEN 'potential'
                      ELSE 'normal' END"""
        score = "CASE WHEN (q3 + 1.5 * (q3 - q1)) - (q1 - 1.5 * (q3 - q1)) <> 0 THEN value - (q1 - 1.5 * (q3 - q1)) ELSE 0.0 END"
    return f"""WITH {_bounds_cte(SE, ['value'])}
SELECT event_id, ts, user_id, event_type, value, {cls} AS outlier_class,
       {sround(f"CASE WHEN n < 4 THEN 0.0 ELSE {score} END")} AS outlier_score
FROM {SE}, bnd"""


register("outlier_iqr", _classify_sql("iqr"))(lambda s, d: O.classify_outliers(spiky_events(s, d), "value"))
register("outlier_zscore", _classify_sql("zscore"))(
    lambda s, d: O.classify_outliers(spiky_events(s, d), "value", "zscore"))


def _report_sql(src, cols, method):
    if method == "zscore":
        z = "CASE WHEN std_pop > 0 THEN (x - mean) / std_pop ELSE 0.0 END"
        ext, pot = f"abs({z}) > 4.5", f"abs({z}) > 3.0"
    else:
        ext = "(x < q1 - 3 * (q3 - q1) OR x > q3 + 3 * (q3 - q1))"
        pot = "(x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1))"
    parts = [f"SELECT '{c}' AS \"column\", TRY_CAST({c} AS DOUBLE) AS x FROM {src}" for c in cols]
    return f"""WITH {_bounds_cte(src, cols)},
m AS ({' UNION ALL '.join(parts)}),
c AS (SELECT m."column", count(x) AS n_raw,
             count_if(n >= 4 AND x IS NOT NULL AND NOT isnan(x) AND NOT {ext} AND {pot}) AS pot,
             count_if(n >= 4 AND x IS NOT NULL AND NOT isnan(x) AND {ext}) AS ext
      FROM m JOIN bnd ON m."column" = bnd."column" GROUP BY m."column")
SELECT "column", CAST(n_raw AS BIGINT) AS total_numeric, CAST(pot AS BIGINT) AS potential_outliers,
       CAST(ext AS BIGINT) AS extreme_outliers, CAST(pot + ext AS BIGINT) AS outlier_count,
       CASE WHEN n_raw > 0 THEN round(100.0 * (pot + ext) / n_raw, 2) ELSE 0.0 END AS outlier_pct,
       CASE WHEN n_raw > 0 AND (pot + ext) / n_raw > 0.05 THEN 'High' WHEN pot + ext > 0 THEN 'Moderate'
            ELSE 'Low' END AS classification
FROM c"""


register("outlier_report", _report_sql("lineitem", LI, "iqr"))(
    lambda s, d: O.outlier_report(table(s, d, "lineitem"), LI))
register("outlier_report_zscore", _report_sql(SE, ["value", "user_id"], "zscore"))(
    lambda s, d: O.outlier_report(spiky_events(s, d), ["value", "user_id"], "zscore"))

register("outlier_remove", f"""
WITH b1 AS (SELECT count(value) AS n, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM {SE}),
r1 AS (SELECT e.* FROM {SE} e, b1 WHERE n < 4 OR value IS NULL OR NOT (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1))),
b2 AS (SELECT count(user_id) AS n, quantile_cont(user_id, 0.25) AS q1, quantile_cont(user_id, 0.75) AS q3 FROM r1),
r2 AS (SELECT r1.* FROM r1, b2 WHERE n < 4 OR user_id IS NULL OR NOT (user_id < q1 - 1.5 * (q3 - q1) OR user_id > q3 + 1.5 * (q3 - q1)))
SELECT * FROM r2
""")(lambda s, d: O.apply_outlier_strategy(spiky_events(s, d), ["value", "user_id"], "remove")[0])

register("outlier_keep", f"""
WITH r AS ({_report_sql(SE, ["value", "user_id"], "zscore")})
SELECT "column", 'keep_outliers' AS operation, outlier_count AS rows_affected, 'outliers preserved (user choice)' AS reason FROM r WHERE outlier_count > 0
""")(lambda s, d: s.createDataFrame(O.apply_outlier_strategy(spiky_events(s, d), ["value", "user_id"], "keep", "zscore")[1],
                                    '`column` string, operation string, rows_affected long, reason string'))

register("winsorize", f"""
WITH b AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM {SE})
SELECT event_id, ts, user_id, event_type,
       CASE WHEN value IS NULL THEN NULL ELSE least(greatest(value, q1 - 1.5 * (q3 - q1)), q3 + 1.5 * (q3 - q1)) END AS value
FROM {SE}, b
""")(lambda s, d: O.apply_outlier_strategy(spiky_events(s, d), ["value"], "winsorize")[0])


def _pairs_sql(src_rows, cols, fn):
    parts = []
    for i, a in enumerate(cols):
        for b in cols[i:]:
            parts.append(f"SELECT '{a}' AS a, '{b}' AS b, {fn(a, b)} AS v FROM {src_rows}")
            if a != b:
                parts.append(f"SELECT '{b}' AS a, '{a}' AS b, {fn(a, b)} AS v FROM {src_rows}")
    return "\n  UNION ALL ".join(parts)


def _corr(a, b):
    return (f"CASE WHEN stddev_pop({a}) * stddev_pop({b}) = 0 THEN NULL "
            f"ELSE covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b})) END")


register("pearson", f"SELECT a, b, round(v, 4) AS value FROM ({_pairs_sql('lineitem', LI, _corr)})")(
    lambda s, d: R.correlation_matrix(table(s, d, "lineitem"), LI))

_RANKS = ("(SELECT " + ", ".join(
    f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in LI)
    + " FROM lineitem)")
register("spearman", f"SELECT a, b, round(v, 4) AS value FROM ({_pairs_sql(_RANKS, LI, _corr)})")(
    lambda s, d: R.correlation_matrix(table(s, d, "lineitem"), LI, "spearman"))

register("covariance", f"SELECT a, b, round(v, 4) + 0.0 AS value FROM ({_pairs_sql('lineitem', LI, lambda a, b: f'covar_samp({a}, {b})')})")(
    lambda s, d: R.covariance_matrix(table(s, d, "lineitem"), LI))

_SECTIONS = ("pearson", "spearman", "covariance")


def _relationships(s, d):
    report = R.relationship_report(table(s, d, "lineitem").select(*LI), {c: "NUMERIC" for c in LI})
    out = None
    for name in _SECTIONS:
        t = report[name].select(F.lit(name).alias("section"), "a", "b", "value")
        out = t if out is None else out.unionByName(t)
    return out


register("relationship_report", "\nUNION ALL ".join(f"SELECT '{n}' AS section, a, b, value FROM ({ORACLE[n]})" for n in _SECTIONS))(_relationships)

_pos = " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(LI))
register("strongest_pairs", f"""
WITH m AS (SELECT a, b, v AS value, CASE a {_pos} END AS pa, CASE b {_pos} END AS pb
           FROM ({_pairs_sql('lineitem', LI, _corr)})),
u AS (SELECT * FROM m WHERE pa < pb AND value IS NOT NULL AND NOT isnan(value)),
r AS (SELECT *, row_number() OVER (ORDER BY abs(value) DESC, pa, pb) AS rank FROM u)
SELECT a, b, round(value, 4) AS corr, round(abs(value), 4) AS strength, CAST(rank AS BIGINT) AS rank FROM r WHERE rank <= 10
""")(lambda s, d: R.strongest_pairs(R.correlation_matrix(table(s, d, "lineitem"), LI, digits=None), LI))

# columns with gaps: each pair is ranked over the rows where both have a value
_GAPS = {"l_quantity": "l_linenumber = 3", "l_extendedprice": "l_returnflag = 'R'"}


def _gapped(s, d):
    from pyspark.sql import functions as F
    return table(s, d, "lineitem").withColumns({c: F.expr(f"IF({when}, NULL, {c})") for c, when in _GAPS.items()})


def _gap_ranks(a, b):
    both = f"(SELECT {a} AS a, {b} AS b FROM g WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
    rank = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0 AS {0}"
    return f"(SELECT {_corr('a', 'b')} FROM (SELECT {rank.format('a')}, {rank.format('b')} FROM {both}))"


_gap_cols = ", ".join(f"CASE WHEN {when} THEN NULL ELSE {c} END AS {c}" for c, when in _GAPS.items())
_gap_pairs = "\n  UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {_gap_ranks(a, b)} AS v" for a in LI for b in LI)
register("spearman_nulls", f"""
WITH g AS (SELECT * REPLACE ({_gap_cols}) FROM lineitem)
SELECT a, b, round(v, 4) AS value FROM ({_gap_pairs})
""")(lambda s, d: R.correlation_matrix(_gapped(s, d), LI, "spearman"))

CATS = ["l_returnflag", "l_linestatus", "l_tax"]


def _lbl(c):
    return f"coalesce(CAST({c} AS VARCHAR), '(null)')"


_cp = [(a, b) for i, a in enumerate(CATS) for b in CATS[i + 1:]]
_cpos = " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(CATS))
_ASSOC = f"""
WITH p AS ({' UNION ALL '.join(f"SELECT '{a}' AS a, '{b}' AS b, {_lbl(a)} AS va, {_lbl(b)} AS vb FROM lineitem" for a, b in _cp)}),
cells AS (SELECT a, b, va, vb, count(*) AS o FROM p GROUP BY ALL),
t AS (SELECT *, sum(o) OVER (PARTITION BY a, b, va) AS ri, sum(o) OVER (PARTITION BY a, b, vb) AS cj FROM cells),
s AS (SELECT a, b, sum(o) AS n, sum(o * o / (ri * cj)) AS s_, count(DISTINCT va) AS r, count(DISTINCT vb) AS c
      FROM t GROUP BY a, b),
v AS (SELECT a, b, n, n * (s_ - 1) AS chi2, least(r, c) AS k FROM s),
f AS (SELECT a, b, round(CASE WHEN n = 0 OR k < 2 OR chi2 <= 0 THEN 0.0 ELSE sqrt(chi2 / (n * (k - 1))) END, 4) AS cramers_v,
             round(chi2, 4) AS chi2, CAST(n AS BIGINT) AS n FROM v)
SELECT f.*, CAST(row_number() OVER (ORDER BY cramers_v DESC, CASE a {_cpos} END, CASE b {_cpos} END) AS BIGINT) AS rank FROM f
"""
register("associations", _ASSOC)(lambda s, d: R.categorical_associations(table(s, d, "lineitem"), CATS))

_AC = ["value", "user_id"]


def _anom_sql(method, only_flagged=True):
    z = {c: f"abs((TRY_CAST({c} AS DOUBLE) - b_{c}.mean) / b_{c}.std_pop)" for c in _AC}
    usable = {c: f"(b_{c}.std_pop IS NOT NULL AND b_{c}.std_pop > 0)" for c in _AC}
    if method == "zscore":
        mask = " OR ".join(f"coalesce({usable[c]} AND {z[c]} > 3.0, false)" for c in _AC)
    else:
        mask = " OR ".join(
            f"coalesce((b_{c}.q3 - b_{c}.q1) <> 0 AND ({c} < b_{c}.q1 - 1.5 * (b_{c}.q3 - b_{c}.q1) "
            f"OR {c} > b_{c}.q3 + 1.5 * (b_{c}.q3 - b_{c}.q1)), false)" for c in _AC)
    zz = {c: f"CASE WHEN {usable[c]} THEN coalesce({z[c]}, 0.0) END" for c in _AC}
    best = f"greatest({', '.join(zz.values())})"
    driver = "CASE " + " ".join(f"WHEN {zz[c]} = {best} THEN '{c}'" for c in _AC) + " END"
    bcte = ", ".join(f"{_bounds_cte(SE, [c], 'b_' + c)}" for c in _AC)
    joins = ", ".join(f"b_{c}" for c in _AC)
    return f"""WITH {bcte},
x AS (SELECT e.*, ({mask}) AS is_anomaly, {driver} AS driver, round({best}, 2) AS z_score FROM {SE} e, {joins})
SELECT {'event_id, ts, user_id, event_type, value, driver, z_score' if only_flagged else '*'} FROM x
{'WHERE is_anomaly' if only_flagged else ''}"""


register("anomaly_z", _anom_sql("zscore"))(lambda s, d: N.anomaly_table(spiky_events(s, d), _AC, "zscore"))
register("anomaly_iqr", _anom_sql("iqr"))(lambda s, d: N.anomaly_table(spiky_events(s, d), _AC, "iqr"))
register("anomaly_flags", _anom_sql("zscore", False))(lambda s, d: N.flag_anomalies(spiky_events(s, d), _AC, "zscore"))

register("anomaly_report", f"""WITH rep AS ({_report_sql(SE, _AC, 'iqr')}), {_bounds_cte(SE, _AC)},
fl AS ({_anom_sql('zscore', False)})
SELECT rep."column", CAST(CASE WHEN q3 - q1 = 0 THEN 0 ELSE outlier_count END AS BIGINT) AS anomaly_count,
       CASE WHEN q3 - q1 = 0 THEN 0.0 ELSE round(100.0 * outlier_count / total_numeric, 2) END AS anomaly_pct,
       'iqr' AS method
FROM rep JOIN bnd ON rep."column" = bnd."column"
UNION ALL
SELECT 'ALL_ROWS', CAST(count_if(is_anomaly) AS BIGINT), round(100.0 * count_if(is_anomaly) / greatest(count(*), 1), 2),
       'zscore' FROM fl
""")(lambda s, d: N.anomaly_report(spiky_events(s, d), _AC, "zscore"))


def _iforest(s, d):
    from tablelens.operators.iforest import isolation_forest_flags
    return isolation_forest_flags(spiky_events(s, d), ["value", "user_id"]).select(
        "event_id", "value", "user_id", "is_anomaly", "if_score")


register("isolation_forest")(_iforest)
register("anomaly_forest")(lambda s, d: N.anomaly_table(spiky_events(s, d), _AC, "isolation_forest"))
