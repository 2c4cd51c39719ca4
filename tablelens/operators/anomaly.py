"""Row-level anomaly masks, driver column and report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.functions.columns import col
from tablelens.functions.columns import cols as named
from tablelens.functions.stats import rnd
from tablelens.functions.summary import column_numbers, number
from tablelens.operators.outliers import column_bounds


def _wide_bounds(df: DataFrame, cols, quartiles: bool = True, bounds: DataFrame | None = None) -> DataFrame:
    """One row: mean/std_pop/q1/q3 of every column (k x 4 values)."""
    b = bounds if bounds is not None else column_bounds(df, cols, quartiles)
    aggs = []
    for c in cols:
        for k in ("mean", "std_pop", "q1", "q3"):
            aggs.append(F.max(F.when(F.col("column") == c, F.col(k))).alias(f"{c}__{k}"))
    return b.agg(*aggs)


def _z(c):
    return F.abs((number(c) - col(f"{c}__mean")) / col(f"{c}__std_pop"))


def _usable_std(c):
    return col(f"{c}__std_pop").isNotNull() & (col(f"{c}__std_pop") > 0)


def _with_bounds(df, cols, quartiles=True, bounds=None):
    from tablelens.functions.stats import attach
    return attach(df, _wide_bounds(df, cols, quartiles, bounds))


def zscore_mask(cols, threshold: float = 3.0):
    """OR over columns of |z| > threshold (ddof 0); constant columns skipped."""
    conds = [F.coalesce(_usable_std(c) & (_z(c) > threshold), F.lit(False)) for c in cols]
    return F.greatest(*conds) if len(conds) > 1 else conds[0]


def iqr_mask(cols, k: float = 1.5):
    """OR over columns of x outside the k*IQR fences; IQR 0 skipped."""
    conds = []
    for c in cols:
        q1, q3 = col(f"{c}__q1"), col(f"{c}__q3")
        iqr = q3 - q1
        conds.append(F.coalesce((iqr != 0) & ((number(c) < q1 - k * iqr) | (number(c) > q3 + k * iqr)), F.lit(False)))
    return F.greatest(*conds) if len(conds) > 1 else conds[0]


def flag_anomalies(df: DataFrame, cols: Sequence[str], method: str = "zscore", bounds: DataFrame | None = None) -> DataFrame:
    """df + ``is_anomaly`` (zscore or iqr rule), ``driver`` (column with the
    largest |z|, first on ties) and ``z_score`` (its |z|, 2 dp). Method
    ``isolation_forest``/``auto`` uses :mod:`tablelens.operators.iforest`. ``bounds``: the columns'
    :func:`column_bounds`, where they are known."""
    cols = list(cols)
    if method in ("isolation_forest", "auto"):
        from tablelens.operators.iforest import isolation_forest_flags
        flagged = isolation_forest_flags(df, cols)
        j = _with_bounds(flagged, cols, False, bounds)
        mask = F.col("is_anomaly")
    else:
        j = _with_bounds(df, cols, method != "zscore", bounds)
        mask = zscore_mask(cols) if method == "zscore" else iqr_mask(cols)
    zs = [F.when(_usable_std(c), F.coalesce(_z(c), F.lit(0.0))) for c in cols]
    best = F.greatest(*zs) if len(zs) > 1 else zs[0]
    driver = F.lit(None).cast("string")
    for c, z in reversed(list(zip(cols, zs))):
        driver = F.when(z == best, F.lit(c)).otherwise(driver)
    base = named(c for c in df.columns if c != "is_anomaly")
    return j.select(*base, mask.alias("is_anomaly"), driver.alias("driver"), rnd(best, 2).alias("z_score"))


def anomaly_table(df: DataFrame, cols: Sequence[str], method: str = "zscore") -> DataFrame:
    """Only the flagged rows, with driver and z_score."""
    return flag_anomalies(df, cols, method).filter(F.col("is_anomaly")).drop("is_anomaly")


def method_notes(df: DataFrame, cols: Sequence[str], method: str = "zscore") -> DataFrame:
    """N4's notes: (method, parameter, value) of the rule that :func:`flag_anomalies` applies to these columns. The
    isolation forest needs a column that varies; without one the z-score rule stands in."""
    forest = method in ("isolation_forest", "auto")
    if forest and not any((own["m2"] or 0) > 0 for own in column_numbers(df, cols, shape=True).values()):
        method = "zscore (no column varies)"
    elif forest:
        method = "isolation_forest"
    parameter, value = {"isolation_forest": ("contamination", 0.02), "iqr": ("k", 1.5)}.get(method, ("threshold", 3.0))
    return df.sparkSession.createDataFrame([(method, parameter, value)], "method string, parameter string, value double")


def anomaly_report(df: DataFrame, cols: Sequence[str], method: str = "zscore") -> DataFrame:
    """Per column IQR outlier count/pct (IQR 0 -> 0), plus an ``ALL_ROWS`` row
    with the rows flagged by ``method`` and their share of all rows."""
    from tablelens.operators.outliers import outlier_report
    known = column_bounds(df, cols)  # one set of scans for the report and the flags
    b = known.select("column", "iqr")
    per = outlier_report(df, cols, "iqr", known).join(b, "column").select(
        "column",
        F.when(F.col("iqr") == 0, F.lit(0)).otherwise(F.col("outlier_count")).cast("long").alias("anomaly_count"),
        F.when(F.col("iqr") == 0, F.lit(0.0)).otherwise(
            rnd(100.0 * F.col("outlier_count") / F.col("total_numeric"), 2)).alias("anomaly_pct"),
        F.lit("iqr").alias("method"))
    tot = flag_anomalies(df, cols, method, known).agg(
        F.count_if("is_anomaly").cast("long").alias("anomaly_count"),
        rnd(100.0 * F.count_if("is_anomaly") / F.greatest(F.count(F.lit(1)), F.lit(1)), 2).alias("anomaly_pct"))
    tot = tot.select(F.lit("ALL_ROWS").alias("column"), "anomaly_count", "anomaly_pct", F.lit(method).alias("method"))
    return per.unionByName(tot)
