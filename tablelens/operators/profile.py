"""Dataset profile, duplicates, missingness and the 0-100 quality score (A1-A4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.functions.columns import col, cols
from tablelens.functions.distinct import DIGEST, digest
from tablelens.functions.stats import attach, melt, rnd, value_counts
from tablelens.functions.text import pytrim, title_case
from tablelens.functions.types import CATEGORICAL, NUMERIC_GROUP
from tablelens.operators.schema import detect_schema, is_missing, physical_kind, schema_types, single_valued


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: (rows, distinct_rows, duplicates). Rows are compared on every column with nulls equal (pandas ``duplicated``),
    by their 128-bit digests: only digests are shuffled, and a hot duplicate costs one row per task."""
    g = df.select(*digest(cols(df))).groupBy(*DIGEST).agg(F.count(F.lit(1)).alias("_c"))
    return g.agg(F.coalesce(F.sum("_c"), F.lit(0)).cast("long").alias("rows"), F.count(F.lit(1)).cast("long").alias("distinct_rows")) \
            .select("rows", "distinct_rows", (F.col("rows") - F.col("distinct_rows")).alias("duplicates"))


def missing_counts(df: DataFrame) -> DataFrame:
    """(column, missing, n_rows, pos) from one aggregate."""
    aggs = [F.count_if(is_missing(df, c)).alias(f"m{i}") for i, c in enumerate(df.columns)]
    one = df.agg(F.count(F.lit(1)).alias("_n"), *aggs)
    rows = F.array(*[F.struct(F.lit(i).cast("long").alias("pos"), F.lit(c).alias("column"),
                              F.col(f"m{i}").cast("long").alias("missing")) for i, c in enumerate(df.columns)])
    return one.select(F.col("_n").alias("n_rows"), F.explode(rows).alias("s")).select("n_rows", "s.*")


def missing_report(df: DataFrame) -> DataFrame:
    """(column, missing, missing_pct, rank): most-missing first (table order on ties)."""
    mc = missing_counts(df)
    from pyspark.sql import Window
    w = Window.orderBy(F.col("missing").desc(), F.col("pos"))  # one row per column: bounded
    return mc.select("column", "missing",
                     rnd(100.0 * F.try_divide(F.col("missing"), F.col("n_rows")), 2).alias("missing_pct"),
                     F.row_number().over(w).cast("long").alias("rank"))


def dataset_profile(df: DataFrame) -> DataFrame:
    """One row: rows, columns, duplicates, missing_total, missing_total_pct
    (mean of per-column missing rates, in %)."""
    mc = missing_counts(df).agg(
        F.sum("missing").cast("long").alias("missing_total"),
        rnd(100.0 * F.avg(F.try_divide(F.col("missing"), F.col("n_rows"))), 2).alias("missing_total_pct"))
    d = duplicate_rows(df)
    return attach(d, mc).select(
        F.col("rows"), F.lit(len(df.columns)).cast("long").alias("columns"), "duplicates",
        "missing_total", "missing_total_pct")


def profile_columns(df: DataFrame) -> DataFrame:
    """Schema table plus min/max/mean/median/std (4 dp) for numeric columns."""
    sch = detect_schema(df)
    nums = [f.name for f in df.schema.fields if physical_kind(f.dataType) in ("int", "float")]
    if not nums:
        return sch.select("*", *[F.lit(None).cast("double").alias(k) for k in ("min", "max", "mean", "median", "std")])
    from tablelens.functions.summary import column_table
    st = column_table(df, nums, {"median": 0.5})
    return sch.join(st, "column", "left").select(
        "column", "dtype", "semantic_type", "cardinality", "missing", "missing_pct", "unique",
        rnd("min").alias("min"), rnd("max").alias("max"), rnd("mean").alias("mean"),
        rnd("median").alias("median"), rnd("std").alias("std"))


def _clamp(x):
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), x.cast("double")))


def assess_quality(df: DataFrame, types: dict | None = None) -> DataFrame:
    """One row: score (1 dp), grade, five sub-scores, rates (%) and issues.

    missing = mean per-column null rate; duplicates = duplicate rows / rows;
    invalid = unparseable values (nulls included) of numeric-typed string
    columns / non-null cells of all columns; consistency = mean over
    CATEGORICAL columns of repeats after trim/lower/title (SURVEY D5);
    emptiness = share of columns with at most one distinct value."""
    types = types if types is not None else schema_types(df)
    names = df.columns
    n_cols = len(names)
    kinds = {f.name: physical_kind(f.dataType) for f in df.schema.fields}
    aggs, spelled = [F.count(F.lit(1)).alias("_n")], {}
    nonnull_total, invalid, empties, cons = [], [], [], []
    for i, c in enumerate(names):
        miss = is_missing(df, c)
        aggs.append(F.count_if(miss).alias(f"m{i}"))
        nonnull_total.append(F.col(f"nn{i}"))
        aggs.append(F.count_if(~miss).alias(f"nn{i}"))
        aggs.append(single_valued(df, c).alias(f"e{i}"))
        empties.append(F.when(F.col(f"e{i}"), 1).otherwise(0))
        if types.get(c) in NUMERIC_GROUP and kinds[c] not in ("int", "float"):
            aggs.append(F.count_if(col(c).try_cast("double").isNull()).alias(f"iv{i}"))
            invalid.append(F.col(f"iv{i}"))
        if types.get(c) == CATEGORICAL:
            spelled[f"cd{i}"] = col(c).cast("string")
            cons.append(F.when(F.col(f"nn{i}") > 0,
                               (F.col(f"nn{i}") - F.col(f"cd{i}")) / F.col(f"nn{i}")))
    one = df.agg(*aggs)
    if spelled:
        # spelled alike: each different value is brought to its form once, not once a row
        # (the counts are read to the end, or Spark would drop the first group-by as one that the second repeats)
        different = value_counts(melt(df.select(*[v.alias(k) for k, v in spelled.items()]), list(spelled), "string"), ["column"])
        norm = title_case(F.lower(pytrim("value")))
        found = different.groupBy("column", norm.alias("norm")).agg(F.sum("cnt").alias("cnt"))
        one = attach(one, found.agg(*[F.count_if((F.col("column") == k) & (F.col("cnt") > 0)).alias(k) for k in spelled]))
    n = F.col("_n")
    miss_rate = sum((F.col(f"m{i}") / n for i in range(n_cols)), F.lit(0.0)) / n_cols
    dup = duplicate_rows(df).select(F.col("duplicates").alias("_dups"))
    one = attach(one, dup)
    dup_rate = F.col("_dups") / n
    tot_nn = sum(nonnull_total, F.lit(0))
    inv_rate = F.when(tot_nn > 0, sum(invalid, F.lit(0)) / tot_nn).otherwise(F.lit(0.0))
    n_cons = sum((F.when(x.isNotNull(), 1).otherwise(0) for x in cons), F.lit(0))
    pen = sum((F.coalesce(x, F.lit(0.0)) for x in cons), F.lit(0.0))
    cons_score = _clamp(F.when(n_cons > 0, 100 - 100.0 * pen / n_cons).otherwise(F.lit(100.0)))
    n_empty = sum(empties, F.lit(0))
    s = one.select(
        n.alias("_n"), _clamp(100 - miss_rate * 100).alias("missing_score"),
        _clamp(100 - dup_rate * 100).alias("duplicate_score"),
        _clamp(100 - inv_rate * 100).alias("invalid_score"), cons_score.alias("consistency_score"),
        _clamp(100 - 100.0 * n_empty / n_cols).alias("emptiness_score"),
        miss_rate.alias("_mr"), dup_rate.alias("_dr"), inv_rate.alias("_ir"), n_empty.alias("_ne"))
    score = F.round(0.30 * F.col("missing_score") + 0.20 * F.col("duplicate_score")
                    + 0.20 * F.col("invalid_score") + 0.15 * F.col("consistency_score")
                    + 0.15 * F.col("emptiness_score"), 1)
    s = s.withColumn("score", score)
    grade = (F.when(F.col("score") >= 90, "A").when(F.col("score") >= 75, "B")
             .when(F.col("score") >= 60, "C").when(F.col("score") >= 45, "D").otherwise("F"))
    pct1 = lambda x: F.format_string("%.1f", x * 100)
    issues = F.concat_ws("; ", F.array_compact(F.array(
        F.when(F.col("_mr") > 0.05, F.concat(F.lit("missing: "), pct1(F.col("_mr")), F.lit("% of cells are missing"))),
        F.when(F.col("_dr") > 0.02, F.concat(F.lit("duplicates: "), pct1(F.col("_dr")), F.lit("% duplicate rows"))),
        F.when(F.col("_ir") > 0.02, F.concat(F.lit("invalid: "), pct1(F.col("_ir")), F.lit("% invalid numeric values"))),
        F.when(F.col("_ne") > 0, F.concat(F.lit("emptiness: "), F.col("_ne").cast("string"),
                                          F.lit(" empty/constant column(s)"))))))
    empty = F.col("_n") == 0
    return s.select(
        F.when(empty, F.lit(0.0)).otherwise(F.col("score")).alias("score"),
        F.when(empty, F.lit("F")).otherwise(grade).alias("grade"),
        *[rnd(k, 4).alias(k) for k in ("missing_score", "duplicate_score", "invalid_score",
                                        "consistency_score", "emptiness_score")],
        rnd(F.col("_mr") * 100, 2).alias("missing_pct"), rnd(F.col("_dr") * 100, 2).alias("duplicate_rate"),
        rnd(F.col("_ir") * 100, 2).alias("invalid_rate"), issues.alias("issues"))
