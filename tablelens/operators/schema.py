"""Semantic type detection.

One aggregate pass computes, per column, the counts the rule cascade needs
(non-null, distinct, min/max, how many strings parse as numbers / dates /
boolean words). The cascade itself is a CASE expression over the exploded
per-column rows, so :func:`detect_schema` stays a lazy DataFrame; only
:func:`schema_types` collects it (one row per column) when a later plan's shape
depends on the types.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.functions.columns import col
from tablelens.functions.distinct import distinct_counts
from pyspark.sql import types as T

from tablelens.functions.dates import parse_timestamp
from tablelens.functions.stats import rnd
from tablelens.functions.text import parsed_double, pytrim
from tablelens.functions.types import (
    BOOLEAN, CATEGORICAL, CURRENCY, DATETIME, ID, NUMERIC, PERCENTAGE, TEXT, UNKNOWN,
)

# Name and value patterns of the rule cascade.
ID_NAME = r"(?i)(^|_|.)(id|uuid|guid|key|code|number|ref|reference)(_|$)"
BOOL_NAME = r"(?i)(^|_)(is|has|active|enabled|flag|verified|deleted)(_|$)"
CURRENCY_NAME = r"(price|amount|revenue|cost|salary|fee|total|sales|profit|income|cash)"
TEXT_NAME = r"(?i)(review|comment|feedback|message|description|text|content|note|transcript|query|address)"
BOOL_WORDS = ["true", "false", "t", "f", "yes", "no", "0", "1", "y", "n"]
DATE_RATIO = 0.85
CATEGORICAL_MAX = 60
ID_UNIQUE_RATIO = 0.8


def physical_kind(dt: T.DataType) -> str:
    if isinstance(dt, T.BooleanType):
        return "bool"
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int"
    if isinstance(dt, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float"
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    if isinstance(dt, T.StringType):
        return "string"
    return "other"


def is_missing(df: DataFrame, c: str):
    """Null, or NaN in a floating column (pandas ``isna``)."""
    dt = df.schema[c].dataType
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return col(c).isNull() | F.isnan(col(c))
    return col(c).isNull()


def single_valued(df: DataFrame, c: str):
    """Aggregate expression: true when ``c`` holds at most one distinct
    non-missing value. For orderable types this is ``min = max`` (a plain
    partial aggregate); ``count_distinct`` would copy every row once per
    distinct column."""
    present = F.when(~is_missing(df, c), col(c))
    if physical_kind(df.schema[c].dataType) in ("int", "float", "string", "bool", "datetime"):
        return F.min(present).isNull() | (F.min(present) == F.max(present))
    return F.count_distinct(present) <= 1


def column_stats(df: DataFrame, approx: bool = False) -> DataFrame:
    """(column, dtype, kind, n_rows, missing, distinct, vmin, vmax, date_ok, num_err, bool_bad), exploded per column from
    one aggregate over ``df``; distinct values are counted by digest, or estimated with ``approx``."""
    aggs, structs, values = [F.count(F.lit(1)).alias("_n")], [], {}
    for i, f in enumerate(df.schema.fields):
        c, kind = f.name, physical_kind(f.dataType)
        value = col(c)
        miss = is_missing(df, c)
        present = value.isNotNull() & ~miss
        values[str(i)] = F.when(present, value)
        aggs.append(F.count_if(miss).alias(f"m{i}"))
        if kind in ("int", "float"):
            aggs += [F.min(F.when(present, value)).cast("double").alias(f"lo{i}"),
                     F.max(F.when(present, value)).cast("double").alias(f"hi{i}")]
        else:
            aggs += [F.lit(None).cast("double").alias(f"lo{i}"), F.lit(None).cast("double").alias(f"hi{i}")]
        if kind == "string":
            norm = F.lower(pytrim(value))
            aggs += [F.count_if(value.isNotNull() & parse_timestamp(value).isNotNull()).alias(f"dt{i}"),
                     F.count_if(value.isNotNull() & parsed_double(value).isNull()).alias(f"ne{i}"),
                     F.count_if(value.isNotNull() & ~norm.isin(*BOOL_WORDS)).alias(f"bb{i}")]
        elif kind == "int":
            aggs += [F.lit(0).cast("long").alias(f"dt{i}"), F.lit(0).cast("long").alias(f"ne{i}"),
                     F.count_if(value.isNotNull() & ~value.isin(0, 1)).alias(f"bb{i}")]
        else:
            aggs += [F.lit(0).cast("long").alias(f"dt{i}"), F.lit(0).cast("long").alias(f"ne{i}"),
                     F.count_if(value.isNotNull()).alias(f"bb{i}")]
        structs.append(F.struct(
            F.lit(i).alias("pos"), F.lit(c).alias("column"), F.lit(f.dataType.simpleString()).alias("dtype"),
            F.lit(kind).alias("kind"), F.col(f"m{i}").cast("long").alias("missing"), F.col(f"lo{i}").alias("vmin"),
            F.col(f"hi{i}").alias("vmax"), F.col(f"dt{i}").cast("long").alias("date_ok"),
            F.col(f"ne{i}").cast("long").alias("num_err"), F.col(f"bb{i}").cast("long").alias("bool_bad")))
    distinct = distinct_counts(df, values, exact=not approx).select(F.col("name").cast("int").alias("pos"), "distinct")
    rows = df.agg(*aggs).select(F.col("_n").alias("n_rows"), F.explode(F.array(*structs)).alias("s")).select("n_rows", "s.*")
    return rows.join(F.broadcast(distinct), "pos")  # one row a column


def _semantic_type():
    name, kind = F.col("column"), F.col("kind")
    nonnull = F.col("n_rows") - F.col("missing")
    lname = F.lower(F.trim(name))
    bool_name = lname.rlike(BOOL_NAME)
    id_name = lname.rlike(ID_NAME)
    numeric = (
        F.when(bool_name | (F.col("bool_bad") == 0), F.lit(BOOLEAN))
        .when(id_name & (F.col("distinct") >= F.col("n_rows") * ID_UNIQUE_RATIO), F.lit(ID))
        .when(lname.rlike(CURRENCY_NAME), F.lit(CURRENCY))
        .when(lname.contains("%") | lname.contains("percent") | lname.endswith("_rate")
              | lname.endswith("_ratio")
              | ((nonnull > 0) & (F.col("vmin") >= 0) & (F.col("vmax") <= 1)), F.lit(PERCENTAGE))
        .otherwise(F.lit(NUMERIC)))
    string = (
        F.when((nonnull > 0) & (F.col("date_ok") >= DATE_RATIO * nonnull), F.lit(DATETIME))
        .when(F.col("num_err") == 0, F.lit(NUMERIC))
        .when(id_name, F.lit(ID))
        .when(bool_name | (F.col("bool_bad") == 0), F.lit(BOOLEAN))
        .when(name.rlike(TEXT_NAME) | (F.col("distinct") > CATEGORICAL_MAX), F.lit(TEXT))
        .otherwise(F.lit(CATEGORICAL)))
    return (F.when(kind == "bool", F.lit(BOOLEAN))
            .when(kind.isin("int", "float"), numeric)
            .when(kind == "datetime", F.lit(DATETIME))
            .when(kind == "string", string)
            .otherwise(F.lit(UNKNOWN)))


def detect_schema(df: DataFrame, approx: bool = False) -> DataFrame:
    """(column, dtype, semantic_type, cardinality, missing, missing_pct, unique, pos)."""
    st = column_stats(df, approx)
    return st.select(
        "column", "dtype", _semantic_type().alias("semantic_type"),
        F.col("distinct").alias("cardinality"), "missing",
        rnd(F.try_divide(F.col("missing"), F.col("n_rows")), 4).alias("missing_pct"),
        F.col("distinct").alias("unique"), F.col("pos").cast("long").alias("pos"))


def schema_types(df: DataFrame, approx: bool = False) -> dict:
    """{column: semantic type} in column order (collects one row per column)."""
    return types_of(detect_schema(df, approx))


def types_of(detected: DataFrame) -> dict:
    """:func:`schema_types` from the rows of :func:`detect_schema`."""
    rows = detected.select("pos", "column", "semantic_type").collect()
    return {r["column"]: r["semantic_type"] for r in sorted(rows, key=lambda r: r["pos"])}


_GROUPS = {
    "numeric": [NUMERIC, CURRENCY, PERCENTAGE], "categorical": [CATEGORICAL], "datetime": [DATETIME],
    "text": [TEXT], "boolean": [BOOLEAN], "id": [ID],
}


def schema_summary(schema: DataFrame) -> DataFrame:
    """(metric, value): total_columns, the six group totals and one
    ``type:<SEMANTIC>`` row per type present."""
    aggs = [F.count(F.lit(1)).alias("total_columns")] + [
        F.count_if(F.col("semantic_type").isin(*ts)).alias(g) for g, ts in _GROUPS.items()]
    wide = schema.agg(*aggs)
    fixed = wide.unpivot([], list(wide.columns), "metric", "value")
    by_type = schema.groupBy(F.concat(F.lit("type:"), F.col("semantic_type")).alias("metric")).agg(
        F.count(F.lit(1)).alias("value"))
    return fixed.unionByName(by_type).select("metric", F.col("value").cast("long").alias("value"))


def columns_by_type(schema: DataFrame) -> DataFrame:
    """(semantic_type, n_columns, columns) with columns in table order."""
    g = schema.groupBy("semantic_type").agg(
        F.count(F.lit(1)).alias("n_columns"),
        F.sort_array(F.collect_list(F.struct("pos", "column"))).alias("_c"))
    return g.select("semantic_type", F.col("n_columns").cast("long"),
                    F.array_join(F.transform("_c", lambda s: s["column"]), ",").alias("columns"))
