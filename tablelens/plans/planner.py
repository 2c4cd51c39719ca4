"""K1: which analysis steps apply, from the semantic schema table (lazy)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.functions.types import CATEGORICAL_GROUP, DATETIME, NUMERIC_GROUP, TEXT

# The fifteen steps, in order.
STEPS = [
    "profile_dataset", "detect_data_types", "assess_quality", "clean_dataset", "analyze_missing_data",
    "detect_outliers", "analyze_distribution", "analyze_composition", "analyze_comparison",
    "analyze_relationships", "analyze_time_series", "analyze_sentiment", "detect_anomalies",
    "generate_business_insights", "generate_report",
]


def build_plan(schema: DataFrame) -> DataFrame:
    """(step, tool, run, reason) for all fifteen steps."""
    t = F.col("semantic_type")
    c = schema.agg(F.count_if(t.isin(*NUMERIC_GROUP)).alias("n"), F.count_if(t.isin(*CATEGORICAL_GROUP)).alias("k"),
                   F.count_if(t == DATETIME).alias("d"), F.count_if(t == TEXT).alias("x"))
    n, k, d, x = (F.col(a) for a in "nkdx")
    s = lambda v: v.cast("string")
    always = (F.lit(True), F.lit("always used"))
    rules = {
        "profile_dataset": always, "detect_data_types": always, "assess_quality": always,
        "clean_dataset": always, "analyze_missing_data": always,
        "detect_outliers": (n > 0, F.concat(s(n), F.lit(" numeric column(s)"))),
        "analyze_distribution": (n > 0, F.concat(s(n), F.lit(" numeric column(s)"))),
        "analyze_composition": (k > 0, F.concat(s(k), F.lit(" categorical column(s)"))),
        "analyze_comparison": ((k > 0) & (n > 0),
                               F.concat(s(k), F.lit(" categorical x "), s(n), F.lit(" numeric"))),
        "analyze_relationships": (n >= 2, F.concat(s(n), F.lit(" numeric column(s) for correlation"))),
        "analyze_time_series": (d > 0, F.concat(s(d), F.lit(" datetime column(s)"))),
        "analyze_sentiment": (x > 0, F.concat(s(x), F.lit(" text column(s)"))),
        "detect_anomalies": (n > 0, F.concat(s(n), F.lit(" numeric column(s)"))),
        "generate_business_insights": (F.lit(True), F.lit("rule-based findings over computed results")),
        "generate_report": always,
    }
    rows = F.array(*[F.struct(F.lit(i + 1).cast("long").alias("step"), F.lit(tool).alias("tool"),
                              rules[tool][0].alias("run"), rules[tool][1].alias("reason"))
                     for i, tool in enumerate(STEPS)])
    return c.select(F.explode(rows).alias("r")).select("r.*")
