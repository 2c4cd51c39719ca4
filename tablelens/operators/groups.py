"""Composition (category shares) and comparison (group-by metrics), G1-G9.

Group labels are strings; a null group is kept under the label ``(null)``
(SURVEY D3). Single-key top-n uses ``orderBy().limit()`` (each task keeps n
rows) and the tail is total minus head, so no ranking of all groups is needed;
per-column top-n uses the skew-safe ranking helper.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablelens.functions.columns import col as named

from tablelens.functions.stats import attach, exact_mean, exact_quantiles, melt, rnd, row_numbers, top_k

NULL_LABEL = "(null)"


def label(c) -> "F.Column":
    value = named(c) if isinstance(c, str) else c
    return F.coalesce(value.cast("string"), F.lit(NULL_LABEL))


def _num(c: str):
    return named(c).try_cast("double")


def composition(df: DataFrame, cat: str, value_col: str | None = None, top_n: int = 15) -> DataFrame:
    """Share table of one categorical column.

    Count mode: (category, count, share_pct, rank). Value mode (``value_col``):
    (category, value, share_pct, rank) with the metric summed per category;
    categories without any numeric value are dropped. Beyond ``top_n`` the tail
    is folded into one ``Other`` row (rank top_n+1) with its true count/value and
    share (SURVEY D4)."""
    metric = "count" if value_col is None else "value"
    if value_col is None:
        g = df.groupBy(label(cat).alias("category")).agg(F.count(F.lit(1)).alias("m"))
    else:
        g = (df.groupBy(label(cat).alias("category")).agg(F.sum(_num(value_col)).alias("m"))
               .filter(F.col("m").isNotNull()))
    tot = g.agg(F.sum("m").alias("_tot"), F.count(F.lit(1)).alias("_k"))
    head = g.orderBy(F.col("m").desc(), F.col("category")).limit(top_n)
    head = head.withColumn("rank", F.row_number().over(Window.orderBy(F.col("m").desc(), F.col("category"))))
    hs = head.agg(F.sum("m").alias("_hs"), F.count(F.lit(1)).alias("_hk"))
    other = (attach(tot, hs)
                .filter(F.col("_k") > top_n)
                .select(F.lit("Other").alias("category"), (F.col("_tot") - F.col("_hs")).alias("m"),
                        F.lit(top_n + 1).alias("rank")))
    rows = head.select("category", "m", F.col("rank").cast("int")).unionByName(
        other.select("category", "m", F.col("rank").cast("int")))
    share = F.when(F.col("_tot") != 0, rnd(100.0 * F.col("m") / F.col("_tot"), 2)).otherwise(F.lit(0.0))
    out = attach(rows, tot)
    mcol = F.col("m").cast("long") if value_col is None else rnd("m")
    return out.select("category", mcol.alias(metric), share.alias("share_pct"), F.col("rank").cast("long"))


def composition_report(df: DataFrame, cats: Sequence[str], value_col: str | None = None,
                       top_n: int = 15) -> DataFrame:
    """Every categorical column in one pass: (column, metric, category, value,
    share_pct, rank); metric is ``count`` or the value column's name."""
    ids = [value_col] if value_col else []
    long = melt(df, cats, "string", "column", "category", ids=ids)
    long = long.withColumn("category", label("category"))
    aggs = [F.count(F.lit(1)).cast("double").alias("count")]
    if value_col:
        aggs.append(F.sum(_num(value_col)).alias("vsum"))
    g = long.groupBy("column", "category").agg(*aggs)
    parts = [g.select("column", F.lit("count").alias("metric"), "category", F.col("count").alias("m"))]
    if value_col:
        parts.append(g.filter(F.col("vsum").isNotNull())
                      .select("column", F.lit(value_col).alias("metric"), "category", F.col("vsum").alias("m")))
    t = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    ranked = row_numbers(t, ["column", "metric"], [F.col("m").desc(), F.col("category")], "rank")
    tot = ranked.groupBy("column", "metric").agg(F.sum("m").alias("_tot"))
    folded = (ranked.withColumn("category", F.when(F.col("rank") > top_n, F.lit("Other")).otherwise(F.col("category")))
                    .withColumn("rank", F.least(F.col("rank"), F.lit(top_n + 1)))
                    .groupBy("column", "metric", "category", "rank").agg(F.sum("m").alias("m")))
    share = F.when(F.col("_tot") != 0, rnd(100.0 * F.col("m") / F.col("_tot"), 2)).otherwise(F.lit(0.0))
    return folded.join(tot, ["column", "metric"]).select(
        "column", "metric", "category", rnd("m").alias("value"), share.alias("share_pct"),
        F.col("rank").cast("long").alias("rank"))


def composition_insights(df: DataFrame, cats: Sequence[str], top_n: int = 5) -> DataFrame:
    """Top categories (share of all rows, null as a category) of each
    categorical column: (column, category, pct, rank)."""
    cats = list(cats)
    long = melt(df, cats, "string", "column", "category")
    g = long.groupBy("column", label("category").alias("category")).agg(F.count(F.lit(1)).alias("cnt"))
    n = g.groupBy("column").agg(F.sum("cnt").alias("_n"))
    top = top_k(g, ["column"], [F.col("cnt").desc(), F.col("category")], top_n, "rank")
    return top.join(n, "column").select(
        "column", "category", rnd(100.0 * F.col("cnt") / F.col("_n"), 2).alias("pct"),
        F.col("rank").cast("long").alias("rank"))


_AGGS = {
    "mean": lambda v: F.avg(v), "sum": lambda v: F.coalesce(F.sum(v), F.lit(0.0)),
    "min": lambda v: F.min(v), "max": lambda v: F.max(v),
    "count": lambda v: F.count(v).cast("double"), "std": lambda v: F.stddev_samp(v),
}


def group_metric(df: DataFrame, group: str, value: str, agg: str = "mean") -> DataFrame:
    """(group, value) per group for agg in mean|sum|median|min|max|count|std
    (unknown -> mean); null results dropped."""
    agg = agg if agg in (*_AGGS, "median") else "mean"
    sub = df.select(label(group).alias("group"), _num(value).alias("v"))
    if agg == "median":
        long = sub.filter(F.col("v").isNotNull() & ~F.isnan("v"))
        g = exact_quantiles(long, ["group"], "v", [0.5]).select("group", F.col("q").alias("value"))
    else:
        g = sub.groupBy("group").agg(_AGGS[agg](F.col("v")).alias("value"))
    return g.filter(F.col("value").isNotNull() & ~F.isnan("value"))


def compare_groups(df: DataFrame, group: str, value: str, agg: str = "mean", top_n: int = 15) -> DataFrame:
    """Top ``top_n`` groups by the aggregated metric: (group, value, summary, rank).

    summary = 100*value/total, total = sum of all group values for ``sum``, else
    their mean (computed over every group before the cut)."""
    g = group_metric(df, group, value, agg)
    tot = g.agg((F.sum("value") if agg == "sum" else F.avg("value")).alias("_tot"))
    head = g.orderBy(F.col("value").desc(), F.col("group")).limit(top_n)
    head = head.withColumn("rank", F.row_number().over(Window.orderBy(F.col("value").desc(), F.col("group"))))
    summary = F.when(F.col("_tot") != 0, rnd(100.0 * F.col("value") / F.col("_tot"), 2)).otherwise(F.lit(0.0))
    return attach(head, tot).select(
        "group", rnd("value").alias("value"), summary.alias("summary"), F.col("rank").cast("long"))


def comparison_report(df: DataFrame, groups: Sequence[str], values: Sequence[str],
                      top_n: int = 15, top: int = 5, bottom: int = 3) -> DataFrame:
    """Mean of each value column per group of each categorical column, one pass
    with GROUPING SETS: (group_col, value_col, group, value, summary, rank,
    n_groups, is_top, is_bottom); rows limited to the top ``top_n`` plus the true
    bottom ``bottom`` (SURVEY D10)."""
    groups, values = list(groups), list(values)
    # plain names inside, whatever the columns are called
    gs_, vs_ = [f"g{i}" for i in range(len(groups))], [f"v{i}" for i in range(len(values))]
    sub = df.select(*[label(g).alias(k) for k, g in zip(gs_, groups)], *[_num(v).alias(k) for k, v in zip(vs_, values)])
    gs = sub.groupingSets([[g] for g in gs_], *gs_).agg(
        F.grouping_id().alias("_gid"), *[F.avg(v).alias(v) for v in vs_])
    # grouping_id bit i (from the right) is 1 when groups[-1-i] is aggregated away
    n = len(groups)
    gcol = F.lit(None).cast("string")
    gname = F.lit(None).cast("string")
    for i, g in enumerate(groups):
        mask = ((1 << n) - 1) ^ (1 << (n - 1 - i))
        gname = F.when(F.col("_gid") == mask, F.lit(g)).otherwise(gname)
        gcol = F.when(F.col("_gid") == mask, F.col(gs_[i])).otherwise(gcol)
    wide = gs.select(gname.alias("group_col"), gcol.alias("group"), *vs_)
    long = wide.unpivot(["group_col", "group"], vs_, "value_col", "value").filter(
        F.col("value").isNotNull() & ~F.isnan("value"))
    name_of = F.create_map(*[F.lit(x) for pair in zip(vs_, values) for x in pair])
    long = long.withColumn("value_col", name_of[F.col("value_col")])
    keys = ["group_col", "value_col"]
    stats = long.groupBy(*keys).agg(F.avg("value").alias("_tot"), F.count(F.lit(1)).alias("n_groups"))
    ranked = row_numbers(long, keys, [F.col("value").desc(), F.col("group")], "rank").join(stats, keys)
    ranked = ranked.filter((F.col("rank") <= top_n) | (F.col("rank") > F.col("n_groups") - bottom))
    summary = F.when(F.col("_tot") != 0, rnd(100.0 * F.col("value") / F.col("_tot"), 2)).otherwise(F.lit(0.0))
    return ranked.select(
        "group_col", "value_col", "group", rnd("value").alias("value"), summary.alias("summary"),
        F.col("rank").cast("long").alias("rank"), F.col("n_groups").cast("long").alias("n_groups"),
        (F.col("rank") <= top).alias("is_top"), (F.col("rank") > F.col("n_groups") - bottom).alias("is_bottom"))


def comparison_insights(df: DataFrame, groups: Sequence[str], value: str, top_n: int = 5) -> DataFrame:
    """For each categorical column: top ``top_n`` groups by mean of ``value`` and the lowest group:
    (group_col, group, value, rank, kind). A group that is both has a row of either kind."""
    rep = comparison_report(df, groups, [value], top_n=top_n, top=top_n, bottom=1)
    kinds = F.array_compact(F.array(F.when(F.col("is_top"), F.lit("top")), F.when(F.col("is_bottom"), F.lit("bottom"))))
    return rep.select("group_col", "group", "value", "rank", F.explode(kinds).alias("kind"))


def daily_mean(df: DataFrame, ts: str, value: str) -> DataFrame:
    """Daily mean of ``value`` with every day between first and last present
    (empty days have null mean and 0 rows): (day, value, n_records)."""
    day = F.date_trunc("day", named(ts)).cast("timestamp_ntz")
    g = (df.select(day.alias("day"), _num(value).alias("v"))
           .filter(F.col("day").isNotNull())
           .groupBy("day").agg(exact_mean(F.col("v")).alias("value"), F.count("v").alias("n_records")))
    span = g.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    days = span.select(F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("day"))
    return days.join(g, "day", "left").select(
        "day", rnd("value").alias("value"), F.coalesce(F.col("n_records"), F.lit(0)).cast("long").alias("n_records"))
