"""KPI cards, summary metrics, rule-based findings and markdown sections (K2-K6).

Every table here is built from one-row (or few-row) result tables with
``format_string``; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelens.functions.columns import cols
from tablelens.functions.stats import attach

PAD = "No further finding; the result tables hold the details."
SECTION_ORDER = ["composition", "distribution", "comparison", "time", "relationship", "sentiment"]


def _int(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _num(c) -> Column:
    """A double as text the way Python prints it: plain decimals (no ``1.0E-4``)
    between 1e-4 and 1e16, and at least one digit after the point."""
    x = F.col(c) if isinstance(c, str) else c
    plain = F.regexp_replace(x.cast("decimal(38,10)").cast("string"), r"(\.\d*?)0+$", "$1")
    plain = F.regexp_replace(plain, r"\.$", ".0")
    return (F.when(x.isNull(), F.lit(None).cast("string"))
            .when((F.abs(x) >= 1e16) | ((F.abs(x) < 1e-4) & (x != 0)), x.cast("string"))
            .otherwise(plain))


def _rows(names, values) -> Column:
    """Array of structs with the same field names (one struct per tuple)."""
    return F.array(*[F.struct(*[v.alias(n) for n, v in zip(names, t)]) for t in values])


def kpis(profile: DataFrame, quality: DataFrame, schema_summary: DataFrame) -> DataFrame:
    """K2: eight (label, value) cards."""
    s = schema_summary.groupBy().pivot("metric", ["numeric", "categorical", "datetime"]).agg(F.first("value"))
    r = attach(attach(profile, quality.select("score", "grade")), s)
    cards = _rows(["pos", "label", "value"], [
        (F.lit(1), F.lit("Records"), F.format_number("rows", 0)),
        (F.lit(2), F.lit("Columns"), _int("columns")),
        (F.lit(3), F.lit("Data Quality"), F.concat(_num("score"), F.lit(" (Grade "), F.col("grade"), F.lit(")"))),
        (F.lit(4), F.lit("Missing"), F.concat(_num("missing_total_pct"), F.lit("%"))),
        (F.lit(5), F.lit("Duplicates"), F.format_number("duplicates", 0)),
        (F.lit(6), F.lit("Numeric"), F.coalesce(_int("numeric"), F.lit("0"))),
        (F.lit(7), F.lit("Categorical"), F.coalesce(_int("categorical"), F.lit("0"))),
        (F.lit(8), F.lit("Date cols"), F.coalesce(_int("datetime"), F.lit("0")))])
    return r.select(F.explode(cards).alias("c")).select(F.col("c.pos").cast("long").alias("pos"), "c.label", "c.value")


def summary_metrics(profile: DataFrame, quality: DataFrame, schema_summary: DataFrame,
                    cleaning_log: DataFrame | None = None) -> DataFrame:
    """Flat (section, metric, value) table."""
    names = ["section", "metric", "value"]
    p = profile.select(F.explode(_rows(names, [
        (F.lit("dataset"), F.lit("records"), _int("rows")),
        (F.lit("dataset"), F.lit("columns"), _int("columns")),
        (F.lit("dataset"), F.lit("missing_pct"), _num("missing_total_pct")),
        (F.lit("dataset"), F.lit("duplicate_rows"), _int("duplicates"))])).alias("r")).select("r.*")
    q = quality.select(F.explode(_rows(names, [
        (F.lit("quality"), F.lit("score"), _num("score")),
        (F.lit("quality"), F.lit("grade"), F.col("grade"))])).alias("r")).select("r.*")
    s = schema_summary.filter(F.col("metric").startswith("type:")).select(
        F.lit("schema").alias("section"), F.substring("metric", 6, 1000).alias("metric"), _int("value").alias("value"))
    out = p.unionByName(q).unionByName(s)
    if cleaning_log is not None:
        out = out.unionByName(cleaning_log.select(
            F.lit("cleaning").alias("section"), F.col("operation").alias("metric"),
            F.concat(_int("rows_affected"), F.lit(" rows - "), F.col("reason")).alias("value")))
    return out


def first_pair(t: DataFrame, date_col: str, metric: str) -> DataFrame:
    """The row of one (date column, metric) pair."""
    return t.filter((F.col("date_col") == date_col) & (F.col("metric") == metric))


def _sentence(section: str, rows: DataFrame, text: Column) -> DataFrame:
    return rows.select(F.lit(section).alias("section"), text.alias("text"))


def finding_composition(insights: DataFrame) -> DataFrame:
    """From composition insights: the largest category of the first column."""
    first = insights.filter(F.col("rank") == 1).orderBy("column").limit(1)
    return _sentence("composition", first, F.format_string("%s: most rows (%s%%) are '%s'.", "column", _num("pct"), "category"))


def finding_distribution(dist: DataFrame, first_col: str) -> DataFrame:
    """Shape of one numeric column."""
    d = dist.filter(F.col("column") == first_col)
    return _sentence("distribution", d, F.format_string(
        "%s: %s, skewness %s, standard deviation %s, %s%% beyond the fences.", "column", "shape", _num("skewness"), _num("std"), _num("outlier_pct")))


def finding_comparison(ins: DataFrame, metric: str) -> DataFrame:
    """The group with the largest mean of ``metric``, of the first categorical column."""
    own = ins.filter(F.col("metric") == metric) if "metric" in ins.columns else ins
    top = own.filter((F.col("rank") == 1) & (F.col("kind") == "top")).orderBy("group_col").limit(1)
    return _sentence("comparison", top, F.format_string(
        "%s: '%s' leads by mean %s (%s).", "group_col", "group", F.lit(metric), _num("value")))


def finding_time(growth: DataFrame, trend: DataFrame, value_col: str) -> DataFrame:
    """Change of one series from its first to its last bucket."""
    g = attach(growth, trend.select("direction")).filter(F.col("overall_growth_pct").isNotNull())
    return _sentence("time", g, F.format_string(
        "%s: %s%% from the first to the last period, trend %s.", F.lit(value_col), _num("overall_growth_pct"), "direction"))


def finding_relationship(strongest: DataFrame) -> DataFrame:
    s = strongest.filter(F.col("rank") == 1)
    return _sentence("relationship", s, F.format_string("%s and %s move together most (correlation %s).", "a", "b", _num("corr")))


def finding_sentiment(summary: DataFrame) -> DataFrame:
    s = summary.orderBy("column").limit(1)
    return _sentence("sentiment", s, F.format_string("%s: %s%% positive and %s%% negative texts, mean valence %s.", "column",
                                                     _num("positive_pct"), _num("negative_pct"), _num("avg_compound")))


def findings(parts: list[DataFrame], spark) -> DataFrame:
    """K3: up to five findings in section order, padded: (rank, section, text)."""
    order = F.create_map(*[x for i, s in enumerate(SECTION_ORDER) for x in (F.lit(s), F.lit(i))])
    pad = spark.range(5).select(F.lit("padding").alias("section"), F.lit(PAD).alias("text"),
                                (F.lit(100) + F.col("id")).alias("_o"))
    u = pad
    for p in parts:
        u = u.unionByName(p.select("section", "text", order[F.col("section")].cast("long").alias("_o")))
    from pyspark.sql import Window
    w = Window.orderBy("_o")  # at most 11 rows
    return u.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= 5).select(
        "rank", "section", "text")


# The sections of the written report, in order.
SECTIONS = ["Executive Summary", "Top 5 Findings", "Data Quality", "Trends", "Risks", "Opportunities", "Recommendations",
            "Further Questions"]
LINES = {
    "Opportunities": ["Split the tables by further categories to find groups that do well."],
    "Recommendations": ["Look first at the group that leads the comparison.", "Mend what the data quality section lists before modelling.",
                        "Have trends and correlations confirmed by someone who knows the data."],
    "Further Questions": ["Why does the leading group lead?", "Which of the unusual rows are events, and which are errors?",
                          "Do the findings hold for newer data?"],
}
NOTHING = {"Data Quality": "Nothing stands out.", "Trends": "The table has no series to follow.", "Risks": "The checks found no risk."}


def _lines(section: str, rows: DataFrame, text: Column, rank=None, group: int = 0) -> DataFrame:
    """(section number, group, order, text) of one or more lines of a section."""
    return rows.select(F.lit(SECTIONS.index(section)).alias("s"), F.lit(group).alias("g"), (F.lit(0) if rank is None else rank).cast("string").alias("o"),
                       text.alias("text")).filter(F.col("text").isNotNull())


def insight_lines(profile: DataFrame, quality: DataFrame, found: DataFrame, trend: DataFrame | None = None, anomalies: DataFrame | None = None,
                  composition: DataFrame | None = None, comparison: DataFrame | None = None) -> DataFrame:
    """K3: (position, section, text): every line of the eight sections, from executed result tables. A section
    without a line of its own says so."""
    spark = profile.sparkSession
    issue = quality.select(F.posexplode(F.split("issues", "; ")).alias("i", "issue")).filter(F.col("issue") != "")
    parts = [
        _lines("Executive Summary", attach(profile, quality.select("score", "grade")), F.format_string(
            "%s rows in %s columns, data quality %s of 100 (grade %s).", _int("rows"), _int("columns"), _num("score"), "grade")),
        _lines("Top 5 Findings", found, F.concat(_int("rank"), F.lit(". "), F.col("text")), F.col("rank")),
        _lines("Data Quality", issue, F.col("issue"), F.col("i")),
        _lines("Risks", issue.filter(F.col("issue").startswith("missing")), F.format_string("Results may be biased (%s).", "issue")),
    ]
    if trend is not None:
        parts.append(_lines("Trends", trend, F.format_string("%s by %s: %s, r2 %s.", "metric", "date_col", "direction", F.coalesce(_num("r2"), F.lit("unknown"))),
                            F.concat_ws(" ", "date_col", "metric")))
    if anomalies is not None:
        rows = anomalies.filter((F.col("column") == "ALL_ROWS") & (F.col("anomaly_count") > 0))
        parts.append(_lines("Risks", rows, F.format_string("%s unusual rows (%s%%): events or errors.", _int("anomaly_count"), _num("anomaly_pct")), group=1))
    if composition is not None:
        first = composition.filter(F.col("rank") == 1)
        parts.append(_lines("Opportunities", first, F.format_string("%s is concentrated in '%s' (%s%%).", "column", "category", _num("pct")), F.col("column")))
    if comparison is not None:
        top = comparison.filter((F.col("rank") == 1) & (F.col("kind") == "top"))
        parts.append(_lines("Opportunities", top, F.format_string("%s '%s' has the highest mean %s (%s).", "group_col", "group", "metric", _num("value")),
                            F.concat_ws(" ", "group_col", "metric"), 1))
    fixed = [(SECTIONS.index(k), 8, str(i), t) for k, ts in LINES.items() for i, t in enumerate(ts)]
    fixed += [(SECTIONS.index(k), 9, "", t) for k, t in NOTHING.items()]
    lines = spark.createDataFrame(fixed, "s int, g int, o string, text string")
    for p in parts:
        lines = lines.unionByName(p)
    from pyspark.sql import Window
    # one line for each column or pair of columns of the frame
    others = F.count_if(F.col("g") < 9).over(Window.partitionBy("s"))
    kept = lines.withColumn("n", others).filter((F.col("g") < 9) | (F.col("n") == 0))
    names = F.array(*[F.lit(x) for x in SECTIONS])
    return kept.select(F.row_number().over(Window.orderBy("s", "g", "o", "text")).cast("long").alias("position"), names[F.col("s")].alias("section"), "text")


def markdown(lines: DataFrame) -> DataFrame:
    """K6: (doc, text): the lines of :func:`insight_lines` as one document with a heading for each section."""
    by_section = lines.groupBy("section").agg(
        F.min("position").alias("p"), F.transform(F.sort_array(F.collect_list(F.struct("position", "text"))), lambda x: x["text"]).alias("l"))
    bullet = F.when(F.col("section").isin("Executive Summary", "Top 5 Findings"), F.lit("")).otherwise(F.lit("- "))
    body = by_section.select("p", F.concat(F.lit("## "), F.col("section"), F.lit("\n"),
                                           F.array_join(F.transform("l", lambda x: F.concat(bullet, x)), "\n"), F.lit("\n")).alias("t"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p", "t"))), lambda x: x["t"]), "\n")
    return body.agg(F.lit("report").alias("doc"), text.alias("text"))


def parse_sections(df: DataFrame, doc_col: str, text_col: str) -> DataFrame:
    """K5: markdown -> (doc, section, body) on lines starting with '## '; lines
    before the first heading are dropped; body keeps one newline per line."""
    parts = df.select(F.col(doc_col).alias("doc"),
                      F.posexplode(F.split(F.col(text_col), r"(?m)^## ", -1)).alias("i", "part"))
    parts = parts.filter(F.col("i") > 0)
    lines = F.split(F.col("part"), "\n", -1)
    body_lines = F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))
    body_lines = F.when(F.element_at(body_lines, -1) == "", F.slice(body_lines, 1, F.size(body_lines) - 1)) \
                  .otherwise(body_lines)
    return parts.select("doc", F.col("i").cast("long").alias("pos"), F.trim(lines[0]).alias("section"),
                        F.array_join(F.transform(body_lines, lambda x: F.concat(x, F.lit("\n"))), "").alias("body"))


def report_bundle(results: dict) -> DataFrame:
    """K6: all result tables in one: (name, json), one JSON object per result row. Nothing is folded, so a
    table of any size stays distributed."""
    parts = [t.select(F.lit(name).alias("name"), F.to_json(F.struct(*cols(t))).alias("json")) for name, t in results.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
