"""K7: the automatic analysis, as result tables that were executed.

A step is a result table. Asking for one runs the steps that it reads and then the step itself, each once: its rows are written to the
shared folder, rows and missing cells are observed during that write, and later steps read the written table. A
step that fails while it is planned or while it runs is recorded with its whole message, and the steps that read it are
recorded as skipped; the others go on (SURVEY D11).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import cached_property, reduce
from threading import RLock

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tablelens.functions.columns import cols as all_columns
from tablelens.functions.stats import materialize
from tablelens.functions.types import categorical_cols, datetime_cols, numeric_cols, text_cols
from tablelens.operators import (
    anomaly, clean, describe, groups, outliers, profile, relate, schema, sentiment, timeseries,
)
from tablelens.plans import charts, planner, report
from tablelens.session import scratch_path

PAIR = ["date_col", "metric"]
STATUS = "position int, step string, tool string, status string, rows long, columns long, missing long, message string"


class NotApplicable(Exception):
    """The table has no columns of the kind that a step needs."""


class Skipped(Exception):
    """A step that this one reads failed or does not apply."""


@dataclass(frozen=True)
class Step:
    name: str
    tool: str
    build: Callable[[Analysis], DataFrame]


STEPS: dict[str, Step] = {}


def step(tool: str, name: str | None = None):
    """Register a function of the analysis as a step, in order, by ``name`` or its own name."""
    def add(build):
        own = name or build.__name__
        STEPS[own] = Step(own, tool, build)
        return build
    return add


class Analysis:
    """The result tables of one frame; ``freq`` is the bucket of its time series."""

    def __init__(self, df: DataFrame, numeric_strategy: str = "median", categorical_strategy: str = "mode",
                 drop_duplicates: bool = True, normalize: bool = True, freq: str = "D"):
        self.df, self.freq = df, freq
        self._cleaning = (numeric_strategy, categorical_strategy, drop_duplicates, normalize)
        self._tables: dict[str, DataFrame] = {}
        self._records: dict[str, tuple] = {}
        self._locks = {name: RLock() for name in STEPS}

    # -- what steps read ---------------------------------------------------------------------------

    @cached_property
    def raw_schema(self) -> DataFrame:
        """The detected columns of the frame, executed once: the step and the types read the same rows."""
        return materialize(schema.detect_schema(self.df))

    @cached_property
    def raw_types(self) -> dict:
        return schema.types_of(self.raw_schema)

    @cached_property
    def cleaned(self) -> clean.CleanResult:
        return clean.clean_dataset(self.df, self.raw_types, *self._cleaning)

    @cached_property
    def clean_schema(self) -> DataFrame:
        """:attr:`raw_schema` of the cleaned frame."""
        return materialize(schema.detect_schema(self.cleaned.df))

    @cached_property
    def types(self) -> dict:
        """Semantic types of the cleaned frame."""
        return schema.types_of(self.clean_schema)

    def _kind(self, names: list[str], what: str, least: int = 1) -> list[str]:
        if len(names) < least:
            raise NotApplicable(f"needs {least} {what} column(s), has {len(names)}")
        return names

    def numbers(self, least: int = 1) -> list[str]:
        return self._kind(numeric_cols(self.types), "numeric", least)

    def categories(self, least: int = 1) -> list[str]:
        return self._kind(categorical_cols(self.types), "categorical", least)

    def dates(self) -> list[str]:
        return self._kind(datetime_cols(self.types), "datetime")

    def texts(self) -> list[str]:
        return self._kind(text_cols(self.types), "text")

    # -- execution -----------------------------------------------------------------------------------

    def table(self, name: str) -> DataFrame:
        """The executed table of a step; raises :class:`Skipped` where it has none."""
        with self._locks[name]:  # steps only wait for steps that they read
            if name not in self._records:
                self._run(STEPS[name])
        if name not in self._tables:
            raise Skipped(f"'{name}' has no table: {self._records[name][-1]}")
        return self._tables[name]

    def if_any(self, name: str) -> DataFrame | None:
        try:
            return self.table(name)
        except Skipped:
            return None

    def _run(self, s: Step) -> None:
        failed = lambda status, message: (s.tool, status, None, None, None, message)
        try:
            self._tables[s.name], rows, missing = self._executed(s.name, s.build(self))
            self._records[s.name] = (s.tool, "ok", rows, len(self._tables[s.name].columns), missing, "")
        except NotApplicable as e:
            self._records[s.name] = failed("not applicable", str(e))
        except Skipped as e:
            self._records[s.name] = failed("skipped", str(e))
        except Exception as e:  # noqa: BLE001 - recorded in full, the other steps go on
            self._records[s.name] = failed("error", f"{type(e).__name__}: {e}")

    def _executed(self, name: str, df: DataFrame) -> tuple[DataFrame, int, int]:
        seen = Observation()
        cells = [c.isNull().cast("long") for c in all_columns(df)]
        path = scratch_path(df.sparkSession, name)
        df.observe(seen, F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(reduce(lambda a, b: a + b, cells)), F.lit(0)).alias("missing")).write.parquet(path)
        got = seen.get
        return df.sparkSession.read.schema(df.schema).parquet(path), got["rows"], got["missing"]

    def run(self, at_once: int = 8) -> dict[str, DataFrame]:
        """Every applicable result table, and ``status``. Up to ``at_once`` steps run side by side: most result tables are
        small, so one step's jobs leave most of the cluster idle."""
        self.side_by_side(STEPS, at_once)
        return self._tables | {"status": self.status()}

    def side_by_side(self, names: Iterable[str], at_once: int = 8) -> dict[str, DataFrame | None]:
        """:meth:`if_any` of each of the steps, up to ``at_once`` at a time."""
        names = list(names)
        if self.if_any("cleaned") is not None and self.if_any("cleaned_schema") is not None:
            _ = self.types  # made before the steps that read them at once
        with ThreadPoolExecutor(at_once) as pool:
            return dict(zip(names, pool.map(self.if_any, names)))

    def status(self) -> DataFrame:
        """(position, step, tool, status, rows, columns, missing, message) of the steps that were asked for so far."""
        rows = [(i + 1, name, *self._records[name]) for i, name in enumerate(STEPS) if name in self._records]
        return self.df.sparkSession.createDataFrame(rows, STATUS)


def auto_eda(df: DataFrame, numeric_strategy: str = "median", categorical_strategy: str = "mode",
             drop_duplicates: bool = True, normalize: bool = True, freq: str = "D") -> dict[str, DataFrame]:
    return Analysis(df, numeric_strategy, categorical_strategy, drop_duplicates, normalize, freq).run()


def _union(parts: Iterator[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


# The steps, in order; their tools are those of the plan.

@step("profile_dataset", "profile")
def profile_table(a: Analysis) -> DataFrame:
    return profile.dataset_profile(a.df)


@step("detect_data_types", "schema")
def schema_table(a: Analysis) -> DataFrame:
    return a.raw_schema


@step("assess_quality")
def quality(a: Analysis) -> DataFrame:
    return profile.assess_quality(a.df, a.raw_types)


@step("clean_dataset")
def cleaned(a: Analysis) -> DataFrame:
    return a.cleaned.df


@step("clean_dataset")
def cleaning_log(a: Analysis) -> DataFrame:
    return a.cleaned.log


@step("clean_dataset")
def clean_summary(a: Analysis) -> DataFrame:
    return a.cleaned.summary()


@step("clean_dataset")
def cleaned_schema(a: Analysis) -> DataFrame:
    a.table("cleaned")  # without it there is nothing to detect
    return a.clean_schema


@step("clean_dataset")
def plan(a: Analysis) -> DataFrame:
    return planner.build_plan(a.table("cleaned_schema"))


@step("clean_dataset")
def chart_rules(a: Analysis) -> DataFrame:
    return charts.four_dimension_charts(a.table("cleaned_schema"))


@step("analyze_missing_data")
def missing(a: Analysis) -> DataFrame:
    return profile.missing_report(a.table("cleaned"))


@step("analyze_missing_data")
def univariate_numeric(a: Analysis) -> DataFrame:
    return describe.describe_numeric(a.table("cleaned"), a.numbers())


@step("analyze_missing_data")
def univariate_categorical(a: Analysis) -> DataFrame:
    return describe.describe_categorical(a.table("cleaned"), a.categories())


@step("analyze_missing_data")
def univariate_text(a: Analysis) -> DataFrame:
    return describe.describe_text(a.table("cleaned"), a.texts())


@step("detect_outliers", "outliers")
def outlier_table(a: Analysis) -> DataFrame:
    return outliers.outlier_report(a.table("cleaned"), a.numbers())


@step("analyze_distribution")
def distribution(a: Analysis) -> DataFrame:
    return describe.distribution_summary(a.table("cleaned"), a.numbers())


@step("analyze_composition")
def composition(a: Analysis) -> DataFrame:
    """Shares by rows, and by the sum of every numeric column."""
    df, cats = a.table("cleaned"), a.categories()
    by_rows = groups.composition_report(df, cats)
    by_sums = (groups.composition_report(df, cats, v).where(F.col("metric") == v) for v in numeric_cols(a.types))
    return _union(iter([by_rows, *by_sums]))


@step("analyze_composition")
def composition_insights(a: Analysis) -> DataFrame:
    return groups.composition_insights(a.table("cleaned"), a.categories())


@step("analyze_comparison")
def comparison(a: Analysis) -> DataFrame:
    return groups.comparison_report(a.table("cleaned"), a.categories(), a.numbers())


@step("analyze_comparison")
def comparison_insights(a: Analysis) -> DataFrame:
    """Top and bottom groups of every categorical column, by the mean of every numeric one."""
    df, cats = a.table("cleaned"), a.categories()
    return _union(groups.comparison_insights(df, cats, v).withColumn("metric", F.lit(v)) for v in a.numbers())


@step("analyze_relationships")
def pearson(a: Analysis) -> DataFrame:
    return relate.correlation_matrix(a.table("cleaned"), a.numbers(2))


@step("analyze_relationships")
def spearman(a: Analysis) -> DataFrame:
    return relate.correlation_matrix(a.table("cleaned"), a.numbers(2), "spearman")


@step("analyze_relationships")
def covariance(a: Analysis) -> DataFrame:
    return relate.covariance_matrix(a.table("cleaned"), a.numbers(2))


@step("analyze_relationships")
def strongest(a: Analysis) -> DataFrame:
    df, numbers = a.table("cleaned"), a.numbers(2)
    return relate.strongest_pairs(relate.correlation_matrix(df, numbers, digits=None), numbers)


@step("analyze_relationships")
def associations(a: Analysis) -> DataFrame:
    return relate.categorical_associations(a.table("cleaned"), a.categories(2))


@step("analyze_time_series")
def time_series(a: Analysis) -> DataFrame:
    """Every pair of a date and a numeric column; the steps below keep the pairs apart."""
    return timeseries.all_series(a.table("cleaned"), a.dates(), a.numbers(), a.freq)


@step("analyze_time_series")
def series_stats(a: Analysis) -> DataFrame:
    return timeseries.ts_stats(a.table("time_series"), PAIR)


@step("analyze_time_series")
def growth(a: Analysis) -> DataFrame:
    return timeseries.growth(a.table("time_series"), PAIR)


@step("analyze_time_series")
def trend(a: Analysis) -> DataFrame:
    return timeseries.trend(a.table("time_series"), PAIR)


@step("analyze_time_series")
def seasonality(a: Analysis) -> DataFrame:
    return timeseries.seasonality(a.table("time_series"), a.freq, PAIR)


@step("analyze_time_series")
def rolling_mean(a: Analysis) -> DataFrame:
    return timeseries.rolling_mean(a.table("time_series"), keys=PAIR)


@step("analyze_time_series")
def decomposition(a: Analysis) -> DataFrame:
    return timeseries.decompose(a.table("time_series"), freq=a.freq, keys=PAIR)


@step("analyze_sentiment", "sentiment")
def sentiment_summary(a: Analysis) -> DataFrame:
    return sentiment.sentiment_summary(a.table("cleaned"), a.texts())


@step("analyze_sentiment")
def sentiment_words(a: Analysis) -> DataFrame:
    return sentiment.sentiment_words(a.table("cleaned"), a.texts())


@step("analyze_sentiment")
def themes(a: Analysis) -> DataFrame:
    return sentiment.themes(a.table("cleaned"), a.texts())


@step("detect_anomalies")
def anomaly_rows(a: Analysis) -> DataFrame:
    """Rows that the isolation forest flags, or the z-score rule where no column varies."""
    return anomaly.anomaly_table(a.table("cleaned"), a.numbers(), "isolation_forest")


@step("detect_anomalies")
def anomaly_notes(a: Analysis) -> DataFrame:
    return anomaly.method_notes(a.table("cleaned"), a.numbers(), "isolation_forest")


@step("detect_anomalies")
def anomalies(a: Analysis) -> DataFrame:
    return anomaly.anomaly_report(a.table("cleaned"), a.numbers(), "iqr")


@step("generate_business_insights")
def findings(a: Analysis) -> DataFrame:
    num = numeric_cols(a.types)
    parts = [
        (report.finding_composition, "composition_insights", ()), (report.finding_distribution, "distribution", num[:1]),
        (report.finding_comparison, "comparison_insights", num[:1]), (report.finding_relationship, "strongest", ()),
        (report.finding_sentiment, "sentiment", ())]
    found = [make(t, *more) for make, name, more in parts if (t := a.if_any(name)) is not None]
    if (g := a.if_any("growth")) is not None and (t := a.if_any("trend")) is not None:
        found.append(report.finding_time(report.first_pair(g, a.dates()[0], num[0]), report.first_pair(t, a.dates()[0], num[0]), num[0]))
    return report.findings(found, a.df.sparkSession)


@step("generate_business_insights")
def insights(a: Analysis) -> DataFrame:
    """Every section of the written report, line by line."""
    return report.insight_lines(a.table("profile"), a.table("quality"), a.table("findings"), a.if_any("trend"), a.if_any("anomalies"),
                                a.if_any("composition_insights"), a.if_any("comparison_insights"))


@step("generate_report")
def report_text(a: Analysis) -> DataFrame:
    return report.markdown(a.table("insights"))


@step("generate_report")
def kpis(a: Analysis) -> DataFrame:
    return report.kpis(a.table("profile"), a.table("quality"), schema.schema_summary(a.table("cleaned_schema")))


@step("generate_report")
def summary_metrics(a: Analysis) -> DataFrame:
    return report.summary_metrics(a.table("profile"), a.table("quality"), schema.schema_summary(a.table("cleaned_schema")),
                                  a.table("cleaning_log"))


@step("generate_report")
def bundle(a: Analysis) -> DataFrame:
    """All result tables but the rows of the frame itself, as one table of JSON rows."""
    names = [n for n in STEPS if n not in ("bundle", "cleaned")]
    return report.report_bundle({n: t for n, t in a.side_by_side(names).items() if t is not None})
