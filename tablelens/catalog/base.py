"""Registry of named queries over the test tables and their DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name`` (with oracle SQL)."""
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


# Tables whose rows carry long texts: tokenising, sentence splitting and lexicon
# scoring are per-row CPU work, so an under-partitioned scan of them is spread.
TEXT_TABLES = ("documents", "pages", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name in TEXT_TABLES:
        from tablelens.sources.readers import spread
        return spread(df)
    return df


def sql_melt(table_name: str, cols, cast: str = "DOUBLE", where: str | None = None) -> str:
    """UNION ALL of one select per column: ("column", value)."""
    w = f" WHERE {where}" if where else ""
    return "\n  UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", TRY_CAST({c} AS {cast}) AS value FROM {table_name}{w}" for c in cols)


def sround(expr: str, digits: int = 4) -> str:
    """Spark's ``round`` on a double: HALF_UP on its shortest decimal form.
    DuckDB's ``round`` works on the binary value; this makes exact ties agree."""
    return f"CAST(round(CAST(CAST({expr} AS VARCHAR) AS DECIMAL(38,20)), {digits}) AS DOUBLE)"


def qcont(sorted_list: str, n: str, p: float) -> str:
    """Linear-interpolated quantile of a sorted DuckDB list: position p*(n-1),
    ``(hi - pos) * x[lo] + (pos - lo) * x[hi]`` (Spark ``percentile``'s form)."""
    pos = f"(({n} - 1) * {p})"
    lo, hi = f"floor({pos})", f"ceil({pos})"
    return (f"(CASE WHEN {lo} = {hi} THEN {sorted_list}[CAST({lo} AS BIGINT) + 1] "
            f"ELSE ({hi} - {pos}) * {sorted_list}[CAST({lo} AS BIGINT) + 1] "
            f"+ ({pos} - {lo}) * {sorted_list}[CAST({hi} AS BIGINT) + 1] END)")


def digest_sql(cols, seed: int | None = None) -> str:
    """md5 of a row's text as ``sources.sampling.row_digest`` makes it (doubles between 1e-3 and 1e7 print alike in both engines)."""
    texts = " || ".join(f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), 'n')" for c in cols)
    return f"md5({'' if seed is None else chr(39) + str(seed) + '|' + chr(39) + ' || '}{texts})"
