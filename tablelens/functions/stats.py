"""Statistical building blocks.

The central piece is :func:`cumulative`: an exact ``sum(w) over (partition by keys
order by o rows unbounded preceding)`` that never sends one whole partition key
to a single task. Rows are range-partitioned on ``(keys, order)``, each range
partition computes its local running sum, and a small table of per-partition
totals (at most ``#partitions x #keys`` rows) supplies the offsets. Exact
quantiles, top-k per group, average ranks (Spearman) and ECDFs are all built on
it, so a column whose values are all distinct, or a key holding a third of all
rows, is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablelens.functions.columns import col
from tablelens.session import scratch_path


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def num_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def rnd(x, digits: int = 4) -> Column:
    """HALF_UP rounding of a double expression (see SURVEY D1)."""
    return F.round(_c(x).cast("double"), digits)


def melt(df: DataFrame, cols: Sequence[str], cast: str = "double",
         key: str = "column", value: str = "value", ids: Sequence[str] = ()) -> DataFrame:
    """Wide -> long: one row per (row, column) with a common value type.

    ``try_cast`` is used so strings that do not parse become null (pandas
    ``to_numeric(errors="coerce")``)."""
    if not cols:
        raise ValueError("melt needs at least one column")
    projected = df.select(*[col(i) for i in ids], *[col(c).try_cast(cast).alias(c) for c in cols])
    return projected.unpivot([col(i) for i in ids], [col(c) for c in cols], key, value)


# Offsets tables up to this many rows are broadcast; larger ones (very many keys)
# are joined by a shuffle on (partition id, keys), which spreads a hot key.
MAX_BROADCAST_OFFSETS = 2_000_000


def cumulative(df: DataFrame, keys: Sequence[str], order: Sequence, weight=None,
               out: str = "_cum", partitions: int | None = None, total: str | None = None) -> DataFrame:
    """Inclusive running sum of ``weight`` (default 1) per ``keys`` along ``order``.

    Exact and skew-safe: a range exchange on ``(keys, order)`` bounds every task
    by one range partition, no matter how large a key is. ``order`` must be a
    total order within a key for row-number semantics; ties are kept together
    by the range partitioner, so cumulative *counts* over tied values are exact.
    With ``total`` set, the key's grand total is added under that name (from the
    same small offsets table, so callers need no join back to a per-key count).
    """
    keys = list(keys)
    order_cols = [_c(o) for o in order]
    p = partitions or num_partitions(df)
    w = F.lit(1).cast("long") if weight is None else _c(weight)
    ranged = (df.withColumn("_w", w)
                .repartitionByRange(p, *[F.col(k) for k in keys], *order_cols)
                .withColumn("_pid", F.spark_partition_id()))
    # Both uses below must see the same partition ids. Two independent range
    # exchanges would sample their bounds separately, so the ranged table is
    # materialised once in the shared checkpoint folder (also cuts lineage).
    ranged = materialize(ranged)
    local = ranged.withColumn(
        "_lcum",
        F.sum("_w").over(Window.partitionBy("_pid", *keys).orderBy(*order_cols)
                         .rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # partial aggregation: only (#partitions x #keys) rows are exchanged
    totals = ranged.groupBy("_pid", *keys).agg(F.sum("_w").alias("_ptot"))
    offsets = totals.withColumn(
        "_off",
        F.coalesce(F.sum("_ptot").over(Window.partitionBy(*keys).orderBy("_pid")
                                       .rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)))
    if total:
        offsets = offsets.withColumn("_tot", F.sum("_ptot").over(Window.partitionBy(*keys)))
    offsets = offsets.drop("_ptot")
    offsets = offsets.select(*[F.col(c).alias("_o_" + c) for c in ["_pid", *keys]], "_off",
                             *(["_tot"] if total else []))
    # a key's rows are contiguous in range order, so this table has at most
    # #keys + #partitions rows; its size is checked before it is broadcast
    offsets = materialize(offsets)
    if offsets.count() <= MAX_BROADCAST_OFFSETS:
        offsets = F.broadcast(offsets)
    cond = [local[c].eqNullSafe(offsets["_o_" + c]) for c in ["_pid", *keys]]
    res = local.join(offsets, cond, "inner").drop(*["_o_" + c for c in ["_pid", *keys]])
    res = res.withColumn(out, F.col("_off") + F.col("_lcum")).drop("_pid", "_lcum", "_off", "_w")
    return res.withColumnRenamed("_tot", total) if total else res


def row_numbers(df: DataFrame, keys: Sequence[str], order: Sequence, out: str = "rn") -> DataFrame:
    """``row_number() over (partition by keys order by order)`` without a hot task."""
    return cumulative(df, keys, order, None, out)


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence, k: int, out: str = "rank") -> DataFrame:
    """First ``k`` rows per key along ``order`` (exact, bounded tasks).

    Up to Spark's window-group-limit threshold, ``row_number() <= k`` is planned
    with a partial ``WindowGroupLimit`` before the exchange: every map task sends
    at most ``k`` rows per key, so a key holding a third of all rows still
    reaches its reducer as (#map tasks x k) rows. Larger ``k`` uses the
    range-partitioned :func:`row_numbers`."""
    limit = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    order_cols = [_c(o) for o in order]
    if 0 < k <= limit:
        w = Window.partitionBy(*keys).orderBy(*order_cols)
        return df.withColumn(out, F.row_number().over(w).cast("long")).filter(F.col(out) <= k)
    return row_numbers(df, keys, order, out).filter(F.col(out) <= k)


def value_counts(long: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """(keys, value, cnt) for non-null values: map-side combined, bounded."""
    return (long.filter(F.col(value).isNotNull())
                .groupBy(*keys, value).agg(F.count(F.lit(1)).alias("cnt")))


def exact_quantiles(long: DataFrame, keys: Sequence[str], value: str,
                    probs: Sequence[float], vc: DataFrame | None = None) -> DataFrame:
    """Exact linearly-interpolated quantiles per key: (keys..., prob, q).

    Same definition as Spark ``percentile`` / numpy / DuckDB ``quantile_cont``:
    position ``p*(n-1)``, interpolate between the order statistics around it.
    Works on the distinct-value table (map-side combined) and the skew-safe
    :func:`cumulative`. Every ranked value carries its key's total ``n``, so it
    decides by itself whether its span holds a wanted order statistic: no join
    on the key (which would send a whole column to one task), and only the hits
    (at most 2 x #probs per key) reach the final aggregate.
    """
    keys = list(keys)
    vc = vc if vc is not None else value_counts(long, keys, value)
    cum = ranked_values(vc, keys, value, total="_n")
    sides = F.array(*[F.struct(F.lit(float(p)).alias("prob"), F.lit(side).alias("side"))
                      for p in probs for side in (0, 1)])
    pos = F.col("_s.prob") * (F.col("_n") - 1)
    idx = F.when(F.col("_s.side") == 0, F.floor(pos)).otherwise(F.ceil(pos))
    hit = (cum.select(*keys, value, "_start", "_end", "_n", F.explode(sides).alias("_s"))
              .filter((F.col("_start") <= idx) & (idx < F.col("_end")))
              .select(*keys, value, "_n", "_s.*"))
    picked = hit.groupBy(*keys, "prob").agg(
        F.max(F.when(F.col("side") == 0, F.col(value))).alias("_vlo"),
        F.max(F.when(F.col("side") == 1, F.col(value))).alias("_vhi"),
        F.max("_n").alias("_n"))
    p_ = F.col("prob") * (F.col("_n") - 1)
    lo, hi = F.floor(p_), F.ceil(p_)
    q = F.when(lo == hi, F.col("_vlo")).otherwise((hi - p_) * F.col("_vlo") + (p_ - lo) * F.col("_vhi"))
    return picked.select(*keys, "prob", q.alias("q"))


def ranked_values(vc: DataFrame, keys: Sequence[str], value: str, total: str | None = None) -> DataFrame:
    """Distinct values with their 0-based order-statistic span ``[_start, _end)``
    (and the key's total count under ``total`` when asked)."""
    cum = cumulative(vc, keys, [F.col(value)], "cnt", "_end", total=total)
    return cum.withColumn("_start", F.col("_end") - F.col("cnt"))


def quantile_wide(long: DataFrame, keys: Sequence[str], value: str,
                  probs: dict[str, float], vc: DataFrame | None = None) -> DataFrame:
    """:func:`exact_quantiles` pivoted to one column per name in ``probs``."""
    qs = exact_quantiles(long, keys, value, sorted(set(probs.values())), vc)
    aggs = [F.max(F.when(F.col("prob") == float(p), F.col("q"))).alias(name) for name, p in probs.items()]
    return qs.groupBy(*keys).agg(*aggs)


def modes(long: DataFrame, keys: Sequence[str], value: str = "value",
          vc: DataFrame | None = None, out: str = "mode") -> DataFrame:
    """Most frequent value per key, smallest value on ties (pandas ``mode().iloc[0]``).

    A plain aggregate of ``min(struct(-cnt, value))``: partial aggregation keeps
    it bounded whatever the number of distinct values."""
    vc = vc if vc is not None else value_counts(long, keys, value)
    best = F.min(F.struct((-F.col("cnt")).alias("n"), F.col(value).alias("v")))
    return vc.groupBy(*keys).agg(best.alias("_b")).select(*keys, F.col("_b.v").alias(out))


def safe_corr(x, y) -> Column:
    """Pearson correlation over pairwise-complete rows; null (not an error) when a
    side is constant. ``corr`` raises DIVIDE_BY_ZERO under ANSI mode."""
    x, y = _c(x), _c(y)
    xp = F.when(y.isNotNull(), x)
    yp = F.when(x.isNotNull(), y)
    return F.try_divide(F.covar_pop(xp, yp), F.stddev_pop(xp) * F.stddev_pop(yp))


def pop_skewness(x) -> Column:
    return F.skewness(_c(x))


def pop_kurtosis(x) -> Column:
    return F.kurtosis(_c(x))


def attach(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Append the columns of a one-row aggregate to every row of ``df``.

    Broadcast equi-join on a constant key: the build side is a global aggregate,
    so its size (one row) is bounded by construction."""
    return (df.withColumn("_one", F.lit(1))
              .join(F.broadcast(one_row.withColumn("_one", F.lit(1))), "_one")
              .drop("_one"))


def exact_sum(x, over=None) -> Column:
    """Sum that depends little on the order of the rows and keeps tiny, huge and infinite values.

    Values of ordinary size (below 1e20 in magnitude, with no digits beyond the sixth decimal) are summed
    as DECIMAL(38,6), bit for bit the same however the rows are partitioned. What such a value leaves
    over, and all other values (infinities and NaN included), go through an ordinary double sum. ``over``: a window."""
    v = _c(x).cast("double")
    fits = F.abs(v) < 1e20
    fixed = F.when(fits, v).cast("decimal(38,6)")
    rest = F.when(fits, v - fixed.cast("double")).otherwise(v)
    total, left = (F.sum(c) if over is None else F.sum(c).over(over) for c in (fixed, rest))
    return F.coalesce(total.cast("double"), F.lit(0.0)) + left


def exact_mean(x) -> Column:
    """Mean from :func:`exact_sum` (reproducible bit for bit across runs)."""
    return F.try_divide(exact_sum(x), F.count(_c(x)).cast("double"))


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a parquet table in the shared checkpoint folder
    (``spark.checkpoint.dir``) and read it back: later branches reuse it instead
    of rescanning the source, and lineage is cut. A parquet table is columnar and
    compressed, and reads back vectorised, unlike an RDD checkpoint of
    serialised rows; a lost executor just re-reads the shared files."""
    spark = df.sparkSession
    path = scratch_path(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def weighted_moments(vc: DataFrame, keys: Sequence[str], value: str = "value", cnt: str = "cnt") -> DataFrame:
    """Moments per key (a column name) from a (keys, value, cnt) distinct-value table, two-pass:
    n, mean, var_samp, var_pop, std (n-1), std_pop, skewness (population),
    kurtosis (excess, population), min, max. Skewness/kurtosis are null for a
    constant column, the sample variance for a single value."""
    keys = list(keys)
    v, c = F.col(value), F.col(cnt)
    first = vc.groupBy(*keys).agg(F.sum(c).alias("n"), (F.sum(v * c) / F.sum(c)).alias("mean"),
                                  F.min(v).alias("min"), F.max(v).alias("max"))
    d = v - F.col("mean")
    # one mean per key; keys here are column names (bounded by the schema
    # width), so the means are broadcast and the value table is not shuffled
    # on a few keys (which would put a whole column in one task)
    second = vc.join(F.broadcast(first.select(*keys, "mean")), keys).groupBy(*keys).agg(
        F.sum(c * d * d).alias("m2"), F.sum(c * d * d * d).alias("m3"), F.sum(c * d * d * d * d).alias("m4"))
    m = first.join(second, keys)
    n, m2, m3, m4 = F.col("n"), F.col("m2"), F.col("m3"), F.col("m4")
    return m.select(
        *keys, n.cast("long").alias("n"), "mean", "min", "max",
        F.when(n > 1, m2 / (n - 1)).alias("var_samp"), (m2 / n).alias("var_pop"),
        F.when(n > 1, F.sqrt(m2 / (n - 1))).alias("std"), F.sqrt(m2 / n).alias("std_pop"),
        F.when(m2 != 0, F.sqrt(n) * m3 / F.pow(m2, 1.5)).alias("skewness"),
        F.when(m2 != 0, n * m4 / (m2 * m2) - 3).alias("kurtosis"))
