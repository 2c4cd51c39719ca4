"""Moments and exact quantiles of numeric columns without a table of all values.

A mergeable quantile sketch brackets every wanted order statistic. One scan counts the values below and inside each
bracket, which proves that the statistic lies in it; one more takes the values inside, a few in ten thousand, and
picks it. Nothing but sketches, counts and the brackets' distinct values is shuffled, and nothing is written.
Only one number for each column and quantile reaches the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from tablelens.functions.columns import col

ACCURACY = 10_000  # a sketch is off by at most 1 / ACCURACY of the values
NARROW = 1 << 20  # values inside a bracket from which on it is narrowed by another sketch


def number(name: str) -> Column:
    """A column's value as a double; null where it does not parse and for NaN."""
    x = col(name).try_cast("double")
    return F.when(~F.isnan(x), x)


@dataclass
class _Wanted:
    """An order statistic pair (floor and ceiling of a position) of column ``at``, and a bracket around it."""

    at: int
    prob: float
    below_n: int  # the place of the floor among the column's values, from 0
    above_n: int
    lo: float
    hi: float
    below: int = 0  # values smaller than the bracket
    inside: int = 0


def _values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*[number(c).alias(f"x{i}") for i, c in enumerate(cols)])


def _within(w: _Wanted) -> Column:
    x = F.col(f"x{w.at}")
    return (x >= F.lit(w.lo)) & (x <= F.lit(w.hi))


def _sketched(x: Column, places: Sequence[float]) -> Column:
    return F.percentile_approx(x, [min(1.0, max(0.0, p)) for p in places], ACCURACY)


def _around(position: float, n: int) -> tuple[float, float]:
    p, slack = position / max(n - 1, 1), 2 / ACCURACY + 2 / max(n, 1)
    return p - slack, p + slack


def _counted(x: DataFrame, wanted: Sequence[_Wanted], more: Sequence[Column] = ()) -> Row:
    """Count the values below and inside each bracket; what ``more`` aggregates comes from the same scan."""
    row = x.agg(*more, *[f for k, w in enumerate(wanted) for f in (
        F.count_if(F.col(f"x{w.at}") < F.lit(w.lo)).alias(f"b{k}"), F.count_if(_within(w)).alias(f"i{k}"))]).first()
    for k, w in enumerate(wanted):
        w.below, w.inside = row[f"b{k}"], row[f"i{k}"]
    return row


def _narrowed(x: DataFrame, wanted: list[_Wanted]) -> None:
    """Sketch the inside of wide brackets until they are narrow or no longer shrink (few distinct values)."""
    wide = [w for w in wanted if w.inside > NARROW and w.lo < w.hi]
    while wide:
        places = [(w.below_n - w.below, w.above_n - w.below, w.inside) for w in wide]
        row = x.agg(*[_sketched(F.when(_within(w), F.col(f"x{w.at}")), [_around(a, n)[0], _around(b, n)[1]]).alias(f"q{k}")
                      for k, (w, (a, b, n)) in enumerate(zip(wide, places))]).first()
        before = [(w.lo, w.hi, w.below, w.inside) for w in wide]
        for k, w in enumerate(wide):
            w.lo, w.hi = row[f"q{k}"]
        _counted(x, wide)
        again = []
        for w, old in zip(wide, before):
            if not (w.below <= w.below_n and w.above_n < w.below + w.inside):
                w.lo, w.hi, w.below, w.inside = old
            elif w.inside > NARROW and w.lo < w.hi and w.inside < old[3] / 2:
                again.append(w)
        wide = again


def _picked(x: DataFrame, wanted: Sequence[_Wanted]) -> dict[int, tuple[float, float]]:
    """The floor and ceiling statistic of each bracket."""
    out = {k: (w.lo, w.lo) for k, w in enumerate(wanted) if w.lo == w.hi}
    open_ = [k for k in range(len(wanted)) if k not in out]
    if not open_:
        return out
    inside = F.array(*[F.struct(F.lit(k).alias("k"), F.when(_within(wanted[k]), F.col(f"x{wanted[k].at}")).alias("v")) for k in open_])
    # few rows have a value inside, and only theirs are listed
    some = x.where(reduce(lambda a, b: a | b, [_within(wanted[k]) for k in open_]))
    counts = some.select(F.explode(inside).alias("s")).where("s.v IS NOT NULL").groupBy("s.k", "s.v").agg(F.count(F.lit(1)).alias("n"))
    # a bracket's distinct values: at most NARROW, or few that repeat
    end = F.sum("n").over(Window.partitionBy("k").orderBy("v"))
    number_of = lambda f: F.element_at(F.create_map(*[F.lit(z) for k in open_ for z in (k, f(wanted[k]) - wanted[k].below)]), F.col("k"))
    spans = counts.withColumn("end", end).withColumn("start", F.col("end") - F.col("n"))
    holds = lambda f: (F.col("start") <= number_of(f)) & (number_of(f) < F.col("end"))
    low, high = holds(lambda w: w.below_n), holds(lambda w: w.above_n)
    for r in spans.groupBy("k").agg(F.max(F.when(low, F.col("v"))).alias("lo"), F.max(F.when(high, F.col("v"))).alias("hi")).collect():
        out[r.k] = (r.lo, r.hi)
    return out


def column_numbers(df: DataFrame, cols: Sequence[str], probs: dict[str, float] | None = None, shape: bool = False) -> dict[str, dict[str, float]]:
    """For each column with a number: n, mean, min, max and the named quantiles (linear interpolation at p * (n - 1)),
    on the driver; with ``shape`` also m2, m3 and m4, the sums of powers of the distances from the mean. One scan; a second
    one with quantiles or shape, a third one with quantiles, and two for every round of narrowing.

    Values that do not parse, nulls and NaN are left out; the source must give the same rows on every scan."""
    cols, probs = list(cols), dict(probs or {})
    x = _values(df, cols)
    aggs = []
    for i in range(len(cols)):
        v = F.col(f"x{i}")
        aggs += [F.count(v).alias(f"n{i}"), F.avg(v).alias(f"m{i}"), F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}")]
        if probs:
            slack = 3 / ACCURACY
            aggs.append(_sketched(v, [p + d for p in probs.values() for d in (-slack, slack)]).alias(f"q{i}"))
    row = x.agg(*aggs).first() if cols else None
    out = {c: {"n": row[f"n{i}"], "mean": row[f"m{i}"], "min": row[f"lo{i}"], "max": row[f"hi{i}"]} for i, c in enumerate(cols) if row[f"n{i}"]}
    wanted = []
    for i, c in enumerate(cols):
        for j, p in enumerate(probs.values()) if c in out else ():
            n = out[c]["n"]
            wanted.append(_Wanted(i, p, math.floor(p * (n - 1)), math.ceil(p * (n - 1)), row[f"q{i}"][2 * j], row[f"q{i}"][2 * j + 1]))
    powers = [m for i, c in enumerate(cols) if shape and c in out for m in _powers(F.col(f"x{i}"), out[c]["mean"], i)]
    if not wanted and not powers:
        return out
    row = _counted(x, wanted, powers)
    for i, c in enumerate(cols):
        if shape and c in out:
            out[c] |= {m: row[f"{m}_{i}"] for m in ("m2", "m3", "m4")}
    for w in wanted:
        if not (w.below <= w.below_n and w.above_n < w.below + w.inside):  # a sketch of few values may sit one place off
            w.lo, w.hi, w.below, w.inside = out[cols[w.at]]["min"], out[cols[w.at]]["max"], 0, out[cols[w.at]]["n"]
    _narrowed(x, wanted)
    picked = _picked(x, wanted)
    names = list(probs)
    for k, w in enumerate(wanted):
        own = out[cols[w.at]]
        lo, hi = picked[k]
        position = w.prob * (own["n"] - 1)
        own[names[k % len(names)]] = lo if w.below_n == w.above_n else (w.above_n - position) * lo + (position - w.below_n) * hi
    return out


def _powers(x: Column, mean: float, i: int) -> list[Column]:
    d = x - F.lit(mean)
    return [F.sum(d * d).alias(f"m2_{i}"), F.sum(d * d * d).alias(f"m3_{i}"), F.sum(d * d * d * d).alias(f"m4_{i}")]


TABLE = ("mean", "min", "max", "var_samp", "var_pop", "std", "std_pop", "skewness", "kurtosis")


def _shape(own: dict) -> dict[str, float | None]:
    """Variance, deviation, skewness and excess kurtosis from a column's sums of powers."""
    n, m2, m3, m4 = own["n"], own["m2"], own["m3"], own["m4"]
    sample = m2 / (n - 1) if n > 1 else None
    varies = m2 != 0 and m2 == m2 and abs(m2) != math.inf
    undefined = None if m2 == 0 else math.nan
    return {"var_samp": sample, "var_pop": m2 / n, "std": None if sample is None else math.sqrt(sample), "std_pop": math.sqrt(m2 / n),
            "skewness": math.sqrt(n) * m3 / m2 ** 1.5 if varies and m2 ** 1.5 else undefined,
            "kurtosis": n * m4 / (m2 * m2) - 3 if varies and m2 * m2 else undefined}


def column_table(df: DataFrame, cols: Sequence[str], probs: dict[str, float] | None = None,
                 more: Callable[[Column, dict], dict[str, Column]] | None = None) -> DataFrame:
    """One row per column with a number: n, mean, min, max, var_samp, var_pop, std (n-1), std_pop, skewness (population), kurtosis (excess,
    population), the named quantiles, and what ``more`` (value, the column's numbers) counts in one more scan.
    Skewness and kurtosis are null for a constant column, the sample variance for a single value."""
    numbers = column_numbers(df, cols, probs, shape=True)
    names = [*TABLE, *(probs or {})]
    rows = []
    for c, own in numbers.items():
        own |= _shape(own)
        rows.append((c, int(own["n"]), *[None if own[k] is None else float(own[k]) for k in names]))
    table = df.sparkSession.createDataFrame(rows, ", ".join(["column string", "n long", *[f"{k} double" for k in names]]))
    if not more:
        return table
    x, aggs, structs, extra = _values(df, list(cols)), [], [], list(more(F.lit(0.0), dict.fromkeys(["n", *names], 0.0)))
    for i, c in enumerate(cols):
        if c in numbers:
            aggs += [e.alias(f"{name}_{i}") for name, e in more(F.col(f"x{i}"), numbers[c]).items()]
            structs.append(F.struct(F.lit(c).alias("column"), *[F.col(f"{name}_{i}").cast("long").alias(name) for name in extra]))
    if not structs:
        return table.select("*", *[F.lit(0).cast("long").alias(name) for name in extra])
    return table.join(x.agg(*aggs).select(F.explode(F.array(*structs)).alias("r")).select("r.*"), "column")
