"""Distinct counts and row identity by 128-bit digests, and mergeable sketches of distinct values.

A digest is two 64-bit hashes taken from different starts over the columns in opposite orders; null is a value of its own. Equal digests
are taken for equal values: among 10^13 different rows two meet with probability 10^-13.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelens.functions.columns import col
from tablelens.functions.stats import materialize

DIGEST = ("_h1", "_h2")


def digest(columns: Sequence[Column]) -> list[Column]:
    """Two hashes of the columns, named as :data:`DIGEST`. Hashing skips nulls, so whether a value is null is hashed too."""
    marked = [x for c in columns for x in (c, c.isNull())]
    return [F.xxhash64(*marked).alias(DIGEST[0]), F.xxhash64(F.lit(len(marked)), *reversed(marked)).alias(DIGEST[1])]


def distinct_counts(df: DataFrame, values: dict[str, Column], exact: bool = True) -> DataFrame:
    """(name, distinct): how many different non-null values each expression takes.

    Exact: one digest per value goes through a map-side combined group-by on (name, digest), then a count per name; no
    row is copied per column. Otherwise one HyperLogLog sketch per expression and task (relative standard deviation 5 %)."""
    names = list(values)
    if not names:
        return df.sparkSession.createDataFrame([], "name string, distinct long")
    if not exact:
        one = df.agg(*[F.approx_count_distinct(v).alias(f"d{i}") for i, v in enumerate(values.values())])
        rows = [F.struct(F.lit(n).alias("name"), F.col(f"d{i}").alias("distinct")) for i, n in enumerate(names)]
        return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    taken = df.select(*[v.alias(f"v{i}") for i, v in enumerate(values.values())])  # each value is made once
    # no higher-order function on the rows: Spark would leave generated code for it
    listed = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"v{i}").isNotNull().alias("has"), *digest([F.col(f"v{i}")])) for i in range(len(names))])
    seen = taken.select(F.explode(listed).alias("s")).where("s.has").groupBy("s.i", *[f"s.{h}" for h in DIGEST]).agg(F.lit(1).alias("one"))
    counts = seen.groupBy("i").agg(F.count("one").alias("distinct"))
    every = df.sparkSession.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, name string")
    return every.join(counts, "i", "left").select("name", F.coalesce("distinct", F.lit(0)).cast("long").alias("distinct"))


def distinct_sketches(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., column, sketch): one HyperLogLog sketch per column (and key), to be stored and merged later."""
    sketches = df.groupBy(*[col(k) for k in keys]).agg(*[F.hll_sketch_agg(col(c).cast("string")).alias(f"s{i}") for i, c in enumerate(cols)])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"s{i}").alias("sketch")) for i, c in enumerate(cols)])
    return sketches.select(*[col(k) for k in keys], F.explode(rows).alias("r")).select(*[col(k) for k in keys], "r.*")


def sketched_counts(sketches: DataFrame) -> DataFrame:
    """(column, distinct) estimated from stored sketches, whatever parts of the data they come from."""
    return sketches.groupBy("column").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct"))


def numbered(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """``df`` written with a row number ``_rid`` and the digest of ``subset`` (all columns by default): the numbers stay
    what they are, however often the table is read."""
    return materialize(df.withColumns(dict(zip(DIGEST, digest([col(c) for c in subset or df.columns])))
                                      | {"_rid": F.monotonically_increasing_id()}))


def first_rows(rows: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """(_rid, n): the first row of every group of equal digests (by ``order``, then row number) and the group's size.

    Partially aggregated, so a group that holds a third of all rows reaches its reducer as one row a task."""
    key = F.struct(*[col(c).alias(f"o{i}") for i, c in enumerate(order)], F.col("_rid"))
    return rows.groupBy(*DIGEST).agg(F.min(key).alias("k"), F.count(F.lit(1)).alias("n")).select("k._rid", "n")
