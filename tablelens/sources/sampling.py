"""Row samples and order-insensitive dataset fingerprints.

Samples are chosen by the md5 digest of a row's text, so they do not depend on how the rows are
partitioned, can be repeated by any engine, and need no ranking of the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelens.functions.columns import col, cols
from tablelens.functions.stats import attach, materialize

# The sampling fractions offered for large inputs.
SAMPLE_FRACTIONS = (1.0, 0.5, 0.25, 0.1)

DIGEST = 32  # hexadecimal digits of an md5
STEP = 3  # digits counted at a time: at most 4,096 counts reach the driver


def row_text(columns: Sequence[Column]) -> Column:
    """One text for the columns' values: each as ``length:text``, a null as ``n``. Different values never give one text."""
    texts = [c.cast("string") for c in columns]
    return F.concat(*[F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("n")) for t in texts])


def row_digest(columns: Sequence[Column], seed: int | None = None) -> Column:
    """md5 of :func:`row_text`, after ``seed|`` where a seed is given."""
    text = row_text(columns)
    return F.md5((text if seed is None else F.concat(F.lit(f"{seed}|"), text)).cast("binary"))


def _free(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name = "_" + name
    return name


def _last_digest(digests: DataFrame, n: int) -> tuple[str, int, int] | None:
    """(digest, taken, copies): the ``n`` smallest rows are all rows below the digest and ``taken`` of its ``copies``;
    None where there are no more than ``n`` rows.

    Rows are counted by their leading digits, and only the rows of the group that holds the boundary are
    written and counted by further digits (by all of them, once they are no more than one step counts)."""
    prefix, left, size = "", n, None
    while True:
        depth = min(len(prefix) + STEP, DIGEST)
        if size is not None and size <= 16 ** STEP:
            depth = DIGEST
        groups = digests.groupBy(F.substring("d", 1, depth).alias("p")).agg(F.count(F.lit(1)).alias("c")).orderBy("p").collect()
        for p, size in groups:
            if left <= size:
                prefix = p
                break
            left -= size
        else:
            return None
        if depth == DIGEST:
            return prefix, left, size
        digests = materialize(digests.where(F.col("d").startswith(prefix)))


def sample_rows(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """The ``n`` rows of smallest digest (all rows, if fewer). Of equal rows at the boundary as many copies are
    returned as belong to the sample; they are the same row, so none is preferred. ``n`` <= 0 gives no rows."""
    if n <= 0:
        return df.limit(0)
    own = _free(df, "_digest")
    h = df.withColumn(own, row_digest(cols(df), seed))
    last = _last_digest(h.select(F.col(own).alias("d")), n)
    if last is None:
        return df
    digest, taken, copies = last
    if taken == copies:
        return h.where(F.col(own) <= digest).select(*cols(df))
    below = h.where(F.col(own) < digest).select(*cols(df))
    one = h.where(F.col(own) == digest).limit(1).select(*cols(df))
    return below.unionByName(attach(df.sparkSession.range(taken).select(), one).select(*cols(df)))


def sample_exact(df: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """The round(fraction * n) rows of smallest digest; the fraction is clamped to [0, 1], and 1 returns the input."""
    f = max(0.0, min(1.0, float(fraction)))
    return df if f >= 1.0 else sample_rows(df, int(round(f * df.count())), seed)


def sample_fraction(df: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """Bernoulli sample; fraction clamped to [0, 1], 1 returns the input."""
    f = max(0.0, min(1.0, float(fraction)))
    return df if f >= 1.0 else df.sample(False, f, seed)


def sample_by_key(df: DataFrame, keys: Sequence[str], fraction: float, seed: int = 42) -> DataFrame:
    """S4 by key: all rows of the keys whose digest lies in the lowest ``fraction`` of the digests. Tables that share a key are
    sampled alike, so that their samples still join. No shuffle; null keys are a key like any other."""
    f = max(0.0, min(1.0, float(fraction)))
    part = F.conv(F.substring(row_digest([col(k) for k in keys], seed), 1, 13), 16, 10).cast("long")
    return df if f >= 1.0 else df.where(part < F.lit(int(f * 16 ** 13)))


def fingerprint(df: DataFrame) -> DataFrame:
    """(rows, xor_hash, sum_hash): independent of row order and partitioning. The digits 16 to 30 of the rows' md5
    are combined by xor, the first 15 by an exact sum, which also tells apart equal rows (pairs of them cancel in xor)."""
    own = _free(df, "_digest")
    h = df.withColumn(own, row_digest(cols(df)))
    number = lambda at: F.conv(F.substring(col(own), at, 15), 16, 10).cast("long")
    return h.agg(F.count(F.lit(1)).cast("long").alias("rows"), F.bit_xor(number(16)).alias("xor_hash"),
                 F.sum(number(1).cast("decimal(38,0)")).cast("string").alias("sum_hash"))
