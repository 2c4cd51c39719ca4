"""Training-data pipeline over `documents`: each stage's rows are written as Parquet and reread by the next.

Quality classifier, toxicity classifier, near-duplicates, mixing to target weights, packing. All stages but the last
return the columns of the documents that stay. Every row is decided on by itself: rows without a doc_id and rows that
share one are documents like any other. An empty table passes through as one.
"""

from __future__ import annotations

import gc
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.llm.common import remainder, stored, table
from tablelens.llm.minhash import near_duplicates
from tablelens.llm.mixing import mix
from tablelens.llm.packing import pack
from tablelens.llm.quality import score_quality
from tablelens.llm.queries import MIX_SEED, MIX_WEIGHTS, mix_levels, tokenizer_path
from tablelens.llm.toxicity import score_toxicity
from tablelens.session import scratch_path

QUALITY, TOXICITY = 0.3, 0.3
SHARE = (4, 5)  # of the tokens that reach the mixing stage


def staying(docs: DataFrame, decided: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose ``key`` is among the ids in ``decided``."""
    return docs.join(decided.select(F.col("doc_id").alias(key)).distinct(), key, "left_semi")


def by_row(docs: DataFrame, decide: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """The rows that ``decide`` (rows, name of their id column) keeps, by (doc_id) of the ids kept.

    Null and repeated ids get numbers of their own first, below all others; the numbered rows are written
    once. Only these ids are looked for in a table whose ids are all different."""
    odd = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("doc_id is null or n > 1")
    if odd.isEmpty():
        return staying(docs, decide(docs, "doc_id"))
    key = next(f"_row{i}" for i in range(len(docs.columns) + 1) if f"_row{i}" not in docs.columns)
    least = docs.agg(F.least(F.lit(0), F.coalesce(F.min("doc_id"), F.lit(0))).cast("long")).first()[0]
    repeated = odd.where("doc_id is not null").select("doc_id", F.lit(True).alias("_odd"))
    own = F.when(F.col("doc_id").isNull() | F.col("_odd"), F.lit(least) - 1 - F.monotonically_increasing_id()).otherwise(F.col("doc_id"))
    rows = stored(docs.join(repeated, "doc_id", "left").select(*docs.columns, own.cast("long").alias(key)), "rows")
    return staying(rows, decide(rows, key), key).select(*docs.columns)


def settled(spark: SparkSession) -> None:
    """Let the driver drop what the stage before has left: models, and the blocks of broadcasts that no plan reads any more."""
    gc.collect()
    spark._jvm.System.gc()


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    settled(spark)
    kept = score_quality(docs, table(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 5) != 0, carry="_quality")
    return kept.where(F.col("_quality") >= QUALITY).select(*docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    settled(spark)
    kept = score_toxicity(docs, table(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 4) != 2, carry="_toxicity")
    return kept.where(F.col("_toxicity") < TOXICITY).select(*docs.columns)


def deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    settled(spark)
    return by_row(docs, lambda rows, key: near_duplicates(rows, id_col=key).where("kept")).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One pass at most, so that no document repeats."""
    settled(spark)
    return by_row(docs, lambda rows, key: mix(rows, mix_levels(), MIX_WEIGHTS, SHARE, 1, MIX_SEED, id_col=key)).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens: one row per piece."""
    settled(spark)
    return pack(docs, tokenizer_path())


STAGES = [("quality classifier", quality), ("toxicity", toxicity), ("MinHash near-dedup", deduplication),
          ("mixing sources", mixture), ("best-fit packing", packing)]

ORACLE_SQL = None  # trained models and byte-pair token ids are not SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name.replace(" ", "-"))
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
