"""Sinks: cleaned data, result tables, summary CSV, retrieval index."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


def sanitize_name(name: str) -> str:
    return re.sub(r"[^A-Za-z0-9_]+", "_", name).strip("_") or "dataset"


def export_cleaned(df: DataFrame, out_dir: str, name: str, fmt: str = "csv") -> str:
    """Cleaned table as csv (header) or parquet under ``out_dir``."""
    path = f"{out_dir.rstrip('/')}/cleaned_{sanitize_name(name)}.{fmt}"
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    else:
        w.parquet(path)
    return path


def export_results(results: dict, out_dir: str) -> dict:
    """One JSON-lines folder per result table."""
    paths = {}
    for key, t in results.items():
        p = f"{out_dir.rstrip('/')}/{sanitize_name(key)}.json"
        t.write.mode("overwrite").json(p)
        paths[key] = p
    return paths


def export_summary(summary: DataFrame, out_dir: str, name: str = "summary") -> str:
    """The (section, metric, value) table as one CSV file."""
    p = f"{out_dir.rstrip('/')}/{sanitize_name(name)}.csv"
    summary.coalesce(1).write.mode("overwrite").option("header", True).csv(p)
    return p


def save_index(index: DataFrame, chunks: DataFrame, idf: DataFrame, out_dir: str) -> str:
    """Persist a retrieval index (vectors, chunks, vocabulary) as parquet."""
    base = out_dir.rstrip("/")
    index.write.mode("overwrite").parquet(f"{base}/vectors")
    chunks.write.mode("overwrite").parquet(f"{base}/chunks")
    idf.write.mode("overwrite").parquet(f"{base}/idf")
    return base


def load_index(spark: SparkSession, base: str):
    return (spark.read.parquet(f"{base}/vectors"), spark.read.parquet(f"{base}/chunks"),
            spark.read.parquet(f"{base}/idf"))


def scratch_dir(spark: SparkSession, prefix: str = "export") -> str:
    """A fresh folder under the shared checkpoint folder (``spark.checkpoint.dir``)."""
    from tablelens.session import scratch_path
    return scratch_path(spark, f"tablelens-{prefix}")
