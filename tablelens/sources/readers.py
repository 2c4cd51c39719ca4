"""Table and document readers with the load-time validation."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.sources.quoted_csv import CORRUPT, read_quoted_csv

# Accepted file types and the delimiter per type.
ALLOWED_EXTENSIONS = (".csv", ".tsv", ".parquet")
DELIMITERS = {".csv": ",", ".tsv": "\t"}
BOM = "﻿"


class UnsupportedFile(ValueError):
    pass


def validate_extension(path: str) -> str:
    """Lower-cased extension of ``path``; other types (.txt, .xlsx, ...) are refused."""
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    if ext not in ALLOWED_EXTENSIONS:
        raise UnsupportedFile(f"unsupported file type '{ext or path}'; expected one of {ALLOWED_EXTENSIONS}")
    return ext


def detect_encoding(spark: SparkSession, path: str) -> str:
    """``UTF-8`` unless some line is not valid UTF-8, then ``ISO-8859-1``.
    Distributed; the existence check stops at the first bad line."""
    bad = spark.read.text(path).filter(~F.is_valid_utf8("value")).limit(1).count()
    return "ISO-8859-1" if bad else "UTF-8"


def spread(df: DataFrame) -> DataFrame:
    """Round-robin the rows over the cluster's default parallelism when the scan
    has fewer partitions than that (e.g. one file with one row group, which
    Spark reads in a single task). A large input already scans in many tasks
    and is returned unchanged, so no shuffle is added at scale."""
    target = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < target:
        return df.repartition(target)
    return df


def clean_names(df: DataFrame) -> DataFrame:
    """Strip surrounding whitespace (and a UTF-8 byte-order mark) from column names."""
    names = [c.replace(BOM, "").strip() for c in df.columns]
    return df.toDF(*names) if names != df.columns else df


def validate_frame(df: DataFrame) -> DataFrame:
    if not df.columns:
        raise ValueError("dataset has no columns")
    if df.isEmpty():
        raise ValueError("dataset has no rows")
    return df


def load_dataset(spark: SparkSession, path: str, delimiter: str | None = None, infer_schema: bool = True,
                 encoding: str | None = None, validate: bool = True, multi_line: bool = True) -> DataFrame:
    """Csv / tsv (header row, delimiter by extension unless given, encoding
    detected) or parquet; column names trimmed; empty input refused. Quotes inside a
    quoted field are doubled. Fields may hold line breaks: UTF-8 files are then joined to records split by
    split (``quoted_csv``), other encodings are read one file a task. ``multi_line=False`` takes every line for a record."""
    ext = validate_extension(path)
    if ext == ".parquet":
        df = spark.read.parquet(path)
    else:
        enc = encoding or detect_encoding(spark, path)
        sep = delimiter or DELIMITERS[ext]
        df = read_quoted_csv(spark, path, sep, infer_schema).drop(CORRUPT) if multi_line and enc == "UTF-8" else \
            (spark.read.option("header", True).option("inferSchema", infer_schema)
                   .option("sep", sep).option("encoding", enc)
                   .option("quote", '"').option("escape", '"').option("multiLine", multi_line)
                   .option("mode", "PERMISSIVE").csv(path))
    df = clean_names(df)
    return validate_frame(df) if validate else df


def read_documents(spark: SparkSession, folder: str, extensions=(".md", ".txt")) -> DataFrame:
    """Every ``.md`` then ``.txt`` file of a folder as one row: (source = file stem, file_name, content, kind). A folder
    without such files gives no rows; one that cannot be read raises Spark's error."""
    glob = "*{" + ",".join(extensions) + "}"
    d = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    kind = F.coalesce(*[F.when(name.endswith(e), F.lit(i)) for i, e in enumerate(extensions)])
    return d.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "").alias("source"), F.col("_metadata.file_name").alias("file_name"),
                    F.decode("content", "UTF-8").alias("content"), kind.alias("kind"))
