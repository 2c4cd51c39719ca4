"""Structured Streaming forms of the row-wise and bucketed operators.

The reference analyses static files only; these helpers let the same
operators run on a stream: lexicon sentiment is stateless (append mode) and
time bucketing is a streaming aggregation whose state is one row per bucket,
bounded by the calendar span; a watermark on the time column lets Spark drop
state for buckets that can no longer change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.functions.stats import exact_sum
from tablelens.operators.sentiment import sentiment_label, valence
from tablelens.operators.timeseries import FREQ_UNIT

# day and week buckets as event-time windows (weeks start on Monday; 1970-01-01 was a Thursday)
_WINDOWS = {"D": ("1 day", None), "W": ("7 days", "4 days")}


def stream_sentiment(stream: DataFrame, text: str) -> DataFrame:
    """Per-row compound score and label of a streaming text column (stateless)."""
    v = valence(text)
    return stream.withColumn("compound", F.round(v, 4)).withColumn("label", sentiment_label(v))


def stream_time_series(stream: DataFrame, ts: str, value: str | None = None, freq: str = "D",
                       watermark: str = "1 day") -> DataFrame:
    """Bucketed series of a stream: (bucket, value, n_records). Day and week
    buckets are event-time windows, so ``append`` output emits each bucket once
    the watermark passes it; month/quarter/year buckets use ``update`` mode."""
    # watermarks need TIMESTAMP; NTZ times are read as session-zone (UTC) instants
    s = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)
    v = F.col(value).try_cast("double") if value else None
    aggs = ([exact_sum(v).alias("value"), F.count(v).alias("n_records")] if value
            else [F.count(F.lit(1)).cast("double").alias("value"), F.count(F.lit(1)).alias("n_records")])
    if freq in _WINDOWS:
        size, start = _WINDOWS[freq]
        w = F.window(ts, size, size, start) if start else F.window(ts, size)
        g = s.groupBy(w.alias("w")).agg(*aggs)
        return g.select(F.col("w.start").cast("timestamp_ntz").alias("bucket"),
                        F.coalesce(F.col("value"), F.lit(0.0)).alias("value"), F.col("n_records").cast("long"))
    bucket = F.date_trunc(FREQ_UNIT[freq], F.col(ts)).cast("timestamp_ntz")
    g = s.groupBy(bucket.alias("bucket")).agg(*aggs)
    return g.select("bucket", F.coalesce(F.col("value"), F.lit(0.0)).alias("value"), F.col("n_records").cast("long"))


def run_to_memory(df: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None):
    """Drain a streaming query into an in-memory table (tests / notebooks)."""
    from tablelens.sources.sinks import scratch_dir
    q = (df.writeStream.format("memory").queryName(name).outputMode(mode)
           .option("checkpointLocation", checkpoint or scratch_dir(df.sparkSession, f"stream-{name}"))
           .start())
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)
