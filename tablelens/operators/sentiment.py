"""Lexicon sentiment, sentiment summaries and frequent words.

The score is a native expression: tokens from ``regexp_extract_all``, a
``transform`` over (token, position) that looks back at the two previous
tokens, and an ``aggregate`` for the mean - it stays inside whole-stage
codegen, with no Python in the row path.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelens.functions.columns import col
from tablelens.functions import lexicon as L
from tablelens.functions.stats import melt, rnd, top_k
from tablelens.operators.groups import label


def tokens(text) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(t), F.lit(L.TOKEN_PATTERN), 0)


def valence(text) -> Column:
    """Mean token valence in [-1, 1]: +1 positive, -1 negative (x1.8 strong),
    x0.7 when one of the two previous tokens negates, x1.5 after an
    intensifier; 0 when no lexicon word occurs."""
    toks = tokens(text)

    def val(w, i):
        base = (F.when(w.isin(*L.POS_WORDS), F.lit(1.0))
                .when(w.isin(*L.NEG_WORDS),
                      F.when(w.isin(*L.STRONG_NEGATIVE), F.lit(-L.STRONG_FACTOR)).otherwise(F.lit(-1.0))))
        start = F.greatest(i - 1, F.lit(1))
        window = F.slice(toks, start, i + 1 - start)
        neg = F.when(F.exists(window, lambda p: p.isin(*L.NEGATORS)), F.lit(L.NEGATION_FACTOR)).otherwise(F.lit(1.0))
        intens = F.when((i > 0) & F.element_at(toks, F.greatest(i, F.lit(1))).isin(*L.INTENSIFIERS),
                        F.lit(L.INTENSIFIER_FACTOR)).otherwise(F.lit(1.0))
        return base * neg * intens

    hits = F.filter(F.transform(toks, val), lambda v: v.isNotNull())
    mean = F.aggregate(hits, F.lit(0.0), lambda a, v: a + v) / F.size(hits)
    return F.when(F.size(hits) == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), mean)))


def sentiment_label(c) -> Column:
    """Positive >= 0.05, negative <= -0.05, else neutral."""
    c = F.col(c) if isinstance(c, str) else c
    return (F.when(c >= L.POSITIVE_CUT, "positive").when(c <= L.NEGATIVE_CUT, "negative").otherwise("neutral"))


def _nonblank(text) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return t.isNotNull() & (F.length(F.regexp_replace(t, r"^\s+|\s+$", "")) > 0)


def score_rows(df: DataFrame, text: str) -> DataFrame:
    """Per row: compound (4 dp) and label of ``text``; blank/null texts skipped."""
    v = valence(text)
    return df.filter(_nonblank(text)).withColumn("_v", v).select(
        *df.columns, rnd("_v").alias("compound"), sentiment_label("_v").alias("label")).drop("_v")


def _long(df, cols):
    return melt(df.select(*cols), list(cols), "string", "column", "text").filter(_nonblank("text"))


def sentiment_summary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per text column: n, positive/neutral/negative % (2 dp), avg compound
    (4 dp) and the three counts."""
    long = _long(df, cols).withColumn("_v", valence("text")).withColumn("_l", sentiment_label("_v"))
    g = long.groupBy("column").agg(
        F.count(F.lit(1)).alias("n"), F.avg("_v").alias("avg"),
        *[F.count_if(F.col("_l") == k).alias(k) for k in ("positive", "neutral", "negative")])
    pct = {k: rnd(100.0 * F.col(k) / F.col("n"), 2).alias(f"{k}_pct") for k in ("positive", "neutral", "negative")}
    return g.select("column", F.col("n").cast("long"), pct["positive"], pct["neutral"], pct["negative"],
                    rnd("avg").alias("avg_compound"), F.col("positive").cast("long").alias("n_positive"),
                    F.col("neutral").cast("long").alias("n_neutral"), F.col("negative").cast("long").alias("n_negative"))


def _words(long, keys, text="text"):
    w = long.select(*keys, F.explode(tokens(text)).alias("word"))
    return w.filter(~F.col("word").isin(*L.STOP_WORDS) & (F.length("word") > 2))


def sentiment_words(df: DataFrame, cols: Sequence[str], k: int = 12) -> DataFrame:
    """Top ``k`` words of the positive and of the negative texts of each
    column (each word counted under its own row's label, SURVEY D7):
    (column, label, word, count, rank)."""
    long = _long(df, cols).withColumn("label", sentiment_label(valence("text")))
    long = long.filter(F.col("label") != "neutral")
    c = _words(long, ["column", "label"]).groupBy("column", "label", "word").agg(F.count(F.lit(1)).alias("count"))
    r = top_k(c, ["column", "label"], [F.col("count").desc(), F.col("word")], k, "rank")
    return r.select("column", "label", "word", F.col("count").cast("long"),
                                               F.col("rank").cast("long"))


def themes(df: DataFrame, cols: Sequence[str], k: int = 8) -> DataFrame:
    """Top ``k`` words over all text columns: (word, count, rank). Nulls are
    skipped (the reference counts the literal text of a missing value)."""
    long = melt(df.select(*cols), list(cols), "string", "column", "text").filter(F.col("text").isNotNull())
    c = _words(long, []).groupBy("word").agg(F.count(F.lit(1)).alias("count"))
    top = c.orderBy(F.col("count").desc(), F.col("word")).limit(k)
    from pyspark.sql import Window
    w = Window.orderBy(F.col("count").desc(), F.col("word"))  # k rows
    return top.select("word", F.col("count").cast("long"), F.row_number().over(w).cast("long").alias("rank"))


def sentiment_by(df: DataFrame, text: str, by: str) -> DataFrame:
    """Sentiment by a dimension (or a date_trunc'd time):
    (group, n, avg_compound, positive_pct, negative_pct)."""
    s = df.filter(_nonblank(text)).select(label(by).alias("group"), valence(text).alias("_v"))
    g = s.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.avg("_v").alias("avg"),
                               F.count_if(F.col("_v") >= L.POSITIVE_CUT).alias("p"),
                               F.count_if(F.col("_v") <= L.NEGATIVE_CUT).alias("q"))
    return g.select("group", F.col("n").cast("long"), rnd("avg").alias("avg_compound"),
                    rnd(100.0 * F.col("p") / F.col("n"), 2).alias("positive_pct"),
                    rnd(100.0 * F.col("q") / F.col("n"), 2).alias("negative_pct"))


def sentiment_over_time(df: DataFrame, text: str, date_col: str, freq: str = "D") -> DataFrame:
    """X6 over time: (bucket, n, avg_compound, positive_pct, negative_pct) per calendar bucket. Rows without a time are left
    out, as are blank texts; empty buckets are not filled."""
    from tablelens.operators.timeseries import FREQ_UNIT, _time
    own = df.select(F.date_trunc(FREQ_UNIT.get(freq, "day"), _time(df, date_col)).cast("timestamp_ntz").alias("bucket"),
                    col(text).alias("text")).filter(F.col("bucket").isNotNull())
    return sentiment_by(own, "text", "bucket").select(F.col("group").cast("timestamp_ntz").alias("bucket"), "n", "avg_compound",
                                                      "positive_pct", "negative_pct")
