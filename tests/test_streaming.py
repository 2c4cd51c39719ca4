from tablelens.operators import timeseries as TS
from tablelens.streaming import run_to_memory, stream_sentiment, stream_time_series

SF = "/root/testdata/sf0.001"


def test_stream_time_series_matches_batch(spark):
    src = spark.read.parquet(f"{SF}/events.parquet")
    stream = spark.readStream.schema(src.schema).option("pathGlobFilter", "events.parquet").parquet(SF)
    out = run_to_memory(stream_time_series(stream, "ts", "value", "D", "1000 days"), "ts_stream", "complete")
    batch = TS.build_time_series(src, "ts", "value", "D")
    got = sorted((r["bucket"], round(r["value"], 6), r["n_records"]) for r in out.collect())
    exp = sorted((r["bucket"], round(r["value"], 6), r["n_records"]) for r in batch.collect())
    assert got == exp


def test_stream_sentiment(spark):
    src = spark.read.parquet(f"{SF}/conversations.parquet")
    stream = spark.readStream.schema(src.schema).option("pathGlobFilter", "conversations.parquet").parquet(SF)
    out = run_to_memory(stream_sentiment(stream, "text"), "sent_stream", "append")
    assert out.count() == src.count()
