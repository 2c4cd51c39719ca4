"""Source / sink / sampling queries."""

from pyspark.sql import functions as F

from tablelens.catalog import analysis, plans  # noqa: F401 - their SQL is repeated here
from tablelens.catalog.base import ORACLE, QUERIES, digest_sql, register, table
from tablelens.operators.relate import correlation_matrix
from tablelens.sources import readers, sampling, sinks


def _csv_roundtrip(s, d):
    orders = table(s, d, "orders")
    out = sinks.export_cleaned(orders, sinks.scratch_dir(s, "csv"), "orders", "csv")
    df = readers.load_dataset(s, out)
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in orders.schema.fields])


register("csv_roundtrip", "SELECT * FROM orders")(_csv_roundtrip)


def _parquet_roundtrip(s, d):
    li = table(s, d, "lineitem")
    out = sinks.export_cleaned(li, sinks.scratch_dir(s, "parquet"), "lineitem", "parquet")
    return readers.load_dataset(s, out)


register("parquet_roundtrip", "SELECT * FROM lineitem")(_parquet_roundtrip)
ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]

register("sample_exact", f"""
SELECT * FROM orders ORDER BY {digest_sql(ORDERS, 42)}
LIMIT (SELECT CAST(round_even(0.1 * count(*), 0) AS BIGINT) FROM orders)
""")(lambda s, d: sampling.sample_exact(table(s, d, "orders"), 0.1))
register("sample_fraction")(lambda s, d: sampling.sample_fraction(table(s, d, "orders"), 0.25))
_SAMPLED = f"CAST('0x' || substr({digest_sql(['{k}'], 42)}, 1, 13) AS BIGINT) < 0.25 * 4503599627370496"
register("sample_by_key", f"""
SELECT l.* FROM lineitem l JOIN orders o ON l_orderkey = o_orderkey WHERE {_SAMPLED.format(k='o_orderkey')}
""")(lambda s, d: _sample_by_key(s, d))


def _sample_by_key(s, d):
    li, orders = table(s, d, "lineitem"), table(s, d, "orders")
    kept = sampling.sample_by_key(orders, ["o_orderkey"], 0.25).select(F.col("o_orderkey").alias("l_orderkey"))
    return sampling.sample_by_key(li, ["l_orderkey"], 0.25).join(kept, "l_orderkey").select(*li.columns)


register("fingerprint", f"""
WITH h AS (SELECT {digest_sql(ORDERS)} AS d FROM orders)
SELECT count(*) AS rows, bit_xor(CAST('0x' || substr(d, 16, 15) AS BIGINT)) AS xor_hash,
       CAST(sum(CAST('0x' || substr(d, 1, 15) AS BIGINT)) AS VARCHAR) AS sum_hash FROM h
""")(lambda s, d: sampling.fingerprint(table(s, d, "orders")))


def _results_roundtrip(s, d):
    """Two result tables exported as JSON, read back with their schemas."""
    li = table(s, d, "lineitem")
    results = {n: correlation_matrix(li, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], n) for n in ("pearson", "spearman")}
    paths = sinks.export_results(results, sinks.scratch_dir(s, "results"))
    read = {n: s.read.schema(t.schema).json(paths[n]).select(F.lit(n).alias("result"), "a", "b", "value") for n, t in results.items()}
    return read["pearson"].unionByName(read["spearman"])


register("results_roundtrip", "\nUNION ALL ".join(
    f"SELECT '{n}' AS result, a, b, value FROM ({ORACLE[n]})" for n in ("pearson", "spearman")))(_results_roundtrip)


def _summary_roundtrip(s, d):
    path = sinks.export_summary(QUERIES["summary_metrics"](s, d), sinks.scratch_dir(s, "summary"))
    return readers.load_dataset(s, path, infer_schema=False)


register("summary_roundtrip", ORACLE["summary_metrics"])(_summary_roundtrip)
