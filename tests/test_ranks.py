import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablelens.operators import relate


@pytest.mark.parametrize("sent, hot", [(200_000, 50_000), (5, 20), (0, 0)])
def test_ranks_with_few_and_many_values(spark, monkeypatch, sent, hot):
    monkeypatch.setattr(relate, "MAX_SENT_VALUES", sent)
    monkeypatch.setattr(relate, "HOT", hot)
    h = lambda seed, n: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).cast("double")
    df = spark.range(400).select(F.when(h(1, 3) == 0, F.lit(7.0)).otherwise(h(2, 90)).alias("a.x"),
                                 F.when(h(3, 5) > 0, h(4, 40) - 20).alias("b"), F.when(h(5, 4) > 0, h(6, 3)).alias("c")).repartition(4)
    pdf = df.toPandas()
    got = {(r["a"], r["b"]): r["value"] for r in relate.correlation_matrix(df, df.columns, "spearman", digits=None).collect()}
    for x in pdf.columns:
        for y in pdf.columns:
            both = pdf[[x, y]].dropna() if x != y else pd.concat([pdf[x], pdf[x]], axis=1).dropna()
            want = both.iloc[:, 0].rank().corr(both.iloc[:, 1].rank())
            assert abs(got[x, y] - want) < 1e-9, (x, y)
    ranks = relate.rank_columns(df, ["a.x"]).toPandas()["a.x"]
    assert sorted(ranks) == sorted(pdf["a.x"].rank())


def test_columns_of_few_values_are_not_shuffled(spark):
    df = spark.range(1000).select((F.col("id") % 9).cast("double").alias("a"), (F.col("id") % 4).cast("double").alias("b"))
    plan = relate.rank_columns(df, ["a", "b"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 0 and plan.count("Exchange hashpartitioning(_rid") == 0  # before: every row was shuffled twice a column
