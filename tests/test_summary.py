import numpy as np
import pytest
from pyspark.sql import functions as F

from tablelens.functions import summary as S
from tablelens.operators import describe as D
from tablelens.operators import profile as P
from tablelens.operators import schema as SC


@pytest.fixture(scope="module")
def mixed(spark):
    rng = np.random.default_rng(7)
    rows = [(float(rng.normal()), float(rng.integers(0, 5)), 3.0, None if i % 3 else float(i), float("nan") if i % 7 == 0 else float(i % 100) ** 3,
             str(i % 50) if i % 4 else "n/a") for i in range(20_000)]
    return spark.createDataFrame(rows, "a double, few double, same double, gaps double, nans double, text string").repartition(6)


PROBS = {"p1": 0.01, "q25": 0.25, "q50": 0.5, "p999": 0.999, "least": 0.0, "most": 1.0}


@pytest.mark.parametrize("narrow", [S.NARROW, 3])
def test_quantiles_and_shape_against_numpy(mixed, monkeypatch, narrow):
    monkeypatch.setattr(S, "NARROW", narrow)
    pdf = mixed.toPandas()
    pdf["text"] = [float(t) if t != "n/a" else None for t in pdf.text]
    got = S.column_numbers(mixed, list(pdf.columns), PROBS, shape=True)
    for c in pdf.columns:
        v = pdf[c].dropna().to_numpy(float)
        assert got[c]["n"] == len(v) and np.isclose(got[c]["m2"], ((v - v.mean()) ** 2).sum())
        for name, p in PROBS.items():
            assert np.isclose(got[c][name], np.quantile(v, p), rtol=1e-12), (c, name)


def test_few_values_and_empty_columns(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None)], "a double, b double")
    got = S.column_numbers(df, ["a", "b"], {"m": 0.5})
    assert got == {"a": {"n": 2, "mean": 1.5, "min": 1.0, "max": 2.0, "m": 1.5}}
    assert S.column_table(df.limit(0), ["a", "b"], {"m": 0.5}, lambda x, own: {"z": F.count_if(x > own["m"])}).count() == 0
    assert S.column_numbers(spark.createDataFrame([(5.0,)], "a double"), ["a"], {"m": 0.5})["a"]["m"] == 5.0


def test_names_with_dots_and_ticks(spark):
    df = spark.createDataFrame([(1.0, "x", 2), (2.0, "y", 3), (9.0, None, 4)], "`unit.price` double, `a``b` string, `n.` int")
    assert [r.column for r in SC.detect_schema(df).orderBy("pos").collect()] == ["unit.price", "a`b", "n."]
    assert {r.column: r["median"] for r in D.describe_numeric(df, ["unit.price", "n."]).collect()} == {"unit.price": 2.0, "n.": 3.0}
    assert P.dataset_profile(df).first().rows == 3 and P.missing_report(df).count() == 3
    assert P.assess_quality(df).count() == 1 and P.profile_columns(df).count() == 3
    from tablelens.operators import anomaly, clean, groups, outliers, relate
    assert outliers.outlier_report(df, ["unit.price", "n."]).count() == 2
    assert outliers.classify_outliers(df, "unit.price").columns[:3] == df.columns
    assert anomaly.flag_anomalies(df, ["unit.price", "n."]).count() == 3
    assert relate.correlation_matrix(df, ["unit.price", "n."]).count() == 4
    assert clean.clean_dataset(df).df.columns == df.columns
    assert groups.composition_report(df, ["a`b"], "unit.price").count() > 0
