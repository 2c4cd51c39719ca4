from tablelens.operators import profile as P
from tablelens.operators import schema as S


def test_small_df_types(small_df):
    t = S.schema_types(small_df)
    assert t["amount"] == "CURRENCY"
    assert t["sold_at"] == "DATETIME"
    assert t["district"] == "CATEGORICAL"
    assert t["ticket_id"] == "ID"
    assert t["pieces"] == "NUMERIC"


def test_string_rules(spark):
    df = spark.createDataFrame(
        [("2024-01-0%d" % (i % 9 + 1), str(i), "yes" if i % 2 else "no", f"w{i}", 0.5, i % 2) for i in range(80)],
        "d string, n string, b string, t string, share double, is_active int")
    t = S.schema_types(df)
    assert t == {"d": "DATETIME", "n": "NUMERIC", "b": "BOOLEAN", "t": "TEXT", "share": "PERCENTAGE",
                 "is_active": "BOOLEAN"}


def test_profile_shape(small_df):
    r = P.dataset_profile(small_df).first()
    assert (r["rows"], r["columns"]) == (84, 6)


def test_quality_bounds(small_df):
    q = P.assess_quality(small_df).first()
    assert 0 <= q["score"] <= 100 and q["grade"] in "ABCDF"


def test_duplicates(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "a long, b string")
    assert P.duplicate_rows(df).first()["duplicates"] == 1


def test_duplicates_with_nulls(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "y")], "a long, b string")
    assert P.duplicate_rows(df).first()["duplicates"] == 1


def test_missing_report_order(spark):
    df = spark.createDataFrame([(None, 1.0), (None, float("nan")), (3, 2.0)], "a long, b double")
    rows = P.missing_report(df).orderBy("rank").collect()
    assert [(r["column"], r["missing"]) for r in rows] == [("a", 2), ("b", 1)]
