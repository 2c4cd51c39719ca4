import math

import numpy as np
import pandas as pd

from tablelens.operators import anomaly as N
from tablelens.operators import groups as G
from tablelens.operators import relate as R
from tablelens.operators import sentiment as X


def test_composition_shares(small_df):
    rows = G.composition(small_df, "district").collect()
    assert abs(sum(r["share_pct"] for r in rows) - 100) <= 1.5


def test_composition_other_row(spark):
    df = spark.createDataFrame([(f"c{i % 20}",) for i in range(200)], "c string")
    rows = G.composition(df, "c", top_n=15).collect()
    other = [r for r in rows if r["category"] == "Other"]
    assert len(rows) == 16 and other[0]["count"] == 50 and other[0]["rank"] == 16


def test_compare_groups_median(small_df):
    got = {r["group"]: r["value"] for r in G.compare_groups(small_df, "district", "amount", "median").collect()}
    pdf = small_df.toPandas()
    for k, v in pdf.groupby("district")["amount"].median().items():
        assert abs(got[k] - round(v, 4)) < 1e-6


def test_comparison_report_shape(small_df):
    rep = G.comparison_report(small_df, ["district", "article"], ["amount", "pieces"])
    assert rep.select("group_col", "value_col").distinct().count() == 4


def test_corr_symmetric_unit_diagonal(small_df):
    m = {(r["a"], r["b"]): r["value"] for r in R.correlation_matrix(small_df, ["amount", "pieces"]).collect()}
    assert m[("amount", "amount")] == 1.0 and m[("amount", "pieces")] == m[("pieces", "amount")]


def test_spearman_matches_pandas(small_df):
    got = {(r["a"], r["b"]): r["value"]
           for r in R.correlation_matrix(small_df, ["amount", "pieces"], "spearman").collect()}
    exp = small_df.toPandas()[["amount", "pieces"]].corr(method="spearman").loc["amount", "pieces"]
    assert abs(got[("amount", "pieces")] - round(exp, 4)) < 1e-9


def test_cramers_v_matches_numpy(small_df):
    got = R.categorical_associations(small_df, ["district", "article"]).first()["cramers_v"]
    t = pd.crosstab(small_df.toPandas()["district"], small_df.toPandas()["article"]).to_numpy(float)
    exp = t.sum(1, keepdims=True) @ t.sum(0, keepdims=True) / t.sum()
    chi2 = ((t - exp) ** 2 / exp).sum()
    assert abs(got - round(math.sqrt(chi2 / (t.sum() * (min(t.shape) - 1))), 4)) < 1e-9


def test_zscore_anomalies_and_driver(spark):
    vals = [(float(i % 7), float(i % 5)) for i in range(200)] + [(500.0, 1.0)]
    df = spark.createDataFrame(vals, "a double, b double")
    t = N.anomaly_table(df, ["a", "b"], "zscore").collect()
    assert len(t) == 1 and t[0]["driver"] == "a"


def test_isolation_forest_finds_spikes(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 2))
    x[:30] *= 25
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(3000), "a": x[:, 0], "b": x[:, 1]}))
    from tablelens.operators.iforest import isolation_forest_flags
    out = isolation_forest_flags(df, ["a", "b"], contamination=0.02)
    flagged = {r["id"] for r in out.filter("is_anomaly").select("id").collect()}
    assert 50 <= len(flagged) <= 70
    assert len(flagged & set(range(30))) >= 25


def test_valence_hand_computed(spark):
    df = spark.createDataFrame([("Not very good, terrible!",), ("",), ("nothing here",)], "t string")
    vals = [r[0] for r in df.select(X.valence("t")).collect()]
    # good: +1 * 0.7 (negated) * 1.5 (intensified) = 1.05 ; terrible: -1.8 ; mean -0.375
    assert abs(vals[0] - (-0.375)) < 1e-12 and vals[1] == 0.0 and vals[2] == 0.0


def test_sentiment_summary_sums_to_100(text_df):
    r = X.sentiment_summary(text_df, ["review"]).first()
    assert abs(r["positive_pct"] + r["neutral_pct"] + r["negative_pct"] - 100) <= 0.01


def test_spearman_ranks_pairs_over_their_complete_rows(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"x": rng.normal(size=80), "y": rng.normal(size=80), "z": rng.integers(0, 6, 80).astype(float)})
    pdf.loc[pdf.index % 3 == 0, "x"] = np.nan
    pdf.loc[pdf.index % 4 == 1, "y"] = np.nan
    df = spark.createDataFrame(pdf)
    exp = pdf.corr(method="spearman")
    for r in R.correlation_matrix(df, ["x", "y", "z"], "spearman", digits=None).collect():
        assert abs(r["value"] - exp.loc[r["a"], r["b"]]) < 1e-9, (r["a"], r["b"])


def test_strongest_pairs_rank_unrounded_values(spark):
    m = spark.createDataFrame([("a", "b", 0.12341), ("a", "c", 0.12344), ("b", "c", -0.9)], "a string, b string, value double")
    got = [(r["a"], r["b"], r["corr"]) for r in R.strongest_pairs(m, ["a", "b", "c"]).orderBy("rank").collect()]
    assert got == [("b", "c", -0.9), ("a", "c", 0.1234), ("a", "b", 0.1234)]


def test_comparison_takes_every_column_and_keeps_top_and_bottom(spark):
    groups, values = [f"g{i}" for i in range(10)], [f"v{i}" for i in range(6)]
    df = spark.range(30).selectExpr(*[f"concat('k', id % {i + 1}) as g{i}" for i in range(10)],
                                    *[f"cast(id * {i + 1} as double) as v{i}" for i in range(6)])
    assert G.comparison_report(df, groups, values).select("group_col", "value_col").distinct().count() == 60
    kinds = [(r["group"], r["kind"]) for r in G.comparison_insights(df, ["g0"], "v0").collect()]
    assert sorted(kinds) == [("k0", "bottom"), ("k0", "top")]


def test_forest_draws_repeated_rows_apart(spark):
    """Few distinct values, many rows: every tree is grown, and the far value of every 50th row (so that a tree's
    sample holds some of them) scores highest."""
    from tablelens.operators.iforest import isolation_forest_scores
    df = spark.range(200_000).selectExpr("cast(if(id % 50 = 7, 1000, id % 100) as double) as x", "cast(id % 10 as double) as y")
    top = isolation_forest_scores(df, ["x", "y"]).groupBy("x").agg({"if_score": "max"}).collect()
    scores = {r[0]: r[1] for r in top}
    assert len(scores) == 99 and max(scores, key=scores.get) == 1000.0
    assert min(scores.values()) < 0.6


def test_forest_paths_are_those_of_a_walk():
    import numpy as np
    import pandas as pd

    from tablelens.operators import iforest
    rng = np.random.RandomState(3)
    x = rng.rand(200, 3)
    nodes = pd.DataFrame(iforest._grow(x[:64], rng, 6), columns=["feature", "threshold", "left", "right", "size", "leaf"])
    nodes = nodes.assign(tree=0, node=range(len(nodes)))

    def walk(row, at=0, depth=0):
        n = nodes.iloc[at]
        return depth + iforest.c_factor(n["size"]) if n.leaf else walk(row, n.left if row[n.feature] < n.threshold else n.right, depth + 1)

    (tree,) = iforest._prepared(nodes)
    assert len(tree) == 5 and iforest._path_lengths(x, tree).tolist() == [walk(r) for r in x]
