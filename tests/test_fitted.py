import numpy as np
import pytest

from tablelens.operators import fitted
from tablelens.operators import forecast as FC


def _series(spark, values):
    rows = [(k, i, v) for k, own in values.items() for i, v in enumerate(own)]
    return spark.createDataFrame(rows, "`a.key` string, i int, value double").selectExpr(
        "`a.key`", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(i) as bucket", "value")


def _dense(d, phi, theta):
    """Log-likelihood by the whole covariance matrix, at the best variance."""
    n = len(d)
    psi = np.array([1.0] + [phi ** (k - 1) * (phi + theta) for k in range(1, 3000)])
    gamma = [(psi[:len(psi) - h] * psi[h:]).sum() for h in range(n)]
    cov = np.array([[gamma[abs(i - j)] for j in range(n)] for i in range(n)])
    s = d @ np.linalg.solve(cov, d) / n
    return -0.5 * (n * (np.log(2 * np.pi * s) + 1) + np.linalg.slogdet(cov)[1]), s


@pytest.mark.parametrize("phi,theta", [(0.5, 0.3), (-0.7, 0.9), (0.95, -0.4), (0.0, 0.0)])
def test_likelihood_is_that_of_the_covariance(phi, theta):
    d = np.random.default_rng(3).normal(size=15)
    got, variance, _ = fitted.arma_innovations(d, np.array([[phi, theta]]))
    assert np.allclose([got[0], variance[0]], _dense(d, phi, theta), rtol=1e-8)


def test_arima_is_the_best_of_a_fine_lattice():
    rng = np.random.default_rng(5)
    e = rng.normal(size=201)
    d = np.zeros(200)
    for t in range(200):
        d[t] = (0.6 * d[t - 1] if t else 0) + e[t + 1] + 0.4 * e[t]
    m = fitted.arima_best(np.cumsum(np.append(100.0, d)))
    fine = np.linspace(-0.98, 0.98, 99)
    assert m["log_likelihood"] >= fitted.arma_innovations(d, fitted._points(fine, fine))[0].max() - 1e-6
    assert abs(m["phi"] - 0.6) < 0.25 and abs(m["theta"] - 0.4) < 0.25


def test_holt_never_above_the_grid(spark):
    rng = np.random.default_rng(2)
    values = {"noise": rng.normal(size=40) * 1e6, "line": 5.0 + 2.0 * np.arange(30), "flat": np.full(20, 7.0),
              "walk": np.cumsum(rng.normal(size=60)) + 1e4, "five": np.array([1.0, 5, 2, 8, 3])}
    s = _series(spark, {k: v.tolist() for k, v in values.items()})
    grid = {r["key"]: r["sse"] for r in FC.holt_fit(s.withColumnRenamed("a.key", "key"), ["key"]).collect()}
    got = fitted.holt_fitted(s, ["a.key"]).collect()
    assert len(got) == 25 and set(grid) == set(values)
    for r in got:
        assert r["sse"] <= grid[r["a.key"]] + 1e-4, r
    flat = [r["value"] for r in got if r["a.key"] == "flat"]
    assert np.allclose(flat, 7.0)


def test_odd_series(spark):
    odd = {"short": [1.0, 2.0, 3.0], "gaps": [1.0, None, 2.0, float("nan"), float("inf"), 3.0, 4.5, 5.0] + [6.0, 5.0] * 4, "still": [2.0] * 14}
    s = _series(spark, odd)
    holt, arima = fitted.holt_fitted(s, ["a.key"]).collect(), fitted.arima_exact(s, ["a.key"], 3).collect()
    assert {r["a.key"] for r in holt} == {r["a.key"] for r in arima} == {"gaps", "still"}
    assert all(np.isfinite(r["value"]) for r in holt + arima)
    still = [(r["value"], r["log_likelihood"]) for r in arima if r["a.key"] == "still"]
    assert still == [(2.0, None)] * 3
    assert fitted.arima_exact(s.where("false"), ["a.key"]).count() == 0
    assert fitted.holt_fitted(s.where("`a.key` = 'still'")).count() == 5  # no keys: one series
