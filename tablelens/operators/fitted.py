"""Forecast models with fitted parameters (TS12, TS13), one aggregated series a key.

A key's series has one value per bucket, so its length is bounded by the calendar; keys are fitted side by side.
Buckets whose value is null or not finite are left out; too short series have no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.operators.forecast import ARIMA_GRID, HOLT_ALPHA, HOLT_BETA, HOLT_PHI


def _points(*axes) -> np.ndarray:
    return np.stack(np.meshgrid(*axes, indexing="ij"), -1).reshape(-1, len(axes))


def narrowed(cost: Callable[[np.ndarray], np.ndarray], start: np.ndarray, span: np.ndarray, low: np.ndarray, high: np.ndarray,
             rounds: int = 24) -> np.ndarray:
    """The best point found: first among ``start``, then on lattices around the best so far, which is one of their points.
    A lattice is halved unless the best lies on its edge."""
    best = start[np.argmin(cost(start))]
    lattice = _points(*[np.linspace(-1, 1, 5)] * start.shape[1])
    for _ in range(rounds):
        near = np.clip(best + span * lattice, low, high)
        near[len(near) // 2] = best
        at = int(np.argmin(cost(near)))
        best = near[at]
        if np.abs(lattice[at]).max() < 1:
            span = span / 2
    return best


def holt_paths(y: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Damped additive trend from the third value on, for every (alpha, beta, phi): the sum of squared one-step errors, the last
    level and slope, and the first ones, which are those of the least sum (errors are linear in them)."""
    alpha, beta, phi = (points[:, [k]] for k in range(3))
    level = np.tile([0.0, 1.0, 0.0], (len(points), 1))  # parts: without first states, by first level, by first slope
    slope = np.tile([0.0, 0.0, 1.0], (len(points), 1))
    errors = np.empty((len(y) - 2, len(points), 3))
    for t, value in enumerate(y[2:]):
        ahead = level + phi * slope
        errors[t] = [value, 0.0, 0.0] - ahead
        new = ahead + alpha * errors[t]
        slope, level = beta * (new - level) + (1 - beta) * phi * slope, new
    by = np.moveaxis(errors[:, :, 1:], 1, 0)
    first = -np.einsum("gkt,tg->gk", np.linalg.pinv(by), errors[:, :, 0])
    parts = np.concatenate([np.ones((len(points), 1)), first], axis=1)
    left = np.einsum("tgk,gk->tg", errors, parts)
    return (left ** 2).sum(axis=0), (level * parts).sum(axis=1), (slope * parts).sum(axis=1), first


def holt_best(y: np.ndarray) -> dict:
    """Parameters and states of the least sum of squared errors; never above the parameter grid's with its first states."""
    shift, scale = y.mean(), y.std() or 1.0
    z = (y - shift) / scale
    best = narrowed(lambda p: holt_paths(z, p)[0], _points(HOLT_ALPHA, HOLT_BETA, HOLT_PHI), np.array([0.1, 0.1, 0.05]),
                    np.array([0.001, 0.0, 0.8]), np.array([0.999, 0.999, 0.995]))
    sse, level, slope, _ = (v[0] for v in holt_paths(z, best[None]))
    return {"alpha": best[0], "beta": best[1], "phi": best[2], "sse": sse * scale ** 2, "level": level * scale + shift, "slope": slope * scale}


def arma_innovations(d: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ARMA(1,1) of mean zero, for every (phi, theta): the exact Gaussian log-likelihood at its best variance, that
    variance, and the forecast of the next value. One-step errors and their variances follow by the innovations recursion."""
    phi, theta = points[:, 0], points[:, 1]
    spread = (1 + 2 * phi * theta + theta ** 2) / (1 - phi ** 2)
    ahead, squares, logs = np.zeros(len(points)), np.zeros(len(points)), np.zeros(len(points))
    for x in d:
        error = x - ahead
        squares += error ** 2 / spread
        logs += np.log(spread)
        ahead = phi * x + theta / spread * error
        spread = 1 + theta ** 2 - theta ** 2 / spread
    variance = squares / len(d)
    with np.errstate(divide="ignore"):
        return -0.5 * (len(d) * (np.log(2 * np.pi * variance) + 1) + logs), variance, ahead


def arima_best(y: np.ndarray) -> dict:
    """ARIMA(1,1,1) without drift at its greatest exact likelihood; a series of equal steps of 0 has no likelihood."""
    d = np.diff(y)
    scale = np.sqrt((d ** 2).mean())
    if scale == 0:
        return {"phi": 0.0, "theta": 0.0, "sigma2": 0.0, "log_likelihood": None, "next": 0.0}
    best = narrowed(lambda p: -arma_innovations(d / scale, p)[0], _points(ARIMA_GRID, ARIMA_GRID), np.array([0.1, 0.1]),
                    np.array([-0.99, -0.99]), np.array([0.99, 0.99]))
    likelihood, variance, ahead = (v[0] for v in arma_innovations(d / scale, best[None]))
    return {"phi": best[0], "theta": best[1], "sigma2": variance * scale ** 2, "log_likelihood": likelihood - len(d) * np.log(scale),
            "next": ahead * scale}


def _per_key(series: DataFrame, keys, least: int, fields: str, rows: Callable[[np.ndarray], pd.DataFrame]) -> DataFrame:
    keys = list(keys)
    kinds = {f.name: f.dataType.simpleString() for f in series.schema}
    names = [f"k{i}" for i in range(len(keys))]
    own = series.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(keys, names)], "bucket", F.col("value").cast("double").alias("value"))
    own = own.where("value is not null and not isnan(value) and abs(value) < double('infinity')")

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        y = group.sort_values("bucket")["value"].to_numpy()
        out = rows(y) if len(y) >= least else rows(np.arange(float(least)))[:0]
        for at, n in enumerate(names):
            out.insert(at, n, [group[n].iloc[0]] * len(out))
        return out if len(out) else out.astype(object)  # an empty column of strings is not one Arrow array

    schema = ", ".join([*(f"{n} {kinds[k]}" for n, k in zip(names, keys)), fields])
    return own.groupBy(*names).applyInPandas(fit, schema).withColumnsRenamed(dict(zip(names, keys)))


def holt_fitted(series: DataFrame, keys=(), horizon: int = 5) -> DataFrame:
    """TS12 with fitted parameters and first states, from 5 points on: (keys..., method, step, value, alpha, beta, phi, sse)."""
    def rows(y: np.ndarray) -> pd.DataFrame:
        m = holt_best(y)
        damped = np.cumsum(m["phi"] ** np.arange(1, horizon + 1))
        return pd.DataFrame({"method": "exponential_smoothing", "step": np.arange(1, horizon + 1), "value": m["level"] + damped * m["slope"],
                             **{k: m[k] for k in ("alpha", "beta", "phi", "sse")}})

    return _per_key(series, keys, 5, "method string, step long, value double, alpha double, beta double, phi double, sse double", rows)


def arima_exact(series: DataFrame, keys=(), horizon: int = 5) -> DataFrame:
    """TS13 by exact likelihood, from 12 points on: (keys..., method, step, value, phi, theta, sigma2, log_likelihood)."""
    def rows(y: np.ndarray) -> pd.DataFrame:
        m = arima_best(y)
        steps = m["next"] * m["phi"] ** np.arange(horizon)
        return pd.DataFrame({"method": "arima", "step": np.arange(1, horizon + 1), "value": y[-1] + np.cumsum(steps),
                             **{k: m[k] for k in ("phi", "theta", "sigma2", "log_likelihood")}})

    return _per_key(series, keys, 12, "method string, step long, value double, phi double, theta double, sigma2 double, log_likelihood double", rows)
