"""Forecasting and estimation: generalised linear models over all rows, and time-series models per series.

GLMs are fitted by iteratively reweighted least squares; each iteration is one aggregation to the cross-products of the
columns, so rows never leave the executors. Series models run per key in pandas, a series being small.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F


def glm(rows: DataFrame, y: str, x: list[str], family: str = "logistic", rounds: int = 25, tolerance: float = 1e-8) -> dict[str, float]:
    """Coefficients and robust (HC0) standard errors ``se_<name>`` of a logistic or Poisson regression."""
    names = ["_one", *x]
    z = rows.select(F.lit(1.0).alias("_one"), *[F.col(c).cast("double").alias(c) for c in x], F.col(y).cast("double").alias("_y")).dropna()
    k, beta = len(names), np.zeros(len(names))
    if family == "poisson":
        mean = z.agg(F.avg("_y")).first()[0]
        beta[0] = math.log(max(mean or 0.0, 1e-9))

    def products(b: np.ndarray):
        eta = sum((F.lit(float(v)) * F.col(n) for v, n in zip(b, names)), F.lit(0.0))
        mu = F.exp(F.least(eta, F.lit(50.0))) if family == "poisson" else 1 / (1 + F.exp(-eta))
        t = z.withColumns({"_mu": mu}).withColumn("_w", F.col("_mu") if family == "poisson" else F.col("_mu") * (1 - F.col("_mu"))).withColumn("_r", F.col("_y") - F.col("_mu"))
        pairs = [(i, j) for i in range(k) for j in range(i, k)]
        got = t.agg(*[F.sum(F.col("_w") * F.col(names[i]) * F.col(names[j])).alias(f"h{i}_{j}") for i, j in pairs], *[F.sum(F.pow("_r", 2) * F.col(names[i]) * F.col(names[j])).alias(f"m{i}_{j}") for i, j in pairs], *[F.sum(F.col("_r") * F.col(n)).alias(f"g{i}") for i, n in enumerate(names)]).first()
        square = lambda c: np.array([[got[f"{c}{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)], float)
        return square("h"), square("m"), np.array([got[f"g{i}"] or 0.0 for i in range(k)], float)

    for _ in range(rounds):
        h, _m, g = products(beta)
        step = np.linalg.lstsq(h, g, rcond=None)[0]
        beta = beta + step
        if np.abs(step).max() < tolerance:
            break
    h, m, _g = products(beta)
    inverse = np.linalg.pinv(h)
    se = np.sqrt(np.maximum(0, np.diag(inverse @ m @ inverse)))
    labels = ["intercept", *x]
    return {**dict(zip(labels, map(float, beta))), **{f"se_{n}": float(s) for n, s in zip(labels, se)}}


def baselines(rows: DataFrame, key: list[str], order: list[str], value: str, season: int) -> DataFrame:
    """One-step forecasts of each row from the rows before it: last value, same season before, drift and mean."""
    by = W.partitionBy(*key).orderBy(*order)
    past = by.rowsBetween(W.unboundedPreceding, -1)
    n = F.count(value).over(past)
    last, first = F.lag(value).over(by), F.first(value).over(past)
    return rows.withColumns({"persistence": last, "seasonal_naive": F.lag(value, season).over(by), "drift": F.when(n > 1, last.cast("double") + (last - first).cast("double") / (n - 1)), "historical_mean": F.sum(value).over(past).cast("double") / n})


def autoregression(rows: DataFrame, key: str, order: str, value: str, lags: int) -> DataFrame:
    """``(key, n, intercept, coefficients, sd, forecast)`` of an AR model by least squares, per series."""

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        y = frame.sort_values(order)[value].to_numpy(float)
        y = y[np.isfinite(y)]
        name = frame[key].iloc[0]
        if len(y) < 2 * lags + 2:
            return pd.DataFrame({"key": [name], "n": [len(y)], "intercept": [None], "coefficients": [None], "sd": [None], "forecast": [None]})
        x = np.column_stack([np.ones(len(y) - lags), *[y[lags - j : len(y) - j] for j in range(1, lags + 1)]])
        b = np.linalg.lstsq(x, y[lags:], rcond=None)[0]
        e = y[lags:] - x @ b
        ahead = b[0] + sum(b[j] * y[-j] for j in range(1, lags + 1))
        return pd.DataFrame({"key": [name], "n": [len(y)], "intercept": [b[0]], "coefficients": [b[1:].tolist()], "sd": [math.sqrt(float(e @ e) / max(1, len(e) - lags - 1))], "forecast": [ahead]})

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, order, value).groupBy(key).applyInPandas(fit, f"key {kind}, n long, intercept double, coefficients array<double>, sd double, forecast double")


def local_level(rows: DataFrame, key: str, order: str, value: str, ratio: float) -> DataFrame:
    """Kalman filter of a random walk seen with noise, per series: ``(key, order, level, variance)``.

    ``ratio`` is the variance of the steps over that of the noise; a missing value carries the level on.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order)
        level, p, out = 0.0, 1e7, []
        for y in frame[value].to_numpy(float):
            p += ratio
            if np.isfinite(y):
                gain = p / (p + 1)
                level, p = level + gain * (y - level), p * (1 - gain)
            out.append((level, p))
        return pd.DataFrame({"key": frame[key].to_numpy(), "at": frame[order].to_numpy(), "level": [a for a, _ in out], "variance": [b for _, b in out]})

    kinds = rows.schema[key].dataType.simpleString(), rows.schema[order].dataType.simpleString()
    return rows.select(key, order, value).groupBy(key).applyInPandas(run, f"key {kinds[0]}, at {kinds[1]}, level double, variance double")


def diebold_mariano(losses: DataFrame, order: str, model: str, baseline: str, horizon: int = 1) -> dict[str, float]:
    """Mean loss difference and its test statistic with autocovariances up to horizon - 1 (and the small-sample factor)."""
    d = losses.select(order, (F.col(model) - F.col(baseline)).alias("d"))
    w = W.orderBy(order)
    lagged = d.select("d", *[F.lag("d", j).over(w).alias(f"l{j}") for j in range(1, horizon)])
    mean, n = d.agg(F.avg("d"), F.count("d")).first()
    if not n:
        return {"mean": 0.0, "statistic": 0.0, "n": 0}
    parts = lagged.agg(F.sum(F.pow(F.col("d") - mean, 2)).alias("c0"), *[F.sum((F.col("d") - mean) * (F.col(f"l{j}") - mean)).alias(f"c{j}") for j in range(1, horizon)]).first()
    variance = (parts["c0"] + 2 * sum(parts[f"c{j}"] or 0.0 for j in range(1, horizon))) / n / n
    factor = math.sqrt((n + 1 - 2 * horizon + horizon * (horizon - 1) / n) / n)
    return {"mean": float(mean), "statistic": float(mean / math.sqrt(variance) * factor) if variance > 0 else 0.0, "n": int(n)}


def block_bootstrap(rows: DataFrame, order: str, value: str, block: int, replications: int, seed: int = 0) -> DataFrame:
    """``(replication, mean)`` of moving-block resamples, from block sums alone: a resample of m blocks weighs
    each block by how often hashed draws pick it."""
    w = W.orderBy(order)
    n = rows.count()
    size = max(1, n - block + 1)
    starts = rows.withColumn("i", F.row_number().over(w) - 1).withColumn("s", F.sum(value).over(w.rowsBetween(0, block - 1))).where(F.col("i") < size).select("i", "s")
    draws = rows.sparkSession.range(replications).select(F.col("id").alias("replication"), F.explode(F.sequence(F.lit(1), F.lit(max(1, round(n / block))))).alias("d"))
    picks = draws.withColumn("i", F.pmod(F.xxhash64(F.lit(seed), "replication", "d"), F.lit(size)))
    return picks.join(starts, "i").groupBy("replication").agg((F.sum("s") / (F.count("*") * block)).alias("mean"))
