"""Distribution functions and quantiles, by quadrature on whole Arrow batches.

Each integral is brought to a smooth integrand by a trigonometric or square substitution and summed over
Gauss-Legendre nodes; quantiles come from bisection of the whole batch at once.
"""

from __future__ import annotations

import math
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import functions as F, types as T

NODES = 300


@lru_cache
def _nodes() -> tuple[np.ndarray, np.ndarray]:
    x, w = np.polynomial.legendre.leggauss(NODES)
    return (x + 1) / 2, w / 2


_lgamma = np.vectorize(math.lgamma, otypes=[float])


def _integral(f, upper: np.ndarray) -> np.ndarray:
    """Integral of ``f`` from 0 to each upper bound."""
    x, w = _nodes()
    return (f(upper[:, None] * x[None, :]) * w[None, :]).sum(axis=1) * upper


def _times_log(power: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Power times logarithm, 0 for a power of 0."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(power[:, None] == 0, 0.0, power[:, None] * np.log(x))


def phi(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.vectorize(math.erfc, otypes=[float])(-np.asarray(x, float) / math.sqrt(2))


def beta_share(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function for a, b of at least one half, with x the squared sine of an angle."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    turned = x > (a + 0.5) / (a + b + 1)  # integrate over the shorter tail
    p, q = np.where(turned, b, a), np.where(turned, a, b)
    angle = np.arcsin(np.sqrt(np.clip(np.where(turned, 1 - x, x), 0, 1)))
    log_beta = _lgamma(p) + _lgamma(q) - _lgamma(p + q)

    def density(t: np.ndarray) -> np.ndarray:
        return 2 * np.exp(_times_log(2 * p - 1, np.sin(t)) + _times_log(2 * q - 1, np.cos(t)) - log_beta[:, None])

    part = _integral(density, angle)
    return np.clip(np.where(turned, 1 - part, part), 0, 1)


def gamma_share(s: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised lower incomplete gamma function for s of at least one half, in the square root of x."""
    s, x = np.broadcast_arrays(np.asarray(s, float), np.maximum(0.0, np.asarray(x, float)))
    reach = np.sqrt(s) + 7.0
    upper = np.minimum(np.sqrt(x), reach)
    low = np.maximum(0.0, np.sqrt(s) - 7.0)
    log_gamma = _lgamma(s)

    def density(t: np.ndarray) -> np.ndarray:
        u = t + low[:, None]
        return 2 * np.exp(_times_log(2 * s - 1, u) - u * u - log_gamma[:, None])

    return np.clip(_integral(density, np.maximum(0.0, upper - low)), 0, 1)


def t_share(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    with np.errstate(invalid="ignore", over="ignore"):
        tail = 0.5 * beta_share(np.where(np.isinf(df), 1.0, df) / 2, 0.5, np.where(np.isinf(df), 0.0, df / (df + t * t)))
    out = np.where(t > 0, 1 - tail, tail)
    return np.where(np.isinf(df) | (df > 1e5), phi(t), out)


def _bisected(share, p: np.ndarray, rounds: int = 90) -> np.ndarray:
    """Where a growing function reaches each probability."""
    low, high = np.full(len(p), -1.0), np.full(len(p), 1.0)
    for _ in range(60):
        low, high = np.where(share(low) > p, low * 2, low), np.where(share(high) < p, high * 2, high)
    for _ in range(rounds):
        mid = (low + high) / 2
        below = share(mid) < p
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return (low + high) / 2


def _batch(f):
    """A function of arrays as a pandas UDF; NULL in, NULL out."""

    def run(*columns: pd.Series) -> pd.Series:
        values = [c.to_numpy(float, na_value=np.nan) for c in columns]
        out, known = np.full(len(values[0]), np.nan), ~np.any(np.isnan(values), axis=0)
        if known.any():
            once, back = np.unique(np.stack([v[known] for v in values]), axis=1, return_inverse=True)
            out[known] = f(*once)[back]
        return pd.Series(out).astype(object).where(known, None).astype("Float64")

    return run


@F.pandas_udf(T.DoubleType())
def norm_ppf(p: pd.Series) -> pd.Series:
    """Standard normal quantile; NULL outside (0, 1)."""
    inverse = NormalDist().inv_cdf
    return p.map(lambda x: inverse(x) if pd.notna(x) and 0 < x < 1 else None).astype("float64")


@F.pandas_udf(T.DoubleType())
def t_cdf(t: pd.Series, df: pd.Series) -> pd.Series:
    """Student t distribution function."""
    return _batch(t_share)(t, df)


@F.pandas_udf(T.DoubleType())
def t_ppf(p: pd.Series, df: pd.Series) -> pd.Series:
    """Student t quantile."""
    return _batch(lambda q, k: _bisected(lambda t: t_share(t, k), q))(p, df)


@F.pandas_udf(T.DoubleType())
def chi2_sf(x: pd.Series, df: pd.Series) -> pd.Series:
    """Upper tail of the chi-squared distribution."""
    return _batch(lambda v, k: 1 - gamma_share(k / 2, v / 2))(x, df)


@F.pandas_udf(T.DoubleType())
def f_sf(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    """Upper tail of the F distribution."""
    return _batch(lambda v, a, b: np.where(v <= 0, 1.0, beta_share(b / 2, a / 2, b / (b + a * np.maximum(v, 0)))))(f, df1, df2)


def two_sided(t: float, df: float = math.inf) -> float:
    """Two-sided tail of a Student t statistic on the driver, the normal one for infinitely many degrees."""
    return float(min(1.0, 2 * (1 - t_share(np.array([abs(t)]), np.array([df]))[0])))


def chi2_tail(x: float, df: int) -> float:
    return float(1 - gamma_share(np.array([df / 2]), np.array([x / 2]))[0])


def f_tail(f: float, df1: int, df2: int) -> float:
    return 1.0 if f <= 0 else float(beta_share(np.array([df2 / 2]), np.array([df1 / 2]), np.array([df2 / (df2 + df1 * f)]))[0])


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)
