"""Distances, losses and combinations of weights."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6371.0088 * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def noisy_or(weights: Column) -> Column:
    """1 minus the product of (1 - w) over an array."""
    return 1 - F.aggregate(weights, F.lit(1.0), lambda a, w: a * (1 - w))


def effective_number(weights: Column) -> Column:
    """Exponential of the entropy of the shares of an array of weights."""
    total = F.aggregate(weights, F.lit(0.0), lambda a, w: a + w)
    return F.exp(-F.aggregate(F.filter(weights, lambda w: w > 0), F.lit(0.0), lambda a, w: a + w / total * F.log(w / total)))


def poisson_binomial(p: Column) -> Column:
    """Array of the probabilities of 0, 1, ... successes in independent trials."""
    grow = lambda d, q: F.transform(F.sequence(F.lit(0), F.size(d)), lambda k: F.coalesce(F.get(d, k), F.lit(0.0)) * (1 - q) + F.when(k > 0, F.get(d, k - 1)).otherwise(0.0) * q)
    return F.aggregate(p, F.array(F.lit(1.0)), grow)


def gaussian_log_score(actual: Column, mean: Column, sd: Column) -> Column:
    return 0.5 * F.log(2 * math.pi * sd * sd) + F.pow(actual - mean, 2) / (2 * sd * sd)


def logistic(z: Column) -> Column:
    e = F.exp(-F.abs(z))
    return F.when(z >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def _phi(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.vectorize(math.erf)(x / math.sqrt(2)))


@F.pandas_udf(T.DoubleType())
def norm_cdf(x: pd.Series) -> pd.Series:
    """Standard normal distribution function."""
    return pd.Series(_phi(x.to_numpy(float)) if len(x) else [], dtype="float64")


@F.pandas_udf(T.DoubleType())
def crps_gaussian(actual: pd.Series, mean: pd.Series, sd: pd.Series) -> pd.Series:
    """Continuous ranked probability score of a normal forecast."""
    z = ((actual - mean) / sd).to_numpy(float)
    density = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    return pd.Series(sd.to_numpy(float) * (z * (2 * _phi(z) - 1) + 2 * density - 1 / math.sqrt(math.pi)) if len(z) else [], dtype="float64")
