"""Scores of forecasts and bounds on their errors, as aggregations and windows within a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def crps_ensemble(rows: DataFrame, key: list[str], sample: str, actual: str) -> DataFrame:
    """``(*key, crps)`` of the samples of each key against its outcome, in the energy form from one sort."""
    by = W.partitionBy(*key)
    ranked = rows.withColumns({"_i": F.row_number().over(by.orderBy(sample)), "_n": F.count("*").over(by)})
    n = F.max("_n").cast("double")
    near = F.sum(F.abs(F.col(sample) - F.col(actual))) / n
    apart = F.sum((2 * F.col("_i") - F.col("_n") - 1) * F.col(sample)) / (n * n)
    return ranked.groupBy(*key).agg((near - apart).alias("crps"))


def pinball(actual: Column, forecast: Column, tau: float) -> Column:
    return F.greatest(tau * (actual - forecast), (tau - 1) * (actual - forecast))


def crps_from_quantiles(actual: Column, quantiles: dict[float, Column]) -> Column:
    """Twice the mean pinball loss over stated quantiles."""
    return 2 * sum((pinball(actual, q, tau) for tau, q in quantiles.items()), F.lit(0.0)) / len(quantiles)


def brier(rows: DataFrame, key: list[str], p: str, outcome: str, reference: str) -> DataFrame:
    """``(*key, n, brier, skill)``: mean squared error of probabilities, and its gain over a reference's."""
    own, ref = F.avg(F.pow(F.col(p) - F.col(outcome), 2)), F.avg(F.pow(F.col(reference) - F.col(outcome), 2))
    return rows.groupBy(*key).agg(F.count("*").alias("n"), own.alias("brier"), F.when(ref > 0, 1 - own / ref).alias("skill"))


def mase_scale(rows: DataFrame, key: list[str], time: str, value: str, season: int = 1) -> DataFrame:
    """``(*key, scale)``: mean absolute difference to the value a season of places before."""
    w = W.partitionBy(*key).orderBy(time)
    return rows.withColumn("_d", F.abs(F.col(value) - F.lag(value, season).over(w))).groupBy(*key).agg(F.avg("_d").alias("scale"))


def mase(rows: DataFrame, key: list[str], time: str, value: str, season: int = 1) -> DataFrame:
    """``(*key, scale, mae, mase)`` of forecasting each value by the one before it; NULL over a scale of 0."""
    w = W.partitionBy(*key).orderBy(time)
    d = rows.withColumns({"_s": F.abs(F.col(value) - F.lag(value, season).over(w)), "_e": F.abs(F.col(value) - F.lag(value, 1).over(w))})
    out = d.groupBy(*key).agg(F.avg("_s").alias("scale"), F.avg("_e").alias("mae"))
    return out.withColumn("mase", F.when(F.col("scale") > 0, F.col("mae") / F.col("scale")))


def conformal_quantiles(rows: DataFrame, key: list[str], error: str, levels: dict[str, float]) -> DataFrame:
    """Per key the error of rank ceil((n + 1) tau) for tau of a half or more, else floor((n + 1) tau), within 1 and n."""
    by = W.partitionBy(*key)
    ranked = rows.where(F.col(error).isNotNull()).withColumns({"_i": F.row_number().over(by.orderBy(error)), "_n": F.count("*").over(by)})

    def rank(tau: float) -> Column:
        at = F.ceil((F.col("_n") + 1) * tau - 1e-9) if tau >= 0.5 else F.floor((F.col("_n") + 1) * tau + 1e-9)
        return F.greatest(F.lit(1), F.least(F.col("_n"), at))

    return ranked.groupBy(*key).agg(*[F.max(F.when(F.col("_i") == rank(tau), F.col(error))).alias(name) for name, tau in levels.items()])


def standardized_errors(rows: DataFrame, key: list[str], time: str, error: str, window: int) -> DataFrame:
    """Errors over the root mean square of the ``window`` errors before them; those without a full window or scale are left out."""
    w = W.partitionBy(*key).orderBy(time).rowsBetween(-window, -1)
    scaled = rows.withColumns({"_s": F.sqrt(F.avg(F.col(error) * F.col(error)).over(w)), "_c": F.count(error).over(w)})
    return scaled.where((F.col("_c") == window) & (F.col("_s") > 0)).withColumn("z", F.col(error) / F.col("_s")).drop("_s", "_c")


def diebold_mariano(losses: DataFrame, time: str, model: str, baseline: str, horizon: int = 1, alternative: str = "less", corrected: bool = True) -> dict:
    """Test of equal expected loss of two forecasts at integer periods, with the small-sample correction.

    Autocovariances are equi-joins on the period, so that a long series is spread over tasks; a negative long-run variance falls
    back to falling weights.
    """
    import math

    from factloom.functions.distributions import t_share

    d = losses.where(F.col(model).isNotNull() & F.col(baseline).isNotNull()).select(F.col(time).alias("t"), (F.col(model) - F.col(baseline)).cast("double").alias("d"))
    got = d.agg(F.count("*").alias("n"), F.avg("d").alias("mean")).first()
    n, mean = got["n"], got["mean"]
    if n < 3:
        raise ValueError("at least three forecasts are needed")

    def gamma(k: int) -> float:
        later = d.select((F.col("t") + k).alias("t"), F.col("d").alias("e"))
        return (d.join(later, "t").agg(F.sum((F.col("d") - mean) * (F.col("e") - mean))).first()[0] or 0.0) / n

    g = [gamma(k) for k in range(horizon)]
    variance = g[0] + 2 * sum(g[1:])
    if variance <= 0:
        variance = g[0] + 2 * sum((1 - k / horizon) * v for k, v in enumerate(g) if k)
    if variance <= 0:
        return {"statistic": None, "p": None, "mean": mean, "n": n}
    stat = mean / math.sqrt(variance / n)
    if corrected:
        stat *= math.sqrt((n + 1 - 2 * horizon + horizon * (horizon - 1) / n) / n)
    below = float(t_share([stat], [n - 1 if corrected else math.inf])[0])
    p = {"less": below, "greater": 1 - below, "two-sided": min(1.0, 2 * min(below, 1 - below))}[alternative]
    return {"statistic": stat, "p": p, "mean": mean, "n": n}
