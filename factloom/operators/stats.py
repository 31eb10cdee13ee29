"""Scores, calibration, rankings, concentration and difference-in-differences, as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from factloom.operators.temporal import average_rank


def forecast_scores(rows: DataFrame, key: list[str], level_z: float = 1.2815515655446004) -> DataFrame:
    """MAE, RMSE, bias, interval coverage and width of forecasts ``(mean, sd, actual)``."""
    e = F.col("mean") - F.col("actual")
    inside = (F.abs(e) <= level_z * F.col("sd")).cast("double")
    return rows.groupBy(*key).agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"), F.avg(inside).alias("coverage"), F.avg(2 * level_z * F.col("sd")).alias("width"), F.count("*").alias("n"))


def pinball(quantile: float, forecast: Column, actual: Column) -> Column:
    return F.greatest(quantile * (actual - forecast), (quantile - 1) * (actual - forecast))


def calibration_curve(rows: DataFrame, bins: int) -> DataFrame:
    """Mean predicted and observed per equal-width bin of ``(p, y)``."""
    b = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("long")
    return rows.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("predicted"), F.avg(F.col("y").cast("double")).alias("observed"))


def spearman(rows: DataFrame, key: list[str], x: str, y: str) -> DataFrame:
    ranked = rows.withColumns({"_x": average_rank(x, key), "_y": average_rank(y, key)})
    return ranked.groupBy(*key).agg(F.corr("_x", "_y").alias("rho"), F.count("*").alias("n"))


def top_k_capture(rows: DataFrame, key: list[str], score: str, outcome: str, tie: str, k: int) -> DataFrame:
    """Share of the top k by outcome that are in the top k by score, and the lift of their mean outcome."""
    by = W.partitionBy(*key)
    r = rows.withColumns({"_s": F.row_number().over(by.orderBy(F.desc(score), tie)), "_o": F.row_number().over(by.orderBy(F.desc(outcome), tie))})
    both = F.count_if((F.col("_s") <= k) & (F.col("_o") <= k))
    lift = F.avg(F.when(F.col("_s") <= k, F.col(outcome))) - F.avg(outcome)
    return r.groupBy(*key).agg((both / F.least(F.lit(k), F.count("*"))).alias("capture"), lift.alias("lift"))


def concentration(edges: DataFrame) -> DataFrame:
    """Per object: inflow, number of sources, Herfindahl index and share of the largest source."""
    pair = edges.groupBy("object", "subject").agg(F.sum("weight").alias("w"))
    total = F.sum("w")
    return pair.groupBy("object").agg(total.alias("inflow"), F.count("*").alias("sources"), (F.sum(F.col("w") * F.col("w")) / (total * total)).alias("hhi"), (F.max("w") / total).alias("top_share"))


def shift_share(cells: DataFrame) -> DataFrame:
    """Per region the sum of base shares times log growth elsewhere; cells are ``(region, industry, base, later)``."""
    ind, reg = W.partitionBy("industry"), W.partitionBy("region")
    c = cells.withColumns({"_b": F.sum("base").over(ind) - F.col("base"), "_l": F.sum("later").over(ind) - F.col("later"), "_r": F.sum("base").over(reg)})
    grown = c.where("_b > 0 and _l > 0 and _r > 0")
    return grown.groupBy("region").agg(F.sum(F.col("base") / F.col("_r") * F.log(F.col("_l") / F.col("_b"))).alias("shock"))


def failure_regions(rows: DataFrame, dimensions: list[str], bins: int, least: int) -> DataFrame:
    """Failure rate by equal-width bin of each dimension, in one pass over the rows after their ranges."""
    spans = rows.agg(*[F.min(d).alias(f"lo_{d}") for d in dimensions], *[F.max(d).alias(f"hi_{d}") for d in dimensions]).first()

    def number(d: str) -> Column:
        lo, hi = spans[f"lo_{d}"], spans[f"hi_{d}"]
        if lo is None or lo == hi:
            return F.lit(0).cast("long")
        return F.least(F.floor((F.col(d) - float(lo)) * bins / (float(hi) - float(lo))), F.lit(bins - 1)).cast("long")

    cells = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), number(d).alias("bin")) for d in dimensions]))
    return rows.select("failed", cells.alias("c")).groupBy("c.dimension", "c.bin").agg(F.count("*").alias("n"), F.avg(F.col("failed").cast("double")).alias("rate")).where(F.col("n") >= least)


def regret_ranking(outcomes: DataFrame) -> DataFrame:
    """Policies by expected, worst and largest regret over scenarios; outcomes are ``(policy, scenario, p, value)``."""
    best = W.partitionBy("scenario")
    r = outcomes.withColumn("_regret", F.max("value").over(best) - F.col("value"))
    return r.groupBy("policy").agg((F.sum(F.col("p") * F.col("value")) / F.sum("p")).alias("expected"), F.min("value").alias("worst"), F.max("_regret").alias("max_regret"))


def coverage_of_population(keys: DataFrame, members: DataFrame) -> DataFrame:
    """How much of a population a dataset's distinct keys cover, and how many lie outside it."""
    k = keys.select("key").distinct().withColumn("_k", F.lit(1))
    m = members.select("key").distinct().withColumn("_m", F.lit(1))
    both = k.join(m, "key", "full_outer")
    inside = F.count_if(F.col("_k").isNotNull() & F.col("_m").isNotNull())
    return both.agg(F.count("_k").alias("measured"), F.count("_m").alias("population"), inside.alias("covered"), F.count_if(F.col("_m").isNull()).alias("outside")).withColumn("share", F.try_divide(F.col("covered").cast("double"), F.col("population")))


def column_quantiles(rows: DataFrame, key: list[str], value: str, qs: list[float]) -> DataFrame:
    """Linear-interpolation quantiles per key."""
    return rows.groupBy(*key).agg(*[F.percentile(value, q).alias(f"q{int(q * 100)}") for q in qs])
