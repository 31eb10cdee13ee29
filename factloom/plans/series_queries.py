"""Queries on forecasting and estimation, each with its oracle where SQL has one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from factloom.operators import series
from factloom.plans.evidence_queries import MONTHS, monthly
from factloom.plans.tables import read

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"""SELECT p, y, m, LAG(v::DOUBLE) OVER w AS persistence, LAG(v::DOUBLE, 12) OVER w AS seasonal_naive, ROUND((SUM(v) OVER q)::DOUBLE / COUNT(v) OVER q, 4) AS historical_mean,
ROUND(CASE WHEN COUNT(v) OVER q > 1 THEN (LAG(v) OVER w)::DOUBLE + (LAG(v) OVER w - FIRST_VALUE(v) OVER q)::DOUBLE / (COUNT(v) OVER q - 1) END, 4) AS drift
FROM {MONTHS} WINDOW w AS (PARTITION BY p ORDER BY y, m), q AS (PARTITION BY p ORDER BY y, m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def baseline_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = series.baselines(monthly(spark, sf_dir), ["p"], ["y", "m"], "v", 12)
    return out.select("p", "y", "m", F.col("persistence").cast("double").alias("persistence"), F.col("seasonal_naive").cast("double").alias("seasonal_naive"), F.round("historical_mean", 4).alias("historical_mean"), F.round("drift", 4).alias("drift"))


def _monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monthly(spark, sf_dir).select("p", (F.col("y") * 12 + F.col("m")).alias("t"), F.col("v").cast("double").alias("v"))


@query()
def ar_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.autoregression(_monthly(spark, sf_dir), "p", "t", "v", 2).select("key", "n", F.round("forecast", 2).alias("forecast"))


@query()
def local_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.local_level(_monthly(spark, sf_dir), "p", "t", "v", 0.1).select("key", "at", F.round("level", 2).alias("level"))


@query()
def logistic_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_quantity") / 50).alias("q"), "l_discount")
    fit = series.glm(rows, "y", ["q", "l_discount"])
    return spark.createDataFrame([(k, round(v, 6)) for k, v in fit.items()], "name string, value double")


@query()
def ppml(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select("l_quantity", "l_discount", "l_tax")
    fit = series.glm(rows, "l_quantity", ["l_discount", "l_tax"], "poisson")
    return spark.createDataFrame([(k, round(v, 6)) for k, v in fit.items()], "name string, value double")


@query()
def dm_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = series.baselines(_monthly(spark, sf_dir), ["p"], ["t"], "v", 12).where("seasonal_naive is not null")
    losses = rows.groupBy("t").agg(F.avg(F.abs(F.col("v") - F.col("historical_mean"))).alias("a"), F.avg(F.abs(F.col("v") - F.col("persistence"))).alias("b"))
    got = series.diebold_mariano(losses, "t", "a", "b", 3)
    return spark.createDataFrame([(k, round(float(v), 6)) for k, v in got.items()], "name string, value double")


@query()
def block_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = read(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").alias("t")).agg(F.sum("o_totalprice").alias("v"))
    return series.block_bootstrap(daily, "t", "v", 20, 200).withColumn("mean", F.round("mean", 2))
