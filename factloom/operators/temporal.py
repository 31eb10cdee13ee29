"""Vintages, calendar aggregation and window analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def vintages(facts: DataFrame, key: list[str], value: str, time: str) -> DataFrame:
    """Change points of a fact: the first report and each restatement, with how often each was confirmed."""
    w = W.partitionBy(*key).orderBy(time, value)
    changed = facts.withColumn("_new", F.coalesce(~F.col(value).eqNullSafe(F.lag(value).over(w)), F.lit(True)) | (F.row_number().over(w) == 1))
    runs = changed.withColumn("run", F.sum(F.col("_new").cast("long")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    out = runs.groupBy(*key, "run").agg(F.min(time).alias("available_at"), F.first(value).alias(value), (F.count("*") - 1).alias("confirmations"))
    return out.withColumn("status", F.when(F.col("run") == 1, "first_report").otherwise("restated"))


def first_release(facts: DataFrame, key: list[str], value: str, time: str) -> DataFrame:
    """The earliest value of a fact and whether later ones differ."""
    m = F.min(F.struct(time, value))
    return facts.groupBy(*key).agg(m.alias("_m"), (F.count_distinct(value) > 1).alias("revised")).select(*key, F.col(f"_m.{value}").alias("first_value"), F.col(f"_m.{time}").alias("first_at"), "revised")


def resample(points: DataFrame, key: list[str], time: str, value: str, period: str, cutoff: str) -> DataFrame:
    """Mean, sum and last value of each whole period that ended by the cutoff."""
    start = F.date_trunc(period, time)
    last = F.max(F.struct(time, value))
    grouped = points.groupBy(*key, start.cast("date").alias("period")).agg(F.avg(value).alias("mean"), F.sum(value).alias("total"), last.alias("_l"), F.count("*").alias("n"))
    whole = F.add_months("period", {"month": 1, "quarter": 3, "year": 12}[period]) <= F.lit(cutoff).cast("date")
    return grouped.where(whole).select(*key, "period", "mean", "total", F.col(f"_l.{value}").alias("last"), "n")


def ytd_to_discrete(ytd: DataFrame, key: list[str], end: str, value: str) -> DataFrame:
    """Year-to-date amounts to amounts of each period."""
    w = W.partitionBy(*key).orderBy(end)
    return ytd.withColumn("discrete", F.col(value) - F.coalesce(F.lag(value).over(w), F.lit(0)))


def trailing_rms(rows: DataFrame, key: list[str], order: list[str], error: str, window: int) -> DataFrame:
    """Root mean square of the last ``window`` errors, NULL until there are as many."""
    w = W.partitionBy(*key).orderBy(*order).rowsBetween(-(window - 1), 0)
    full = F.count(error).over(w) == window
    return rows.withColumn("rms", F.when(full, F.sqrt(F.avg(F.col(error) * F.col(error)).over(w))))


def split_by_rank(rows: DataFrame, order: list[str], parts: int, key: list[str] | None = None) -> DataFrame:
    """Near-equal groups ``floor(i * parts / n)`` of rows in order, within each key."""
    by = W.partitionBy(*(key or []))
    return rows.withColumn("part", F.floor((F.row_number().over(by.orderBy(*order)) - 1) * parts / F.count("*").over(by)).cast("long"))


def average_rank(value: str, key: list[str] | None = None) -> Column:
    """Ranks from 1, ties sharing their mean."""
    by = W.partitionBy(*(key or []))
    return F.rank().over(by.orderBy(value)) + (F.count("*").over(W.partitionBy(*(key or []), value)) - 1) / 2


def headline(rows: DataFrame, key: list[str], detail: str, time: str, *ties: str) -> DataFrame:
    """Per key the least detailed, then latest row."""
    w = W.partitionBy(*key).orderBy(F.asc(detail), F.desc(time), *[F.asc(t) for t in ties])
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def discounted(rows: DataFrame, key: list[str], weight: str, factor: float, *ties: str) -> DataFrame:
    """The k-th largest weight of a key times ``factor ** k``, k from 0."""
    k = F.row_number().over(W.partitionBy(*key).orderBy(F.desc(weight), *ties)) - 1
    return rows.withColumn("discounted", F.col(weight) * F.pow(F.lit(factor), k))


def seasonal_difference(rows: DataFrame, key: list[str], order: list[str], value: str, season: int = 1, log: bool = False) -> DataFrame:
    v = F.log(F.col(value)) if log else F.col(value)
    return rows.withColumn("_v", v).withColumn("diff", F.col("_v") - F.lag("_v", season).over(W.partitionBy(*key).orderBy(*order))).drop("_v")


def complete_years(rows: DataFrame, key: list[str], time: str, value: str, months: int = 12) -> DataFrame:
    """Year means of the years that have every month."""
    y = F.year(time)
    mean = F.sum(value).cast("double") / F.count(value)  # exact where the value is a decimal
    return rows.groupBy(*key, y.alias("year")).agg(F.count_distinct(F.month(time)).alias("months"), mean.alias("mean")).where(F.col("months") == months).drop("months")
