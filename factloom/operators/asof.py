"""Point-in-time reading: what was valid at one time, as known at another, and what had to be left out.

A NULL publication date means unknown. Unknown records are excluded by default and counted by dataset.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def at(value: str) -> Column:
    return F.lit(value).cast("timestamp_ntz")


def rule_publication(valid_from: Column, valid_to: Column, lag_months: Column) -> Column:
    """End of the month in which the reference period's end plus a declared lag falls."""
    return F.last_day(F.add_months(F.coalesce(valid_to, valid_from).cast("date"), lag_months)).cast("timestamp_ntz")


def publication(available_at: Column, realtime_start: Column, current_vintage: Column, by_rule: Column) -> tuple[Column, Column]:
    """Publication date and its source: stated date, first vintage (unless it only says when it was retrieved), rule."""
    realtime = F.when(~F.coalesce(current_vintage, F.lit(False)), realtime_start)
    date = F.coalesce(available_at, realtime, by_rule)
    source = F.when(available_at.isNotNull(), "available_at").when(realtime.isNotNull(), "realtime_start").when(by_rule.isNotNull(), "rule")
    return date, source


def edge_weight(*candidates: Column) -> Column:
    """The first finite number among the candidates, else 1."""
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)
    return F.coalesce(*[finite(c.cast("double")) for c in candidates], F.lit(1.0))


@dataclass(frozen=True)
class AsOf:
    """A reading policy: valid time, knowledge time, and whether unknown publication is let in."""

    valid_at: str | None = None
    known_at: str | None = None
    include_unknown: bool = False

    def valid(self) -> Column:
        if self.valid_at is None:
            return F.lit(True)
        v = at(self.valid_at)
        return (F.col("valid_from").isNull() | (F.col("valid_from") <= v)) & (F.col("valid_to").isNull() | (F.col("valid_to") > v))

    def known(self) -> Column:
        if self.known_at is None:
            return F.lit(True)
        seen = F.col("published_at").isNotNull() & (F.col("published_at") <= at(self.known_at))
        return seen | F.col("published_at").isNull() if self.include_unknown else seen

    def read(self, records: DataFrame) -> DataFrame:
        return records.where(self.valid() & self.known())

    def withheld(self, records: DataFrame) -> DataFrame:
        """Records that only their unknown publication date keeps out."""
        if self.known_at is None or self.include_unknown:
            return records.where(F.lit(False))
        return records.where(self.valid() & F.col("published_at").isNull())

    def report(self, records: DataFrame) -> DataFrame:
        """``(dataset, n_withheld)``."""
        return self.withheld(records).groupBy("dataset").agg(F.count("*").alias("n_withheld"))


def publication_coverage(records: DataFrame) -> DataFrame:
    """Dated and undated records by dataset, and in all (dataset NULL), with the dated share."""
    counts = records.rollup("dataset").agg(F.count("*").alias("n"), F.count("published_at").alias("dated"), F.min("published_at").alias("first_date"), F.max("published_at").alias("last_date"))
    return counts.withColumn("share", F.round(F.try_divide(F.col("dated").cast("double"), F.col("n")), 6))


def latest_known(records: DataFrame, key: list[str], value: str, known_at: str, *ties: str) -> DataFrame:
    """Per key the value last published by ``known_at``; ties go to the larger tie columns."""
    order = F.struct("published_at", *ties, value)
    return records.where(F.col("published_at") <= at(known_at)).groupBy(*key).agg(F.max(order).alias("_m")).select(*key, F.col(f"_m.{value}").alias(value), F.col("_m.published_at").alias("published_at"))


def asof_join(left: DataFrame, right: DataFrame, key: list[str], left_time: str, right_time: str, values: list[str], max_age: str | None = None, bucket_days: int | None = None) -> DataFrame:
    """Each left row with the last right row at or before it, no older than ``max_age`` (an interval).

    One sort of the union by key and time, and a running last value: no pair is formed, so a key's cost is the
    number of its rows. With ``bucket_days`` (and a max age no longer than it) keys are split by time: right rows also go to
    the next bucket, which bounds a hot key's rows in a task.
    """
    payload = F.struct(F.col(right_time).alias("t"), *[F.col(v) for v in values])
    lt = left.withColumns({"_t": F.col(left_time), "_side": F.lit(1)})
    rt = right.select(*key, F.col(right_time).alias("_t"), payload.alias("_p"), F.lit(0).alias("_side"))
    part = list(key)
    if bucket_days:
        number = F.floor(F.unix_seconds(F.col("_t").cast("timestamp")) / (86_400 * bucket_days))
        lt = lt.withColumn("_b", number)
        rt = rt.withColumn("_b", F.explode(F.array(number, number + 1)))
        part.append("_b")
    order = W.partitionBy(*part).orderBy("_t", "_side", "_p").rowsBetween(W.unboundedPreceding, 0)
    merged = lt.withColumn("_p", F.lit(None).cast(rt.schema["_p"].dataType)).unionByName(rt, allowMissingColumns=True)
    found = merged.withColumn("_p", F.last("_p", ignorenulls=True).over(order)).where("_side = 1")
    fresh = F.lit(True) if max_age is None else F.col("_p.t") >= F.col("_t") - F.expr(f"interval {max_age}")
    return found.select(*left.columns, *[F.when(fresh, F.col(f"_p.{v}")).alias(v) for v in values], F.when(fresh, F.col("_p.t")).alias(f"{right_time}_used"))


def interval_join(points: DataFrame, spans: DataFrame, key: list[str], time: str, start: str, end: str, width_days: int) -> DataFrame:
    """Points with the half-open spans that hold them, by an equi-join on key and time bucket.

    A span goes to every bucket of ``width_days`` that it touches among those of the points, a point to one, so each pair is
    found once. A NULL start or end leaves the span open on that side.
    """
    number = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / (86_400 * width_days))
    p = points.withColumn("_b", number(time))
    reach = p.agg(F.min("_b").alias("lo"), F.max("_b").alias("hi")).first()
    lo, hi = (F.lit(reach["lo"] or 0), F.lit(reach["hi"] or 0))
    first, last = F.greatest(F.coalesce(number(start), lo), lo), F.least(F.coalesce(number(end), hi), hi)
    live = spans.where(F.col(start).isNull() | F.col(end).isNull() | (F.col(start) < F.col(end))).withColumns({"_f": first, "_l": last}).where("_f <= _l")
    s = live.withColumn("_b", F.explode(F.sequence("_f", "_l"))).drop("_f", "_l")
    inside = (F.col(start).isNull() | (F.col(time) >= F.col(start))) & (F.col(end).isNull() | (F.col(time) < F.col(end)))
    return p.join(s, [*key, "_b"]).where(inside).drop("_b")
