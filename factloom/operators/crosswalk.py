"""Dated n:m code maps, unit and currency conversion.

A crosswalk is a table ``(source, target, weight, valid_from, valid_to)``; a NULL weight means that none was stated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from factloom.operators.asof import AsOf, asof_join


def active(rows: DataFrame, at: str) -> DataFrame:
    return rows.where(AsOf(valid_at=at).valid())


def check_partition(rows: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Sources whose weights are missing or don't sum to one."""
    sums = rows.groupBy("source").agg(F.sum("weight").alias("total"), F.count_if(F.col("weight").isNull()).alias("unweighted"))
    return sums.where((F.col("unweighted") > 0) | (F.abs(F.coalesce("total", F.lit(0.0)) - 1) > tolerance))


def apportion(values: DataFrame, rows: DataFrame, equal_if_unweighted: bool = True) -> tuple[DataFrame, DataFrame]:
    """``(target, value)`` with weights normalised by source, and ``(source, value)`` of what has no target.

    A source with any missing weight is split equally, or left out if that isn't allowed.
    """
    by = W.partitionBy("source")
    blank = F.max(F.col("weight").isNull()).over(by)
    share = F.when(blank, F.lit(1.0) / F.count("*").over(by) if equal_if_unweighted else F.lit(None)).otherwise(F.try_divide(F.col("weight"), F.sum("weight").over(by)))
    shares = rows.select("source", "target", share.alias("share")).where("share is not null")
    mapped = values.join(shares, "source").groupBy("target").agg(F.sum(F.col("value") * F.col("share")).alias("value"))
    return mapped, values.join(shares.select("source").distinct(), "source", "left_anti")


def weighted_mean(values: DataFrame, rows: DataFrame) -> DataFrame:
    """``(target, value)`` of an intensive quantity; values have ``(source, value, mass)``."""
    mass = F.col("mass") * F.col("weight")
    return values.join(rows.where("weight is not null"), "source").groupBy("target").agg(F.try_divide(F.sum(F.col("value") * mass), F.sum(mass)).alias("value"))


def compose(first: DataFrame, second: DataFrame) -> DataFrame:
    """A to C from A to B and B to C: validity intersects, weights multiply. A source's only row without a weight counts as
    1; any other unknown weight stays unknown."""

    def rated(rows: DataFrame) -> DataFrame:
        alone = F.count("*").over(W.partitionBy("source")) == 1
        return rows.withColumn("weight", F.coalesce("weight", F.when(alone, 1.0)))

    b = rated(second).select(F.col("source").alias("target"), F.col("target").alias("end"), F.col("weight").alias("w2"), F.col("valid_from").alias("f2"), F.col("valid_to").alias("t2"))
    joined = rated(first).join(b, "target").withColumns({"from": F.greatest("valid_from", "f2"), "to": F.least("valid_to", "t2"), "w": F.col("weight") * F.col("w2")})
    live = joined.where("from is null or to is null or from < to")
    return live.groupBy("source", F.col("end").alias("target"), F.col("from").alias("valid_from"), F.col("to").alias("valid_to")).agg(F.when(F.count("*") == F.count("w"), F.sum("w")).alias("weight"))


def apportion_report(values: DataFrame, rows: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """One row: what went in, what came out, what has no target, what is left over, and the worst error of equal splits.

    A source split without weights is divided equally; each share may then be off by the larger of it and its rest.
    """
    by = W.partitionBy("source")
    n, blank = F.count("*").over(by), F.max(F.col("weight").isNull()).over(by)
    share = F.when(n == 1, 1.0).when(blank, 1.0 / n).otherwise(F.try_divide(F.col("weight"), F.sum("weight").over(by)))
    shares = rows.select("source", share.alias("share"), (blank & (n > 1)).alias("assumed"))
    joined = values.join(shares, "source", "left")
    lost = joined.where("share is null").agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("unmapped"))
    out = joined.agg(F.coalesce(F.sum(F.col("value") * F.col("share")), F.lit(0.0)).alias("total_out"), F.coalesce(F.sum(F.when(F.col("assumed"), F.abs("value") * F.greatest("share", 1 - F.col("share")))), F.lit(0.0)).alias("error_bound"))
    total = values.agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("total_in"))
    whole = total.join(out).join(lost)  # one row each
    return whole.withColumn("residual", F.col("total_in") - F.col("total_out") - F.col("unmapped")).withColumn("conserved", F.abs("residual") <= F.greatest(F.lit(1e-9), tolerance * F.abs("total_in")))


def targets(rows: DataFrame, code: str, at: str) -> DataFrame:
    """The active targets of one code."""
    return active(rows, at).where(F.col("source") == code)


def exact_translation(rows: DataFrame, rates: DataFrame) -> DataFrame:
    """``(target, rate)`` where every source of the target maps to it alone, all are rated, and rates agree.

    Relational division: sources with several targets and targets with an unrated source are anti-joined.
    """
    pairs = rows.select("source", "target").distinct()
    split = pairs.groupBy("source").agg(F.count("*").alias("n")).where("n > 1").select("source")
    spoiled = pairs.join(split, "source", "left_semi").select("target").distinct()
    whole = pairs.join(spoiled, "target", "left_anti")
    rated = whole.join(rates, "source", "left").groupBy("target").agg(F.count_if(F.col("rate").isNull()).alias("unrated"), F.count_distinct("rate").alias("kinds"), F.min("rate").alias("rate"))
    return rated.where("unrated = 0 and kinds = 1").select("target", "rate")


def one_to_one(rows: DataFrame) -> DataFrame:
    """Pairs that are each other's only partner."""
    pairs = rows.select("source", "target").distinct()
    s = pairs.groupBy("source").agg(F.count("*").alias("a")).where("a = 1").select("source")
    t = pairs.groupBy("target").agg(F.count("*").alias("b")).where("b = 1").select("target")
    return pairs.join(s, "source", "left_semi").join(t, "target", "left_semi").select("source", "target")


def convert_units(values: DataFrame, units: DataFrame, to: str) -> DataFrame:
    """Values in one unit; ``units`` is ``(unit, scale, shift, dimension)`` to base units. Other dimensions give NULL."""
    goal = units.where(F.col("unit") == to).select(F.col("scale").alias("_s"), F.col("shift").alias("_o"), F.col("dimension").alias("_d"))
    joined = values.join(units, "unit", "left").join(F.broadcast(goal.limit(1)), F.col("dimension") == F.col("_d"), "left")
    return joined.withColumn("converted", (F.col("value") * F.col("scale") + F.col("shift") - F.col("_o")) / F.col("_s")).drop("scale", "shift", "dimension", "_s", "_o", "_d")


def rate_paths(rates: DataFrame, source: str, target: str) -> DataFrame:
    """``(at, rate, via)`` per day: the direct rate, the inverse one, or the cross by the first hub that has both legs.

    Rates are ``(base, quote, at, rate)``, units of quote for one of base.
    """
    both = rates.select("base", "quote", "at", "rate", F.lit(0).alias("turned")).unionByName(rates.select(F.col("quote").alias("base"), F.col("base").alias("quote"), "at", (1 / F.col("rate")).alias("rate"), F.lit(1).alias("turned")))
    legs = both.groupBy("base", "quote", "at").agg(F.min_by("rate", "turned").alias("rate"), F.min("turned").alias("turned"))
    direct = legs.where((F.col("base") == source) & (F.col("quote") == target)).select("at", "rate", F.lit("").alias("via"))
    there = legs.where((F.col("base") == source) & (F.col("quote") != target)).select("at", F.col("quote").alias("hub"), F.col("rate").alias("r1"))
    on = legs.where((F.col("quote") == target) & (F.col("base") != source)).select("at", F.col("base").alias("hub"), F.col("rate").alias("r2"))
    cross = there.join(on, ["at", "hub"]).select("at", (F.col("r1") * F.col("r2")).alias("rate"), F.col("hub").alias("via"))
    return direct.unionByName(cross).groupBy("at").agg(F.min(F.struct("via", "rate")).alias("m")).select("at", "m.rate", "m.via")


def convert_currency(amounts: DataFrame, rates: DataFrame, time: str, max_age: str | None, policy: str = "previous", bucket_days: int | None = None) -> DataFrame:
    """Amounts at the rate of their currency: of that very time (``exact``) or the last at or before it (``previous``),
    NULL if there is none or it is older than ``max_age``. ``bucket_days`` splits a hot currency by time."""
    if policy == "exact":
        same = rates.select("currency", F.col("at").alias(time), "rate", F.col("at").alias("rate_at_used"))
        found = amounts.join(same, ["currency", time], "left")
    else:
        found = asof_join(amounts, rates.select("currency", F.col("at").alias("rate_at"), "rate"), ["currency"], time, "rate_at", ["rate"], max_age, bucket_days)
    return found.withColumn("converted", F.col("amount") * F.col("rate"))


def average_rates(rates: DataFrame, periods: DataFrame) -> DataFrame:
    """``(currency, period, rate, observations)``: mean rate of each half-open period ``(period, start, end)``; few periods."""
    joined = rates.join(F.broadcast(periods), (F.col("at") >= F.col("start")) & (F.col("at") < F.col("end")))
    return joined.groupBy("currency", "period").agg(F.avg("rate").alias("rate"), F.count("*").alias("observations"))


def index_levels(index: DataFrame, frequency: str = "monthly") -> DataFrame:
    """``(period, level, observations)`` of a dated index by month (YYYY-MM), quarter (YYYY-Qn) and year (YYYY).

    Quarters and years need all of their observations. ``index`` is ``(at, level)``.
    """
    a_year, a_quarter = {"monthly": (12, 3), "quarterly": (4, 1), "annual": (1, None)}[frequency]
    year = F.year("at").cast("string")
    names = [F.struct(F.date_format("at", "yyyy-MM").alias("period"), F.lit(1).alias("need")), F.struct(year.alias("period"), F.lit(a_year).alias("need"))]
    if a_quarter:
        names.append(F.struct(F.concat(year, F.lit("-Q"), F.quarter("at").cast("string")).alias("period"), F.lit(a_quarter).alias("need")))
    grouped = index.select("level", F.explode(F.array(*names)).alias("p")).groupBy("p.period", "p.need").agg(F.avg("level").alias("level"), F.count("*").alias("observations"))
    return grouped.where(F.col("observations") >= F.col("need")).select("period", "level", "observations")


def deflate(amounts: DataFrame, index: DataFrame, period: str, base) -> DataFrame:
    """Nominal amounts at the prices of a base period; ``index`` is ``(period, level)``."""
    level = index.where(F.col("period") == F.lit(base)).agg(F.max("level").alias("_base"))
    return amounts.join(index.withColumnRenamed("period", period), period, "left").join(F.broadcast(level)).withColumn("real", F.col("amount") * F.col("_base") / F.col("level")).drop("level", "_base")


def rebase(index: DataFrame, base) -> DataFrame:
    """Index levels as a share of a hundred of the base period's."""
    level = index.where(F.col("period") == F.lit(base)).agg(F.max("level").alias("_base"))
    return index.join(F.broadcast(level)).withColumn("level", 100 * F.col("level") / F.col("_base")).drop("_base")


def dated_lookup(codes: DataFrame, scheme: str, to: str, values: DataFrame, at: str) -> DataFrame:
    """``(value, status, code)``: codes of one scheme in another at a date.

    ``codes`` has a row per entity and validity with a column per scheme. Status: resolved, no_equivalent (the entity has none),
    not_found, or ambiguous (several entities).
    """
    now = active(codes, at).where(F.col(scheme).isNotNull()).select(F.col(scheme).alias("value"), F.col(to).alias("code"))
    found = now.groupBy("value").agg(F.count("*").alias("n"), F.count_distinct("code").alias("k"), F.min("code").alias("code"))
    joined = values.select("value").distinct().join(found, "value", "left")
    status = F.when(F.col("n").isNull(), "not_found").when(F.col("n") > 1, "ambiguous").when(F.col("k") == 0, "no_equivalent").otherwise("resolved")
    return joined.select("value", status.alias("status"), F.when(status == "resolved", F.col("code")).alias("code"))


def area_weights(pieces: DataFrame) -> DataFrame:
    """``(source, target, weight)`` from overlap areas: a target's share of its source's area, several pieces added up."""
    whole = pieces.groupBy("source", "target").agg(F.sum("area").alias("area"))
    return whole.select("source", "target", F.try_divide(F.col("area"), F.sum("area").over(W.partitionBy("source"))).alias("weight"))


def change_crosswalk(units: DataFrame, changes: DataFrame, start: str, end: str) -> DataFrame:
    """Codes of a start date in those of an end date: ``(source, target, weight, kind)``.

    Units are ``(code, valid_from, valid_to)``; changes ``(source, target, changed_at, population)`` recode, merge or
    split. A split is weighted by the population that moves; a code without a change maps to itself.
    """
    began = active(units, start).select(F.col("code").alias("source"))
    between = changes.where((F.col("changed_at") > F.lit(start).cast("timestamp_ntz")) & (F.col("changed_at") <= F.lit(end).cast("timestamp_ntz")))
    n = F.count("*").over(W.partitionBy("source"))
    share = F.when(n == 1, 1.0).otherwise(F.try_divide(F.col("population"), F.sum("population").over(W.partitionBy("source"))))
    changed = between.select("source", "target", share.cast("double").alias("weight"), F.when(n > 1, "split").otherwise("recode").alias("kind"))
    joined = began.join(changed, "source", "left")
    return joined.select("source", F.coalesce("target", "source").alias("target"), F.when(F.col("target").isNull(), 1.0).otherwise(F.col("weight")).alias("weight"), F.coalesce("kind", F.lit("same")).alias("kind"))
