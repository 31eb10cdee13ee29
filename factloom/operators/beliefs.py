"""What is believed, from claims that contradict each other.

Claims are ``(id, subject, variable, value, dataset, observed_at, valid_from, valid_to)``, optionally with
``retracts`` and ``supersedes`` (arrays of ids) and ``missing_reason``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from factloom.operators.asof import AsOf, at


def standing(claims: DataFrame, known_at: str) -> DataFrame:
    """Claims observed by ``known_at`` that no claim observed by then retracts or supersedes."""
    seen = claims.where(F.col("observed_at") <= at(known_at))
    gone = None
    for c in ("retracts", "supersedes"):
        if c in claims.columns:
            ids = seen.select(F.explode(c).alias("id"))
            gone = ids if gone is None else gone.unionByName(ids)
    return seen if gone is None else seen.join(gone.distinct(), "id", "left_anti")


def priority(order: list[str]) -> Column:
    """Place of a dataset in a list, unlisted ones last."""
    place = F.array_position(F.array(*[F.lit(o) for o in order]), F.col("dataset"))
    return F.when(place == 0, len(order) + 1).otherwise(place)


def reconcile(claims: DataFrame, key: list[str], valid_at: str, known_at: str, policy: str = "retain", order: list[str] | None = None) -> DataFrame:
    """Per key ``status`` (resolved or conflicting), the value if it is one, and the number of claims and values.

    Policies: ``retain`` all claims, the ``latest`` observed, or those of the first dataset by ``source_priority``.
    """
    live = standing(AsOf(valid_at=valid_at).read(claims), known_at).where("value is not null")
    rank = {"latest": F.desc("observed_at"), "source_priority": priority(order or [])}.get(policy)
    if rank is not None:
        live = live.withColumn("_r", F.dense_rank().over(W.partitionBy(*key).orderBy(rank))).where("_r = 1")
    found = live.groupBy(*key).agg(F.count("*").alias("claims"), F.count_distinct("value").alias("kinds"), F.min("value").alias("_v"))
    one = F.col("kinds") == 1
    return found.select(*key, F.when(one, "resolved").otherwise("conflicting").alias("status"), F.when(one, F.col("_v")).alias("value"), "claims", "kinds")


def latest_beliefs(claims: DataFrame, key: list[str], known_at: str) -> DataFrame:
    """The value of the latest standing claim, its age in days, and the share of claims that differ from it."""
    live = standing(claims, known_at)
    best = live.groupBy(*key).agg(F.max(F.struct("observed_at", "id", "value")).alias("_m"))
    joined = live.join(best, key)
    differs = F.when(F.col("value").eqNullSafe(F.col("_m.value")), 0).otherwise(1)
    out = joined.groupBy(*key).agg(F.first("_m").alias("_m"), F.count("*").alias("claims"), F.sum(differs).alias("differing"))
    return out.select(*key, F.col("_m.value").alias("value"), F.date_diff(F.lit(known_at).cast("date"), F.col("_m.observed_at").cast("date")).alias("age_days"), "claims", (F.col("differing") / F.col("claims")).alias("conflict_share"))


def weighted_beliefs(claims: DataFrame, key: list[str], known_at: str, reliability: dict[str, float], half_life_days: float) -> DataFrame:
    """Mean of standing claims weighted by source reliability and halved every ``half_life_days``."""
    w = F.lit(0.5)
    for name, r in reliability.items():
        w = F.when(F.col("dataset") == name, F.lit(float(r))).otherwise(w)
    age = F.date_diff(F.lit(known_at).cast("date"), F.col("observed_at").cast("date"))
    live = standing(claims, known_at).where("value is not null").withColumn("_w", w * F.pow(F.lit(0.5), age / F.lit(half_life_days)))
    return live.groupBy(*key).agg((F.sum(F.col("value") * F.col("_w")) / F.sum("_w")).alias("value"), F.sum("_w").alias("weight"), F.count("*").alias("claims"))


def identifier_status(claims: DataFrame, valid_at: str) -> DataFrame:
    """Each identifier value at a date: resolved to one subject, ambiguous among several, or expired."""
    now = F.when(AsOf(valid_at=valid_at).valid(), F.col("subject"))
    found = claims.groupBy("namespace", "value").agg(F.count_distinct(now).alias("n"), F.min(now).alias("subject"))
    status = F.when(F.col("n") == 1, "resolved").when(F.col("n") > 1, "ambiguous").otherwise("expired")
    return found.select("namespace", "value", status.alias("status"), F.when(F.col("n") == 1, F.col("subject")).alias("subject"))


def lifecycle(events: DataFrame, births: list[str], deaths: list[str], at_time: str) -> DataFrame:
    """Per entity its first birth, last death and state at a time: unborn, alive or ended."""
    seen = events.where(F.col("occurred_at") <= at(at_time))
    found = seen.groupBy("entity").agg(F.min(F.when(F.col("type").isin(births), F.col("occurred_at"))).alias("born"), F.max(F.when(F.col("type").isin(deaths), F.col("occurred_at"))).alias("ended"), F.count("*").alias("n_events"))
    state = F.when(F.col("born").isNull(), "unborn").when(F.col("ended") > F.col("born"), "ended").otherwise("alive")
    return found.withColumn("state", state)


RULES = ("latest_vintage", "reliability_weighted", "source_priority")


def checked_policy(rule: str, reliability: dict[str, float], default_reliability: float, order: list[str], conflict_share: float, half_life_days: float | None, stale_after_days: float | None) -> None:
    """Raises ``ValueError`` for a policy that can't be applied."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    if any(not 0 < r <= 1 for r in (*reliability.values(), default_reliability)):
        raise ValueError("a reliability must be above 0 and at most 1")
    if rule == "source_priority" and (not order or len(set(order)) < len(order)):
        raise ValueError("source_priority needs a list of distinct sources")
    if not 0 < conflict_share <= 0.5:
        raise ValueError("conflict_share must be above 0 and at most a half")
    if any(v is not None and v <= 0 for v in (half_life_days, stale_after_days)):
        raise ValueError("half-life and staleness must be positive")


def materialize(claims: DataFrame, key: list[str], known_at: str, valid_at: str | None = None, rule: str = "latest_vintage", reliability: dict[str, float] | None = None, default_reliability: float = 0.5, half_life_days: float | None = None, order: list[str] | None = None, conflict_share: float = 0.25, stale_after_days: float | None = None, tolerance: float = 0.0, unit: str | None = None) -> DataFrame:
    """What is believed per key: status, value, leading value, confidence, staleness and the counts behind them.

    Claims may have ``vintage`` (else their observation time), ``unit``, ``retracts``, ``supersedes`` and ``epistemic_status``. A retracted
    claim counts as retracted even if also superseded. Support is chosen by the rule, equal values add their weights, and:

        known         one value, or no other with ``conflict_share`` of the weight or as much weight as the first
        conflicting   otherwise; the value is NULL, ``leading_value`` has the first
        unknown       only missing values, or nothing left
        retracted     everything was retracted

    Numbers within the relative ``tolerance`` of the next smaller one of their key and unit are the same value. With ``unit``, values are
    converted first and those that can't be are counted as ``unconvertible``.
    """
    checked_policy(rule, reliability or {}, default_reliability, order or [], conflict_share, half_life_days, stale_after_days)
    known = at(known_at)
    seen = claims.where(F.col("observed_at") <= known)
    for c, kind in (("unit", "string"), ("vintage", "timestamp_ntz"), ("epistemic_status", "string")):
        if c not in seen.columns:
            seen = seen.withColumn(c, F.lit(None).cast(kind))
    marks = []
    for c, mark in (("retracts", "_retracted"), ("supersedes", "_superseded")):
        if c in seen.columns:
            marks.append((mark, seen.select(F.explode(c).alias("id")).distinct().withColumn(mark, F.lit(True))))
    rows = AsOf(valid_at=valid_at).read(seen).where(F.col("epistemic_status").isNull() | F.col("epistemic_status").isin("observed", "inferred", "retracted"))
    for mark in ("_retracted", "_superseded"):
        ids = dict(marks).get(mark)
        rows = rows.join(ids, "id", "left") if ids is not None else rows.withColumn(mark, F.lit(False))
    retracted = F.coalesce("_retracted", F.lit(False)) | F.coalesce(F.col("epistemic_status") == "retracted", F.lit(False))
    rows = rows.withColumns({"_out": F.when(retracted, "retracted").when(F.coalesce("_superseded", F.lit(False)), "superseded")})
    if unit is not None:
        from factloom.functions.units import convert

        rows = convert(rows, unit)
        same = F.col("unit").isNull() | (F.col("unit") == unit)
        rows = rows.withColumns({"_lost": F.col("value").isNotNull() & ~same & F.col("converted").isNull(), "value": F.when(same, F.col("value")).otherwise(F.col("converted")), "unit": F.lit(unit)}).drop("converted")
    else:
        rows = rows.withColumn("_lost", F.lit(False))
    active = F.col("_out").isNull()
    w = F.lit(float(default_reliability))
    for name, r in (reliability or {}).items():
        w = F.when(F.col("dataset") == name, F.lit(float(r))).otherwise(w)
    rows = rows.withColumn("_vintage", F.coalesce("vintage", "observed_at"))
    if rule == "reliability_weighted" and half_life_days:
        age = F.greatest(F.lit(0.0), F.unix_seconds(known.cast("timestamp")) - F.unix_seconds(F.col("_vintage").cast("timestamp"))) / 86_400
        w = w * F.pow(F.lit(0.5), age / F.lit(float(half_life_days)))
    supported = active & F.col("value").isNotNull()
    rows = rows.withColumns({"_w": w, "_s": supported})
    by = W.partitionBy(*key)
    if rule == "latest_vintage":
        rows = rows.withColumn("_s", F.col("_s") & (F.col("_vintage") == F.max(F.when(F.col("_s"), F.col("_vintage"))).over(by)))
    elif rule == "source_priority":
        rank = priority(order or [])
        rows = rows.withColumn("_r", rank).withColumn("_s", F.col("_s") & (F.col("_r") == F.min(F.when(F.col("_s"), F.col("_r"))).over(by)))
    counts = rows.groupBy(*key).agg(F.count_if(active & F.col("value").isNull() & ~F.col("_lost")).alias("unknown_claims"), F.count_if(F.col("_out") == "retracted").alias("retracted_claims"), F.count_if(F.col("_out") == "superseded").alias("superseded_claims"), F.count_if(F.col("_lost")).alias("unconvertible"), F.max(F.when(F.col("_s"), F.col("_vintage"))).alias("newest_support"))
    support = rows.where("_s")
    if tolerance:
        line = W.partitionBy(*key, "unit").orderBy("value")
        near = F.abs(F.col("value") - F.lag("value").over(line)) <= tolerance * F.greatest(F.abs("value"), F.abs(F.lag("value").over(line)))
        support = support.withColumn("_g", F.when(near, 0).otherwise(1)).withColumn("_g", F.sum("_g").over(line.rowsBetween(W.unboundedPreceding, 0)))
    else:
        support = support.withColumn("_g", F.col("value"))
    values = support.groupBy(*key, "unit", "_g").agg(F.sum("_w").alias("_w"), F.min("value").alias("_v"), F.count("*").alias("_n"))
    total = F.sum("_w").over(by)
    ranked = values.withColumns({"_share": F.col("_w") / total, "_i": F.row_number().over(by.orderBy(F.desc("_w"), "_v", "unit"))})
    first = lambda c: F.max(F.when(F.col("_i") == 1, F.col(c)))
    second = lambda c: F.max(F.when(F.col("_i") == 2, F.col(c)))
    lead = ranked.groupBy(*key).agg(first("_v").alias("leading_value"), first("unit").alias("_unit"), first("_share").alias("confidence"), first("_w").alias("_w1"), second("_share").alias("_s2"), second("_w").alias("_w2"), F.count("*").alias("alternatives"), F.sum("_n").alias("supporting_claims"))
    out = counts.join(lead, key, "left")
    tie = F.abs(F.col("_w1") - F.col("_w2")) <= 1e-9 * F.greatest("_w1", "_w2")
    conflict = F.coalesce((F.col("_s2") >= conflict_share) | tie, F.lit(False))
    status = F.when(F.col("alternatives").isNotNull(), F.when(conflict, "conflicting").otherwise("known")).when(F.col("unknown_claims") > 0, "unknown").when(F.col("retracted_claims") > 0, "retracted").otherwise("unknown")
    stale = F.lit(False) if stale_after_days is None else F.coalesce(F.col("newest_support") < known - F.expr(f"interval {int(stale_after_days * 86_400)} seconds"), F.lit(False))
    return out.withColumn("status", status).select(*key, "status", F.when(F.col("status") == "known", F.col("leading_value")).alias("value"), F.when(F.col("status") == "known", F.col("_unit")).alias("unit"), "leading_value", "confidence", F.coalesce("alternatives", F.lit(0)).alias("alternatives"), F.coalesce("supporting_claims", F.lit(0)).alias("supporting_claims"), "unknown_claims", "retracted_claims", "superseded_claims", "unconvertible", stale.alias("stale"), "newest_support")


def conflicts(claims: DataFrame, beliefs: DataFrame, key: list[str]) -> DataFrame:
    """The claims behind the keys whose belief is conflicting."""
    return claims.join(beliefs.where("status = 'conflicting'").select(*key), key, "left_semi")
