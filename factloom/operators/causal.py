"""Difference-in-differences for staggered adoption, placebo tests and scores of rankings.

A panel is ``(unit, period, y, cohort)`` with integer periods and the period of first treatment, NULL if never; columns
``stratum`` and ``cluster`` are optional (one stratum; each unit its own cluster). Effects carry their
influence functions, summed by cluster, as rows ``(cell, cluster, psi)``: variances, joint tests and bootstrap
draws are aggregations of them. A cell is a cohort and a period, so their number is bounded by the calendar, not by the units.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from factloom.functions.distributions import chi2_tail, normal_quantile, two_sided
from factloom.operators.econometrics import demean
from factloom.operators.staging import Staging


def prepared(panel: DataFrame) -> DataFrame:
    """The panel with strata and clusters, without missing outcomes."""
    stratum = F.col("stratum") if "stratum" in panel.columns else F.lit(0)
    cluster = F.col("cluster") if "cluster" in panel.columns else F.col("unit")
    return panel.where("y is not null").select("unit", "period", F.col("y").cast("double").alias("y"), "cohort", stratum.alias("stratum"), cluster.alias("cluster"))


@dataclass
class Effects:
    """Effects by cell and their influence by cluster: ``cells`` (g, t, e, att, n_treated, n_control, dropped), ``influence`` (g, t, cluster, psi, treated)."""

    cells: DataFrame
    influence: DataFrame
    n_clusters: int
    reference: int


def att_gt(panel: DataFrame, staging: Staging, control: str = "not_yet_treated", anticipation: int = 0, min_treated: int = 1, min_control: int = 1, cohorts: list[int] | None = None) -> Effects:
    """Group-time effects against a universal base period, ``g - 1 - anticipation``.

    Controls are the never treated, or also those first treated after ``max(t, base) + anticipation``; within strata,
    weighted by treated units. Strata with too few controls are dropped and counted, cells with too few treated left out.
    """
    if control not in ("not_yet_treated", "never_treated"):
        raise ValueError("control must be not_yet_treated or never_treated")
    p = staging.write(prepared(panel), "panel")
    groups = p.where("cohort is not null").select(F.col("cohort").alias("g")).distinct()
    if cohorts is not None:
        groups = groups.where(F.col("g").isin(cohorts))
    base = p.select("unit", F.col("period").alias("b"), F.col("y").alias("y0"))
    # a row per unit, period and cohort whose base period the unit has: the cohorts are few, at most one a period
    anchors = base.join(groups.withColumn("b", F.col("g") - 1 - anticipation), "b")
    pairs = p.join(anchors, "unit").where("period <> b")
    later = F.col("cohort").isNull() if control == "never_treated" else F.col("cohort").isNull() | (F.col("cohort") > F.greatest("period", "b") + anticipation)
    role = F.when(F.col("cohort") == F.col("g"), 1).when(later, 0)
    diffs = staging.write(pairs.select("g", F.col("period").alias("t"), "stratum", "cluster", "unit", (F.col("y") - F.col("y0")).alias("d"), role.alias("treated")).where("treated is not null"), "differences")
    of = lambda r, c: F.when(F.col("treated") == r, c)
    parts = diffs.groupBy("g", "t", "stratum").agg(F.count(of(1, F.col("d"))).alias("nt"), F.avg(of(1, F.col("d"))).alias("mt"), F.count(of(0, F.col("d"))).alias("nc"), F.avg(of(0, F.col("d"))).alias("mc")).where("nt > 0")
    usable = F.col("nc") >= max(1, min_control)
    total = F.sum(F.when(usable, F.col("nt")))
    cells = parts.groupBy("g", "t").agg(total.alias("n_treated"), F.sum(F.when(usable, F.col("nc"))).alias("n_control"), F.coalesce(F.sum(F.when(~usable, F.col("nt"))), F.lit(0)).alias("dropped"), (F.sum(F.when(usable, F.col("nt") * (F.col("mt") - F.col("mc")))) / total).alias("att"))
    cells = staging.write(cells.where(F.col("n_treated") >= min_treated).withColumn("e", F.col("t") - F.col("g")), "cells")
    known = parts.where(usable).join(cells.select("g", "t", "att", F.col("n_treated").alias("n")), ["g", "t"])
    known = staging.write(known.select("g", "t", "stratum", "nt", "mt", "nc", "mc", "att", "n"), "parts")
    # a treated unit also carries the influence of its stratum's weight
    own = (F.col("d") - F.col("mt") + F.col("mt") - F.col("mc") - F.col("att")) / F.col("n")
    other = -(F.col("nt") / F.col("n")) / F.col("nc") * (F.col("d") - F.col("mc"))
    psi = diffs.join(known, ["g", "t", "stratum"]).groupBy("g", "t", "cluster").agg(F.sum(F.when(F.col("treated") == 1, own).otherwise(other)).alias("psi"), F.sum("treated").alias("treated"))
    return Effects(cells, staging.write(psi, "influence"), p.select("cluster").distinct().count(), -1 - anticipation)


def event_time(effects: Effects, staging: Staging, e_min: int, e_max: int, balance: tuple[int, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """Effects by time since treatment, weighted by treated units: ``(e, att, n_treated, cohorts)`` and ``(e, cluster, psi)``.

    ``balance`` keeps the cohorts that have a cell at every event time of the range but the reference.
    """
    cells = effects.cells.where(F.col("e").between(e_min, e_max))
    if balance:
        lo, hi = balance
        needed = len([e for e in range(lo, hi + 1) if e != effects.reference])
        whole = effects.cells.where(F.col("e").between(lo, hi) & (F.col("e") != effects.reference)).groupBy("g").agg(F.count_distinct("e").alias("k")).where(F.col("k") == needed).select("g")
        cells = cells.join(whole, "g", "left_semi")
    by_e = staging.write(cells.groupBy("e").agg((F.sum(F.col("n_treated") * F.col("att")) / F.sum("n_treated")).alias("att"), F.sum("n_treated").alias("n_treated"), F.array_join(F.array_sort(F.collect_list("g")), ",").alias("cohorts")), "event-time")
    joined = effects.influence.join(cells.select("g", "t", "e", F.col("att").alias("cell"), F.col("n_treated").alias("n_cell")), ["g", "t"]).join(by_e.select("e", "att", "n_treated"), "e")
    share = F.col("n_cell") / F.col("n_treated") * F.col("psi") + F.coalesce("treated", F.lit(0)) * (F.col("cell") - F.col("att")) / F.col("n_treated")
    return by_e, staging.write(joined.groupBy("e", "cluster").agg(F.sum(share).alias("psi")), "event-influence")


def overall(by_e: DataFrame, influence: DataFrame, post: list[int]) -> tuple[float | None, DataFrame]:
    """Plain mean of the effects at the post event times that exist, and its influence by cluster."""
    chosen = by_e.where(F.col("e").isin(post))
    got = chosen.agg(F.avg("att").alias("att"), F.count("*").alias("k")).first()
    return got["att"], influence.where(F.col("e").isin(post)).groupBy("cluster").agg((F.sum("psi") / F.lit(max(1, got["k"]))).alias("psi"))


def _factor(clusters: int) -> float:
    return clusters / (clusters - 1) if clusters > 1 else math.nan


def joint_test(by_e: DataFrame, influence: DataFrame, times: list[int], clusters: int) -> dict:
    """Wald test that the effects at the event times are all zero, from the clustered covariance of their influence."""
    att = {r["e"]: r["att"] for r in by_e.where(F.col("e").isin(times)).collect()}  # one row an event time
    keys = sorted(att)
    if not keys:
        return {"statistic": None, "df": 0, "p": None}
    wide = influence.where(F.col("e").isin(keys)).groupBy("cluster").agg(*[F.coalesce(F.sum(F.when(F.col("e") == e, F.col("psi"))), F.lit(0.0)).alias(f"p{i}") for i, e in enumerate(keys)])
    got = wide.agg(*[F.sum(F.col(f"p{i}") * F.col(f"p{j}")).alias(f"c{i}_{j}") for i in range(len(keys)) for j in range(len(keys))]).first()
    cov = np.array([[got[f"c{i}_{j}"] for j in range(len(keys))] for i in range(len(keys))], float) * _factor(clusters)
    x = np.array([att[e] for e in keys])
    if np.linalg.matrix_rank(cov) < len(keys):
        return {"statistic": None, "df": len(keys), "p": None}
    stat = float(x @ np.linalg.solve(cov, x))
    return {"statistic": stat, "df": len(keys), "p": chi2_tail(stat, len(keys))}


def multiplier_bootstrap(influence: DataFrame, key: list[str], replications: int, seed: int = 0) -> DataFrame:
    """``(*key, draw, value)``: sums of influence under a random sign per cluster, the same for all keys of a draw."""
    sign = F.when(F.pmod(F.xxhash64(F.lit(seed), F.col("draw"), F.col("cluster").cast("string")), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    drawn = influence.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(replications))))
    return drawn.groupBy(*key, "draw").agg(F.sum(sign * F.col("psi")).alias("value"))


def event_study(panel: DataFrame, staging: Staging, e_min: int, e_max: int, post: list[int] | None = None, control: str = "not_yet_treated", anticipation: int = 0, balance: tuple[int, int] | None = None, alpha: float = 0.05, bootstrap: int = 0, seed: int = 0, min_control: int = 1, cohorts: list[int] | None = None) -> dict:
    """Leads and lags with standard errors and bands, an overall effect after treatment, and tests of the leads.

    ``event_time`` is a table; standard errors are analytic, or from the bootstrap's interquartile range if that is asked for, and
    bands then hold for all event times at once.
    """
    effects = att_gt(panel, staging, control, anticipation, 1, min_control, cohorts)
    by_e, influence = event_time(effects, staging, e_min, e_max, balance)
    post = list(range(e_max + 1)) if post is None else list(post)
    factor, z = _factor(effects.n_clusters), normal_quantile(1 - alpha / 2)
    se = influence.groupBy("e").agg(F.sqrt(F.sum(F.col("psi") * F.col("psi")) * F.lit(factor)).alias("analytic_se"))
    table = by_e.join(se, "e", "left").withColumn("se", F.col("analytic_se"))
    value, own = overall(by_e, influence, post)
    got = own.agg(F.sqrt(F.sum(F.col("psi") * F.col("psi")) * F.lit(factor))).first()[0]
    total = {"att": value, "se": got, "p": two_sided(value / got) if value is not None and got else None, "bootstrap_p": None}
    critical = sup_p = None
    if bootstrap:
        draws = staging.write(multiplier_bootstrap(influence, ["e"], bootstrap, seed), "draws")
        spread = normal_quantile(0.75) - normal_quantile(0.25)
        boot = draws.groupBy("e").agg(((F.percentile("value", 0.75) - F.percentile("value", 0.25)) / F.lit(spread)).alias("_b"))
        table = table.join(boot, "e", "left").withColumn("se", F.when(F.col("_b") > 0, F.col("_b")).otherwise(F.col("se"))).drop("_b")
        table = staging.write(table, "event-study")
        scaled = draws.join(table.select("e", "se"), "e").where("se > 0").withColumn("s", F.abs(F.col("value")) / F.col("se"))
        critical = scaled.groupBy("draw").agg(F.max("s").alias("m")).agg(F.percentile("m", 1 - alpha)).first()[0]
        leads = table.where((F.col("e") < effects.reference) & (F.col("se") > 0)).agg(F.max(F.abs(F.col("att")) / F.col("se"))).first()[0]
        if leads is not None:
            above = scaled.where(F.col("e") < effects.reference).groupBy("draw").agg(F.max("s").alias("m")).where(F.col("m") >= leads).count()
            sup_p = (1 + above) / (bootstrap + 1)
        mine = multiplier_bootstrap(own, [], bootstrap, seed)
        if value is not None:
            total["bootstrap_p"] = (1 + mine.where(F.abs(F.col("value")) >= abs(value)).count()) / (bootstrap + 1)
    table = table.withColumns({"ci_low": F.col("att") - z * F.col("se"), "ci_high": F.col("att") + z * F.col("se"), "band_low": F.col("att") - F.lit(critical) * F.col("se"), "band_high": F.col("att") + F.lit(critical) * F.col("se")})
    leads = [e for e in range(e_min, e_max + 1) if e < effects.reference]
    return {"event_time": table, "overall": total, "critical": critical, "leads": joint_test(by_e, influence, leads, effects.n_clusters), "leads_sup_p": sup_p, "n_clusters": effects.n_clusters, "cells": effects.cells}


def twfe_static(panel: DataFrame, staging: Staging) -> dict[str, float]:
    """The two-way fixed-effects coefficient of being treated, for comparison only: staggered timing biases it."""
    p = prepared(panel).withColumn("d", F.when(F.col("period") >= F.col("cohort"), 1.0).otherwise(0.0))
    inner = demean(p.select("unit", "period", "cluster", "y", "d"), ["y", "d"], ["unit", "period"], staging)
    got = inner.agg(F.sum(F.col("d") * F.col("d")).alias("dd"), F.sum(F.col("d") * F.col("y")).alias("dy")).first()
    if not got["dd"] or got["dd"] <= 1e-12:
        raise ValueError("treatment doesn't vary within units and periods")
    beta = got["dy"] / got["dd"]
    scores = inner.groupBy("cluster").agg(F.sum(F.col("d") * (F.col("y") - F.lit(beta) * F.col("d"))).alias("s")).agg(F.sum(F.col("s") * F.col("s")).alias("ss"), F.count("*").alias("c")).first()
    se = math.sqrt(_factor(scores["c"]) * scores["ss"]) / got["dd"] if scores["c"] > 1 else math.nan
    return {"beta": beta, "se": se, "p": two_sided(beta / se) if se > 0 else None, "clusters": scores["c"]}


def stacked_did(panel: DataFrame, staging: Staging, e_min: int, e_max: int, anticipation: int = 0, balanced: bool = True, cohorts: list[int] | None = None) -> tuple[DataFrame, int]:
    """``(e, att, se, n_treated, n_control)``: stacks of one cohort and clean controls, pooled by ``nT nC / (nT + nC)``.

    Clean controls are of the cohort's stratum and not treated until after the window; with ``balanced`` all
    units of a stack have the whole window. The second value is the number of stacks.
    """
    p = staging.write(prepared(panel), "panel")
    reference, width = -1 - anticipation, e_max - e_min + 1
    groups = p.where("cohort is not null").select(F.col("cohort").alias("g")).distinct()
    if cohorts is not None:
        groups = groups.where(F.col("g").isin(cohorts))
    joined = p.withColumn("g", F.explode(F.transform(F.sequence(F.lit(e_min), F.lit(e_max)), lambda e: F.col("period") - e))).join(groups, "g", "left_semi").withColumn("e", F.col("period") - F.col("g"))
    role = F.when(F.col("cohort") == F.col("g"), 1).when(F.col("cohort").isNull() | (F.col("cohort") > F.col("g") + e_max + anticipation), 0)
    joined = joined.withColumn("treated", role).where("treated is not null")
    unit = W.partitionBy("g", "unit")
    joined = joined.withColumns({"y0": F.max(F.when(F.col("e") == reference, F.col("y"))).over(unit), "k": F.count("*").over(unit)})
    rows = joined.where("y0 is not null" + (f" and k = {width}" if balanced else "")).where(F.col("e") != reference).select("g", "stratum", "cluster", "e", "treated", (F.col("y") - F.col("y0")).alias("d"))
    rows = staging.write(rows, "stacks")
    of = lambda r: F.when(F.col("treated") == r, F.col("d"))
    parts = rows.groupBy("g", "stratum", "e").agg(F.count(of(1)).alias("nt"), F.avg(of(1)).alias("mt"), F.count(of(0)).alias("nc"), F.avg(of(0)).alias("mc")).where("nt > 0 and nc > 0")
    parts = staging.write(parts.withColumns({"w": F.col("nt") * F.col("nc") / (F.col("nt") + F.col("nc")), "att": F.col("mt") - F.col("mc")}), "stack-parts")
    pooled = staging.write(parts.groupBy("e").agg((F.sum(F.col("w") * F.col("att")) / F.sum("w")).alias("pooled"), F.sum("w").alias("total"), F.sum("nt").alias("n_treated"), F.sum("nc").alias("n_control")), "pooled")
    known = rows.join(parts, ["g", "stratum", "e"]).join(pooled.select("e", "pooled", "total"), "e")
    share = F.col("w") / F.col("total")
    psi = F.when(F.col("treated") == 1, share * (F.col("d") - F.col("mt")) / F.col("nt") + share * (F.col("att") - F.col("pooled")) / F.col("nt")).otherwise(-share * (F.col("d") - F.col("mc")) / F.col("nc"))
    clusters = p.select("cluster").distinct().count()
    se = known.groupBy("e", "cluster").agg(F.sum(psi).alias("psi")).groupBy("e").agg(F.sqrt(F.sum(F.col("psi") * F.col("psi")) * F.lit(_factor(clusters))).alias("se"))
    stacks = parts.select("g", "stratum").distinct().count()
    return pooled.join(se, "e").select("e", F.col("pooled").alias("att"), "se", "n_treated", "n_control"), stacks


def placebo_dates(panel: DataFrame, staging: Staging, shift: int, anticipation: int = 0, **options) -> dict:
    """The event study as if treatment had come ``shift`` periods early, on data before treatment alone."""
    if shift < 1 + anticipation:
        raise ValueError("the shift must leave a period before treatment")
    moved = panel.where(F.col("cohort").isNull() | (F.col("period") < F.col("cohort") - anticipation)).withColumn("cohort", F.col("cohort") - shift)
    last = shift - 1 - anticipation
    return event_study(moved, staging, -shift, last, list(range(last + 1)), anticipation=anticipation, **options)


def placebo_units(panel: DataFrame, staging: Staging, replications: int, e_min: int, e_max: int, seed: int = 0, alpha: float = 0.05, observed: float | None = None, min_never: int = 20) -> dict:
    """Effects of treatments dealt at random among the never treated: rejection rate and place of the observed effect.

    In each replication the treated share of a stratum's never treated, by hash, get cohorts in the proportions of its
    treated units.
    """
    p = staging.write(prepared(panel), "panel")
    units = p.groupBy("unit", "stratum").agg(F.first("cohort").alias("cohort"), F.first("cluster").alias("cluster"))
    never = staging.write(units.where("cohort is null").select("unit", "stratum"), "never")
    if never.count() < min_never:
        return {"ran": 0, "rejection_rate": None}
    real = units.where("cohort is not null").groupBy("stratum", "cohort").agg(F.count("*").alias("c"))
    upto = W.partitionBy("stratum").orderBy("cohort")
    pool = staging.write(real.withColumns({"hi": F.sum("c").over(upto), "n": F.sum("c").over(W.partitionBy("stratum"))}).withColumn("lo", F.col("hi") - F.col("c")), "pool")
    estimates, rejected = [], 0
    for r in range(replications):
        draw = lambda tag: F.pmod(F.xxhash64(F.lit(seed), F.lit(r), F.lit(tag), F.col("unit").cast("string")), F.lit(1 << 30)) / F.lit(float(1 << 30))  # noqa: B023, E731
        by = W.partitionBy("stratum")
        ranked = never.join(pool.select("stratum", "n").distinct(), "stratum").withColumns({"m": F.count("*").over(by), "u": draw("pick")}).withColumn("k", F.row_number().over(by.orderBy("u", "unit")))
        wanted = F.least(F.greatest(F.lit(1), F.round(F.col("n") / (F.col("n") + F.col("m")) * F.col("m"))), F.col("m") - 1)
        chosen = ranked.where(F.col("k") <= wanted).withColumn("at", F.floor(draw("cohort") * F.col("n")))
        dealt = chosen.join(pool.select("stratum", "cohort", "lo", "hi"), "stratum").where("at >= lo and at < hi").select("unit", "cohort")
        fake = p.where("cohort is null").drop("cohort").join(dealt, "unit", "left")
        got = event_study(fake, staging, e_min, e_max)["overall"]
        if got["p"] is not None:
            estimates.append(got["att"])
            rejected += got["p"] < alpha
    n = len(estimates)
    out = {"ran": n, "rejection_rate": rejected / n if n else None, "mean": float(np.mean(estimates)) if n else None, "sd": float(np.std(estimates, ddof=1)) if n > 1 else None}
    if observed is not None and n:
        out["p"] = (1 + sum(abs(x) >= abs(observed) for x in estimates)) / (n + 1)
    return out


def minimum_detectable_effect(se: float, alpha: float = 0.05, power: float = 0.8) -> float:
    """The effect that a test of this size finds with this power, given its standard error."""
    return (normal_quantile(1 - alpha / 2) + normal_quantile(power)) * se


# Rankings against outcomes.


def score_events(rows: DataFrame, event: str, unit: str, outcome: str, rankings: list[str], share: float = 0.1) -> DataFrame:
    """Per event and ranking: Spearman's correlation, capture and lift of the top ``share``, over units that have all scores."""
    known = F.col(outcome).isNotNull()
    for r in rankings:
        known = known & F.col(r).isNotNull()
    long = rows.where(known).select(F.col(event).alias("event"), F.col(unit).alias("unit"), F.col(outcome).cast("double").alias("y"), F.explode(F.array(*[F.struct(F.lit(r).alias("ranking"), F.col(r).cast("double").alias("s")) for r in rankings])).alias("x")).select("event", "unit", "y", "x.*")
    by = W.partitionBy("event", "ranking")

    def mean_rank(c: str) -> Column:
        return F.rank().over(by.orderBy(c)) + (F.count("*").over(W.partitionBy("event", "ranking", c)) - 1) / 2

    ranked = long.withColumns({"rs": mean_rank("s"), "ry": mean_rank("y"), "n": F.count("*").over(by), "ps": F.row_number().over(by.orderBy(F.desc("s"), "unit")), "py": F.row_number().over(by.orderBy(F.desc("y"), "unit"))})
    k = F.greatest(F.lit(1), F.bround(F.lit(share) * F.col("n"))).cast("long")
    ranked = ranked.withColumn("k", k)
    both = F.count_if((F.col("ps") <= F.col("k")) & (F.col("py") <= F.col("k")))
    return ranked.groupBy("event", "ranking").agg(F.max("n").alias("n"), F.max("k").alias("k"), F.when(F.max("n") >= 3, F.corr("rs", "ry")).alias("spearman"), (both / F.max("k")).alias("capture"), (F.avg(F.when(F.col("ps") <= F.col("k"), F.col("y"))) - F.avg("y")).alias("lift"))


def sign_flip(differences: DataFrame, value: str, exact: int = 16, replications: int = 9999, seed: int = 0) -> dict:
    """One-sided test that a mean of paired differences exceeds zero: all flips of sign up to ``exact`` pairs, else random ones."""
    d = differences.where(F.col(value).isNotNull() & ~F.isnan(value)).select(F.col(value).cast("double").alias("d"))
    got = d.agg(F.count("*").alias("n"), F.avg("d").alias("mean")).first()
    n, mean = got["n"], got["mean"]
    if not n:
        return {"n": 0, "mean": None, "p": None}
    if n <= exact:
        values = np.array([r["d"] for r in d.collect()])  # 16 at most
        signs = 1 - 2 * ((np.arange(1 << n)[:, None] >> np.arange(n)) & 1)
        return {"n": n, "mean": mean, "p": float(((signs * values).mean(axis=1) >= mean - 1e-15).mean())}
    sign = F.when(F.pmod(F.xxhash64(F.lit(seed), "draw", "i"), F.lit(2)) == 0, F.col("d")).otherwise(-F.col("d"))
    numbered = d.withColumn("i", F.monotonically_increasing_id()).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(replications))))
    hits = numbered.groupBy("draw").agg(F.avg(sign).alias("m")).where(F.col("m") >= mean - 1e-15).count()
    return {"n": n, "mean": mean, "p": (1 + hits) / (replications + 1)}


def compare_rankings(scores: DataFrame, candidate: str, baseline: str, metric: str = "spearman") -> dict:
    """Mean skill of one ranking less another's over the events that have both, with a sign-flip test."""
    a = scores.where(F.col("ranking") == candidate).select("event", F.col(metric).alias("a"))
    b = scores.where(F.col("ranking") == baseline).select("event", F.col(metric).alias("b"))
    both = a.join(b, "event").where("a is not null and b is not null").withColumn("d", F.col("a") - F.col("b"))
    got = both.agg(F.count("*").alias("events"), F.avg("a").alias("candidate"), F.avg("b").alias("baseline"), F.count_if(F.col("a") > F.col("b")).alias("better")).first().asDict()
    return got | {k: v for k, v in sign_flip(both, "d").items() if k != "n"}


def employment_loss(rows: DataFrame, unit: str, period: str, value: str, before: int, after: int) -> DataFrame:
    """Log fall of a value from one period to another, larger meaning more lost; both must be positive."""
    at = lambda p, name: rows.where((F.col(period) == p) & (F.col(value) > 0)).select(unit, F.log(value).alias(name))
    return at(before, "_b").join(at(after, "_a"), unit).select(unit, (F.col("_b") - F.col("_a")).alias("loss"))
