"""Iterated systems: exposure clearing, indirect ownership, field diffusion, shortest routes, games, fair shares.

Each step is a join and an aggregation over tables in the shared folder, so state and network may exceed any one machine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from factloom.operators.staging import Staging


def clearing(obligations: DataFrame, cash: DataFrame, staging: Staging, max_rounds: int = 1000, tolerance: float = 1e-9) -> DataFrame:
    """``(id, due, paid, shortfall)``: the greatest fixed point of paying in proportion up to cash and receipts.

    Obligations are ``(borrower, lender, amount)``, cash is ``(id, cash)``. Starting from full payment, each round
    recomputes what every borrower can pay from its cash and what it is paid, until no ratio moves by more than
    ``tolerance``. Raises if that takes more than ``max_rounds``.
    """
    debts = staging.write(obligations.groupBy("borrower", "lender").agg(F.sum("amount").alias("amount")), "debts")
    due = debts.groupBy(F.col("borrower").alias("id")).agg(F.sum("amount").alias("due"))
    ids = due.select("id").unionByName(debts.select(F.col("lender").alias("id"))).unionByName(cash.select("id")).distinct()
    base = staging.write(ids.join(due, "id", "left").join(cash.groupBy("id").agg(F.sum("cash").alias("cash")), "id", "left").na.fill(0.0, ["due", "cash"]), "base")
    ratio = base.select("id", F.lit(1.0).alias("ratio"))
    for i in range(max_rounds):
        got = debts.join(ratio.withColumnRenamed("id", "borrower"), "borrower").groupBy(F.col("lender").alias("id")).agg(F.sum(F.col("amount") * F.col("ratio")).alias("got"))
        able = F.greatest(F.lit(0.0), F.col("cash") + F.coalesce("got", F.lit(0.0)))
        new = base.join(got, "id", "left").select("id", F.when(F.col("due") > 0, F.least(F.lit(1.0), able / F.col("due"))).otherwise(1.0).alias("ratio"))
        new = staging.write(new, f"ratio-{i}")
        moved = new.join(ratio.withColumnRenamed("ratio", "old"), "id").agg(F.max(F.abs(F.col("ratio") - F.col("old")))).first()[0]
        staging.drop(ratio)
        ratio = new
        if moved is None or moved <= tolerance:
            break
    else:
        raise RuntimeError(f"clearing did not settle in {max_rounds} rounds")
    return base.join(ratio, "id").select("id", "due", (F.col("due") * F.col("ratio")).alias("paid"), (F.col("due") * (1 - F.col("ratio"))).alias("shortfall"))


def look_through(edges: DataFrame, listed: DataFrame, staging: Staging, max_rounds: int = 1000) -> DataFrame:
    """``(entity, exposure)``: direct and indirect share held by listed owners, shares multiplying along chains, at most 1.

    Raises if exposures still move after ``max_rounds``.
    """
    seed = listed.select("entity", F.lit(1.0).alias("exposure")).distinct()
    state = staging.write(seed, "exposure-0")
    for i in range(1, max_rounds + 1):
        held = edges.join(state.withColumnRenamed("entity", "subject"), "subject").groupBy(F.col("object").alias("entity")).agg(F.least(F.lit(1.0), F.sum(F.col("share") * F.col("exposure"))).alias("exposure"))
        new = staging.write(seed.unionByName(held).groupBy("entity").agg(F.max("exposure").alias("exposure")), f"exposure-{i}")
        same = new.join(state.withColumnRenamed("exposure", "old"), "entity", "left").where(F.abs(F.col("exposure") - F.coalesce("old", F.lit(0.0))) > 1e-12).isEmpty()
        staging.drop(state)
        state = new
        if same:
            break
    else:
        raise RuntimeError(f"look-through exposures did not settle in {max_rounds} rounds")
    return state


def diffuse(cells: DataFrame, links: DataFrame, steps: int, dt: float, staging: Staging) -> DataFrame:
    """``(id, value)`` after explicit steps of flux ``conductance * difference``; what leaves one cell enters another."""
    both = links.select(F.col("source").alias("id"), F.col("target").alias("other"), "conductance").unionByName(links.select(F.col("target").alias("id"), F.col("source").alias("other"), "conductance"))
    net = staging.write(both, "links")
    state = staging.write(cells.select("id", "measure", "value"), "cells-0")
    for i in range(1, steps + 1):
        other = state.select(F.col("id").alias("other"), F.col("value").alias("v2"))
        flux = net.join(state.select("id", F.col("value").alias("v1")), "id").join(other, "other").groupBy("id").agg(F.sum(F.col("conductance") * (F.col("v2") - F.col("v1"))).alias("flux"))
        state = staging.write(state.join(flux, "id", "left").select("id", "measure", (F.col("value") + dt * F.coalesce("flux", F.lit(0.0)) / F.col("measure")).alias("value")), f"cells-{i}")
    return state.select("id", "value")


def routes(edges: DataFrame, source: str, staging: Staging, max_rounds: int = 10_000) -> DataFrame:
    """``(node, cost)``: cheapest cost from a source, by rounds of relaxing the nodes that improved.

    Raises if nodes still improve after ``max_rounds``, as along a cycle of negative cost.
    """
    best = staging.write(edges.sparkSession.range(1).select(F.lit(source).alias("node"), F.lit(0.0).alias("cost")), "cost-0")
    front = best
    for i in range(1, max_rounds + 1):
        step = front.join(edges.select(F.col("subject").alias("node"), "object", "weight"), "node").groupBy(F.col("object").alias("node")).agg(F.min(F.col("cost") + F.col("weight")).alias("new"))
        front = staging.write(step.join(best, "node", "left").where("cost is null or new < cost").select("node", F.col("new").alias("cost")), f"front-{i}")
        if front.isEmpty():
            break
        best = staging.write(best.unionByName(front).groupBy("node").agg(F.min("cost").alias("cost")), f"cost-{i}")
    else:
        raise RuntimeError(f"routes did not settle in {max_rounds} rounds")
    return best


def pure_nash(payoffs: DataFrame) -> DataFrame:
    """Action pairs from which neither player gains alone; payoffs are ``(game, a, b, pay_a, pay_b)``."""
    best_a = F.max("pay_a").over(W.partitionBy("game", "b"))
    best_b = F.max("pay_b").over(W.partitionBy("game", "a"))
    return payoffs.withColumns({"_a": best_a, "_b": best_b}).where("pay_a = _a and pay_b = _b").select("game", "a", "b", "pay_a", "pay_b")


def apply_pressures(values: DataFrame, pressures: DataFrame, dt: float) -> DataFrame:
    """Exact integration over ``dt`` of constant rates and pulls towards centres.

    Pressures are ``(variable, rate, strength, centre)``: dx/dt = sum(rate) + sum(strength * (centre - x)).
    """
    sums = pressures.groupBy("variable").agg(F.sum("rate").alias("r"), F.sum("strength").alias("k"), F.sum(F.col("strength") * F.col("centre")).alias("kc"))
    x, k = F.col("value"), F.coalesce("k", F.lit(0.0))
    free = F.coalesce("r", F.lit(0.0)) + F.coalesce("kc", F.lit(0.0))
    rest = F.when(k > 0, free / k)
    out = F.when(k > 0, rest + (x - rest) * F.exp(-k * dt)).otherwise(x + free * dt)
    return values.join(sums, "variable", "left").select("variable", out.alias("value"))


def fair_shares(demands: DataFrame, total: float) -> DataFrame:
    """``(id, share)``: weighted max-min fair division, no demand exceeded.

    In closed form: by rising demand per weight, the level as if all before were filled rises to the true level
    and falls after it.
    """
    order = W.orderBy(F.col("demand") / F.col("weight"), "id").rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    level = (F.lit(total) - F.coalesce(F.sum("demand").over(order), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(order), F.lit(0.0)))
    top = F.max("level").over(every)
    return demands.withColumn("level", level).withColumn("top", top).select("id", F.least("demand", F.when(F.sum("demand").over(every) <= total, F.col("demand")).otherwise(F.col("top") * F.col("weight"))).alias("share"))


def expand_grid(spark, parameters: dict[str, list]) -> DataFrame:
    """All combinations of declared parameter values, one row each."""
    out = spark.range(1)
    for name, values in parameters.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return out.drop("id")
