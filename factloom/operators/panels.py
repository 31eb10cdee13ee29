"""Typed graphs, observation sets, roll calls, tariffs, positions, places, allocations and ledgers, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from factloom.operators.staging import Staging


# Types and stages


def type_closure(types: DataFrame, staging: Staging, max_rounds: int = 64) -> DataFrame:
    """``(type, ancestor)`` with every type its own ancestor; ``types`` is ``(type, parent)``. Each round doubles the reach."""
    pairs = types.where("parent is not null").select("type", F.col("parent").alias("ancestor"))
    own = types.select("type").unionByName(pairs.select(F.col("ancestor").alias("type"))).distinct()
    reach = staging.write(pairs.unionByName(own.select("type", F.col("type").alias("ancestor"))).distinct(), "types-0")
    count = reach.count()
    for i in range(1, max_rounds + 1):
        further = reach.join(reach.select(F.col("type").alias("ancestor"), F.col("ancestor").alias("further")), "ancestor").select("type", F.col("further").alias("ancestor"))
        new = staging.write(further.distinct(), f"types-{i}")
        staging.drop(reach)
        reach, before, count = new, count, new.count()
        if count == before:
            return reach
    raise RuntimeError(f"type hierarchy did not close in {max_rounds} rounds")


def typed_violations(edges: DataFrame, entities: DataFrame, rules: DataFrame, closure: DataFrame) -> DataFrame:
    """Edges that a rule ``(predicate, domain, range)`` forbids: ``(subject, predicate, object, reason)``.

    Reasons: unknown_predicate, missing_subject, missing_object, domain, range; several rules of a predicate are alternatives.
    """
    of = lambda side: entities.select(F.col("entity").alias(side), F.col("type").alias(f"{side}_type"))
    joined = edges.join(of("subject"), "subject", "left").join(of("object"), "object", "left").join(rules, "predicate", "left")
    is_a = lambda side, want: closure.select(F.col("type").alias(f"{side}_type"), F.col("ancestor").alias(want), F.lit(True).alias(f"{side}_ok"))
    checked = joined.join(is_a("subject", "domain"), ["subject_type", "domain"], "left").join(is_a("object", "range"), ["object_type", "range"], "left")
    reason = F.when(F.col("domain").isNull(), "unknown_predicate").when(F.col("subject_type").isNull(), "missing_subject").when(F.col("object_type").isNull(), "missing_object").when(F.col("subject_ok").isNull(), "domain").when(F.col("object_ok").isNull(), "range")
    best = checked.withColumn("reason", reason).groupBy("subject", "predicate", "object").agg(F.count_if(F.col("reason").isNull()).alias("fine"), F.min("reason").alias("reason"))
    return best.where("fine = 0").select("subject", "predicate", "object", "reason")


def run_order(stages: DataFrame, needs: DataFrame, staging: Staging, max_rounds: int = 1000) -> DataFrame:
    """``(stage, level)``: each stage one level above the highest it needs. Raises on a cycle or an unknown need."""
    if not needs.join(stages.select(F.col("stage").alias("need")), "need", "left_anti").isEmpty():
        raise ValueError("a stage needs one that isn't there")
    left, done = staging.write(stages.select("stage").distinct(), "stages"), None
    for level in range(max_rounds):
        if left.isEmpty():
            return done if done is not None else left.withColumn("level", F.lit(0))
        waiting = needs.join(left.select(F.col("stage").alias("need")), "need", "left_semi").select("stage").distinct()
        ready = staging.write(left.join(waiting, "stage", "left_anti").withColumn("level", F.lit(level)), f"level-{level}")
        if ready.isEmpty():
            raise ValueError("stages need each other in a circle")
        done = ready if done is None else done.unionByName(ready)
        left = staging.write(left.join(ready.select("stage"), "stage", "left_anti"), f"left-{level}")
    raise RuntimeError("too many levels of stages")


# Observation sets


def availability(published: Column, observed: Column, period_end: Column, lag_days: int, strict: bool) -> Column:
    """When an observation could be known: stated date, else acquisition (strict) or the period's end and a declared lag."""
    return F.coalesce(published, observed if strict else period_end + F.expr(f"interval {lag_days} days"))


def visible(observations: DataFrame, cutoff: str) -> DataFrame:
    return observations.where(F.col("available_at") <= F.lit(cutoff).cast("timestamp_ntz"))


def latest_vintage(observations: DataFrame, key: list[str]) -> DataFrame:
    """The last available value of each key and how many vintages there were; ``ambiguous`` if values tie for last."""
    newest = F.max("available_at").over(W.partitionBy(*key))
    n = F.count("*").over(W.partitionBy(*key))
    last = observations.withColumns({"_newest": newest, "vintages": n}).where("available_at = _newest")
    return last.groupBy(*key).agg(F.max("value").alias("value"), F.max("available_at").alias("available_at"), F.max("vintages").alias("vintages"), (F.min("value") != F.max("value")).alias("ambiguous"))


def frame(observations: DataFrame, series: list[str], time: str = "period") -> DataFrame:
    """One row a period with a column per series, only periods that all series have."""
    value = lambda s: F.max(F.when(F.col("series") == s, F.col("value"))).alias(s)
    wide = observations.where(F.col("series").isin(series)).groupBy(time).agg(*[value(s) for s in series])
    return wide.dropna(subset=series)


# Roll calls


def party_unity(votes: DataFrame) -> DataFrame:
    """``(member, party, unity_votes, defections)``: votes on which both parties have majorities that differ, and those cast
    against one's own. Votes are ``(rollcall, member, party, position)`` with position yea, nay or another; ties make no majority."""
    cast = votes.where(F.col("position").isin("yea", "nay"))
    by_party = cast.groupBy("rollcall", "party").agg(F.sum(F.when(F.col("position") == "yea", 1).otherwise(-1)).alias("lean")).where("lean <> 0").withColumn("side", F.when(F.col("lean") > 0, "yea").otherwise("nay"))
    unity = by_party.groupBy("rollcall").agg(F.count("*").alias("parties"), F.count_distinct("side").alias("sides")).where("parties = 2 and sides = 2").select("rollcall")
    own = cast.join(unity, "rollcall", "left_semi").join(by_party.select("rollcall", "party", "side"), ["rollcall", "party"])
    return own.groupBy("member", "party").agg(F.count("*").alias("unity_votes"), F.count_if(F.col("position") != F.col("side")).alias("defections"))


def latest_filing(filings: DataFrame, key: list[str], *order: str) -> DataFrame:
    """Amendments give way to the last filing of their key."""
    return filings.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(*[F.desc(o) for o in order]))).where("_n = 1").drop("_n")


def issuer_panel(holdings: DataFrame, issuer: str, period: str, holder: str, value: str) -> DataFrame:
    """Per issuer and period the holders, total, largest share, and concentration of what is held."""
    one = holdings.groupBy(issuer, period, holder).agg(F.sum(value).alias("v"))
    total = F.sum("v")
    return one.groupBy(issuer, period).agg(F.count("*").alias("holders"), total.alias("held"), (F.max("v") / total).alias("top_share"), (F.sum(F.col("v") * F.col("v")) / (total * total)).alias("hhi"))


def entry_rates(holdings: DataFrame, holder: str, item: str, period: str) -> DataFrame:
    """``(item, period, opened, rate)``: holders who open a position, of those present in both periods who had none.

    Periods are consecutive integers; a holder is present in a period in which it holds anything.
    """
    held = holdings.select(F.col(holder).alias("h"), F.col(item).alias("i"), F.col(period).alias("p")).distinct()
    present = held.select("h", "p").distinct()
    both = present.join(present.select("h", (F.col("p") + 1).alias("p")), ["h", "p"])
    stayed = both.groupBy("p").agg(F.count("*").alias("filers"))
    before = held.select("h", "i", (F.col("p") + 1).alias("p"), F.lit(1).alias("had"))
    now = held.join(both, ["h", "p"], "left_semi").join(before, ["h", "i", "p"], "left")
    opened = now.where("had is null").groupBy("i", "p").agg(F.count("*").alias("opened"))
    prior = before.join(both, ["h", "p"], "left_semi").groupBy("i", "p").agg(F.count("*").alias("held_before"))
    joined = opened.join(prior, ["i", "p"], "left").join(F.broadcast(stayed), "p").na.fill(0, ["held_before"])  # one row a period
    return joined.select(F.col("i").alias("item"), F.col("p").alias("period"), "opened", F.try_divide(F.col("opened").cast("double"), F.col("filers") - F.col("held_before")).alias("rate"))


def tariff_for(flows: DataFrame, tariffs: DataFrame, key: list[str], year: str) -> DataFrame:
    """Flows with the tariff of the last year at or before theirs, and how many years old it is."""
    w = W.partitionBy(*key).orderBy("_y", "_side").rowsBetween(W.unboundedPreceding, 0)
    left = flows.withColumns({"_y": F.col(year), "_side": F.lit(1), "_t": F.lit(None).cast("struct<year:int,rate:double>")})
    right = tariffs.select(*key, F.col("year").alias("_y"), F.lit(0).alias("_side"), F.struct(F.col("year").cast("int").alias("year"), F.col("rate").cast("double").alias("rate")).alias("_t"))
    found = left.unionByName(right, allowMissingColumns=True).withColumn("_t", F.last("_t", ignorenulls=True).over(w)).where("_side = 1")
    return found.select(*flows.columns, F.col("_t.rate").alias("rate"), (F.col(year) - F.col("_t.year")).alias("age"))


# Places


def in_box(cells: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """Points in a box; a box whose west is beyond its east crosses the date line."""
    across = F.col("lon").between(west, east) if west <= east else (F.col("lon") >= west) | (F.col("lon") <= east)
    return cells.where(F.col("lat").between(south, north) & across)


def containing(boxes: DataFrame, lon: float, lat: float) -> DataFrame:
    """Boxes that hold a point, the smallest first."""
    inside = (F.col("west") <= lon) & (F.col("east") >= lon) & (F.col("south") <= lat) & (F.col("north") >= lat)
    return boxes.where(inside).withColumn("area", (F.col("east") - F.col("west")) * (F.col("north") - F.col("south"))).orderBy("area", "id")


def cell_summary(values: DataFrame, cells: DataFrame, by: str) -> DataFrame:
    """Sum, mean and count of cell values by a column of the cells."""
    return values.join(cells.select("id", by), "id").groupBy(by).agg(F.sum("value").alias("total"), F.avg("value").alias("mean"), F.count("*").alias("n"))


# Choices and allocations


def round_robin(rows: DataFrame, key: list[str], group: str, order: list[str], limit: int) -> DataFrame:
    """The first ``limit`` rows of each key, taking from its groups in turn."""
    by = W.partitionBy(*key, group).orderBy(*order)
    turned = rows.withColumn("_turn", F.row_number().over(by))
    return turned.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy("_turn", group, *order))).where(F.col("_n") <= limit).drop("_turn").withColumnRenamed("_n", "place")


def largest_remainder(weights: DataFrame, key: list[str], unit: str, total: str) -> DataFrame:
    """Whole numbers that add up to ``total`` in proportion to ``weight``: the largest fractions round up, ties by unit."""
    by = W.partitionBy(*key)
    exact = F.col(total) * F.col("weight") / F.sum("weight").over(by)
    parts = weights.withColumns({"_e": exact, "_f": F.floor(exact)}).withColumn("_left", F.col(total) - F.sum("_f").over(by))
    ranked = parts.withColumn("_r", F.row_number().over(by.orderBy(F.desc(F.col("_e") - F.col("_f")), unit)))
    return ranked.select(*weights.columns, (F.col("_f") + F.when(F.col("_r") <= F.col("_left"), 1).otherwise(0)).cast("long").alias("share"))


def compare_strategies(outcomes: DataFrame) -> DataFrame:
    """Strategies by mean outcome over scenarios, with the worst one and how many others each dominates everywhere."""
    means = outcomes.groupBy("strategy").agg(F.avg("value").alias("mean"), F.min("value").alias("worst"), F.count("*").alias("scenarios"))
    a, b = outcomes.select("scenario", F.col("strategy").alias("a"), F.col("value").alias("va")), outcomes.select("scenario", F.col("strategy").alias("b"), F.col("value").alias("vb"))
    pairs = a.join(b, "scenario").where("a <> b").groupBy("a", "b").agg(F.min(F.col("va") - F.col("vb")).alias("least"), F.max(F.col("va") - F.col("vb")).alias("most")).where("least >= 0 and most > 0")
    dominated = pairs.groupBy(F.col("a").alias("strategy")).agg(F.count("*").alias("dominates"))
    return means.join(dominated, "strategy", "left").na.fill(0, ["dominates"])


def balance_flows(flows: DataFrame, row_totals: DataFrame, column_totals: DataFrame, staging: Staging, tolerance: float = 1e-9, max_rounds: int = 500) -> DataFrame:
    """``(i, j, flow)`` scaled by rows and columns in turn until both totals hold; raises if that doesn't settle."""
    state = staging.write(flows.where("flow > 0").select("i", "j", F.col("flow").cast("double").alias("flow")), "flows-0")
    for r in range(1, max_rounds + 1):
        by_i = state.groupBy("i").agg(F.sum("flow").alias("s")).join(row_totals, "i").select("i", (F.col("total") / F.col("s")).alias("k"))
        scaled = state.join(by_i, "i").select("i", "j", (F.col("flow") * F.col("k")).alias("flow"))
        by_j = scaled.groupBy("j").agg(F.sum("flow").alias("s")).join(column_totals, "j").select("j", (F.col("total") / F.col("s")).alias("k"))
        new = staging.write(scaled.join(by_j, "j").select("i", "j", (F.col("flow") * F.col("k")).alias("flow")), f"flows-{r}")
        gap = new.groupBy("i").agg(F.sum("flow").alias("s")).join(row_totals, "i").agg(F.max(F.abs(F.col("s") - F.col("total")) / F.greatest(F.lit(1.0), F.abs("total")))).first()[0]
        staging.drop(state)
        state = new
        if gap is None or gap <= tolerance:
            return state
    raise RuntimeError(f"flows did not balance in {max_rounds} rounds")


# Money and decay


def bond_value(face: Column, coupon: Column, yield_: Column, periods: Column) -> Column:
    """Present value of coupons and face at one yield a period."""
    discount = F.pow(1 + yield_, -periods)
    return F.when(yield_ == 0, face * (1 + coupon * periods)).otherwise(face * coupon * (1 - discount) / yield_ + face * discount)


def curve_loadings(tau: Column, decay: float) -> tuple[Column, Column, Column]:
    """Level, slope and curvature of a yield curve at a maturity."""
    x = tau * F.lit(decay)
    slope = (1 - F.exp(-x)) / x
    return F.lit(1.0), slope, slope - F.exp(-x)


def duration_multiplier(days: Column) -> Column:
    """A quarter more over a decade, in proportion before."""
    return 1 + 0.25 * F.least(F.lit(1.0), days / 3652.5)


def selectivity(members: Column, alpha: float) -> Column:
    """How much a shared context of so many members says of a pair."""
    return F.when(members > 1, F.pow(members - 1, F.lit(-alpha))).otherwise(0.0)


def soft_viability(margins: Column, sharpness: float) -> Column:
    """A smooth minimum of an array of margins."""
    least = F.array_min(margins)
    total = F.aggregate(margins, F.lit(0.0), lambda a, m: a + F.exp(-sharpness * (m - least)))
    return least - F.log(total) / sharpness


def modelled_wind(peak: Column, distance: Column, radius: Column) -> Column:
    """Wind at a distance from a storm's centre: its peak within the radius, falling with the root beyond."""
    return peak * F.least(F.lit(1.0), F.sqrt(radius / distance))


def ledger(batches: DataFrame, account: str, amount: str) -> DataFrame:
    """Balances after each batch, a batch counting once however often it was sent: ``(account, batch, seq, balance)``.

    Copies of a batch must agree; a batch sent with different contents is refused (``conflict`` true, no effect).
    """
    same = batches.groupBy("batch", account).agg(F.min("seq").alias("seq"), F.min(amount).alias("lo"), F.max(amount).alias("hi"))
    entry = same.withColumn("conflict", F.col("lo") != F.col("hi"))
    effect = F.when(F.col("conflict"), F.lit(0).cast(dict(batches.dtypes)[amount])).otherwise(F.col("lo"))
    w = W.partitionBy(account).orderBy("seq", "batch").rowsBetween(W.unboundedPreceding, 0)
    return entry.withColumn("balance", F.sum(effect).over(w)).select(account, "batch", "seq", "balance", "conflict")


def entropy(weights: Column) -> Column:
    """Entropy of an array of weights, in nats."""
    total = F.aggregate(weights, F.lit(0.0), lambda a, w: a + w)
    return -F.aggregate(F.filter(weights, lambda w: w > 0), F.lit(0.0), lambda a, w: a + w / total * F.log(w / total))
