"""Queries on types, observation sets, roll calls, positions, places and allocations, each beside its oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from factloom.operators import panels
from factloom.operators.staging import Staging
from factloom.plans.tables import money, read

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


TYPES = "(SELECT p_partkey + 1 AS type, CASE WHEN p_partkey > 0 THEN (p_partkey + 1) // 2 END AS parent FROM part)"


def _types(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return read(spark, sf_dir, "part").select((k + 1).alias("type"), F.when(k > 0, F.expr("(p_partkey + 1) div 2")).alias("parent"))


@query(f"WITH RECURSIVE t AS {TYPES}, r AS (SELECT type, type AS ancestor FROM t UNION SELECT r.type, t.parent FROM r JOIN t ON t.type = r.ancestor WHERE t.parent IS NOT NULL) SELECT type, ancestor FROM r")
def type_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each type with all it is a kind of."""
    return panels.type_closure(_types(spark, sf_dir), Staging(spark, "types"))


@query(f"""WITH RECURSIVE t AS {TYPES}, r AS (SELECT type, type AS ancestor FROM t UNION SELECT r.type, t.parent FROM r JOIN t ON t.type = r.ancestor WHERE t.parent IS NOT NULL),
e AS (SELECT DISTINCT l_suppkey AS s, l_linenumber AS p, l_partkey AS o FROM lineitem), n AS (SELECT k AS entity, k % 500 + 1 AS type FROM range(1000) x(k)),
j AS (SELECT e.*, a.type AS st, b.type AS ot FROM e LEFT JOIN n a ON a.entity = s LEFT JOIN n b ON b.entity = o)
SELECT s AS subject, p AS predicate, o AS object, CASE WHEN p NOT IN (1, 2) THEN 'unknown_predicate' WHEN st IS NULL THEN 'missing_subject' WHEN ot IS NULL THEN 'missing_object' WHEN NOT EXISTS (FROM r WHERE r.type = st AND ancestor = p + 1) THEN 'domain' ELSE 'range' END AS reason FROM j
WHERE NOT (p IN (1, 2) AND st IS NOT NULL AND ot IS NOT NULL AND EXISTS (FROM r WHERE r.type = st AND ancestor = p + 1) AND EXISTS (FROM r WHERE r.type = ot AND ancestor = 1))""")
def typed_graph_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges whose ends aren't of the kinds that their predicate wants."""
    e = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("subject"), F.col("l_linenumber").alias("predicate"), F.col("l_partkey").alias("object")).distinct()
    entities = spark.range(1000).select(F.col("id").alias("entity"), (F.col("id") % 500 + 1).alias("type"))
    rules = spark.createDataFrame([(1, 2, 1), (2, 3, 1)], "predicate int, domain long, range long")
    return panels.typed_violations(e, entities, rules, panels.type_closure(_types(spark, sf_dir), Staging(spark, "types")))


@query("SELECT p_partkey AS stage, CAST(floor(log2(p_partkey + 1)) AS INT) AS level FROM part")
def stage_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages in an order that has each after what it needs."""
    stages = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("stage"))
    needs = stages.where("stage > 0").select("stage", F.expr("(stage + 1) div 2 - 1").alias("need"))
    return panels.run_order(stages, needs, Staging(spark, "order"))


OBSERVED = "(SELECT l_suppkey % 4 AS series, year(l_shipdate) AS period, l_shipdate + CASE WHEN l_linenumber % 2 = 0 THEN INTERVAL 30 DAY ELSE INTERVAL 90 DAY END AS available_at, CAST(l_quantity AS DOUBLE) AS value FROM lineitem)"


def _observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    stated = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_shipdate") + F.expr("interval 30 days"))
    at = panels.availability(stated, F.col("l_shipdate"), F.col("l_shipdate"), 90, False)
    return read(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 4).cast("string").alias("series"), F.year("l_shipdate").alias("period"), at.alias("available_at"), F.col("l_quantity").cast("double").alias("value"))


@query(f"""WITH o AS (SELECT *, MAX(available_at) OVER (PARTITION BY series, period) AS m, COUNT(*) OVER (PARTITION BY series, period) AS n FROM {OBSERVED} WHERE available_at <= TIMESTAMP '2000-06-30')
SELECT CAST(series AS VARCHAR) AS series, period, MAX(value) AS value, MAX(available_at) AS available_at, MAX(n) AS vintages, MIN(value) <> MAX(value) AS ambiguous FROM o WHERE available_at = m GROUP BY 1, 2""")
def latest_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last value known at a cutoff, and whether values tie for it."""
    return panels.latest_vintage(panels.visible(_observed(spark, sf_dir), "2000-06-30"), ["series", "period"])


@query(f"""WITH o AS (SELECT series, period, SUM(value) AS value FROM {OBSERVED} WHERE series < 3 AND available_at <= TIMESTAMP '2000-06-30' GROUP BY 1, 2), w AS (SELECT period, MAX(value) FILTER (series = 0) AS a, MAX(value) FILTER (series = 1) AS b, MAX(value) FILTER (series = 2) AS c FROM o GROUP BY 1)
SELECT period, a AS s0, b AS s1, c AS s2 FROM w WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL""")
def observation_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series side by side over the periods that all have."""
    seen = panels.visible(_observed(spark, sf_dir), "2000-06-30").groupBy("series", "period").agg(F.sum("value").alias("value"))
    return panels.frame(seen, ["0", "1", "2"]).toDF("period", "s0", "s1", "s2")


VOTES = "(SELECT l_orderkey AS rollcall, l_suppkey AS member, CASE WHEN l_suppkey % 2 = 0 THEN 'D' ELSE 'R' END AS party, CASE l_returnflag WHEN 'R' THEN 'yea' WHEN 'A' THEN 'nay' ELSE CASE WHEN l_quantity > 25 THEN 'yea' WHEN l_quantity > 5 THEN 'nay' ELSE 'present' END END AS position FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_linenumber, l_partkey, l_extendedprice DESC, l_quantity DESC, l_returnflag DESC) AS k FROM lineitem) WHERE k = 1)"


@query(f"""WITH c AS (SELECT * FROM {VOTES} WHERE position <> 'present'), p AS (SELECT rollcall, party, SUM(CASE position WHEN 'yea' THEN 1 ELSE -1 END) AS lean FROM c GROUP BY 1, 2 HAVING SUM(CASE position WHEN 'yea' THEN 1 ELSE -1 END) <> 0),
u AS (SELECT rollcall FROM p GROUP BY 1 HAVING COUNT(*) = 2 AND MIN(lean) < 0 AND MAX(lean) > 0)
SELECT member, c.party, COUNT(*) AS unity_votes, COUNT(*) FILTER ((position = 'yea') <> (lean > 0)) AS defections FROM c JOIN u USING (rollcall) JOIN p ON p.rollcall = c.rollcall AND p.party = c.party GROUP BY 1, 2""")
def member_panel_defections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes on which the parties oppose each other, and those against one's own party."""
    line = read(spark, sf_dir, "lineitem")
    one = panels.latest_filing(line.withColumns({"_a": -F.col("l_linenumber"), "_b": -F.col("l_partkey")}), ["l_orderkey", "l_suppkey"], "_a", "_b", "l_extendedprice", "l_quantity", "l_returnflag")
    by_flag = F.when(F.col("l_returnflag") == "R", "yea").when(F.col("l_returnflag") == "A", "nay").when(F.col("l_quantity") > 25, "yea").when(F.col("l_quantity") > 5, "nay").otherwise("present")
    votes = one.select(F.col("l_orderkey").alias("rollcall"), F.col("l_suppkey").alias("member"), F.when(F.col("l_suppkey") % 2 == 0, "D").otherwise("R").alias("party"), by_flag.alias("position"))
    return panels.party_unity(votes)


@query("""WITH h AS (SELECT l_partkey AS issuer, year(l_shipdate) AS period, l_suppkey AS holder, SUM(CAST(l_extendedprice AS DECIMAL(18,2)))::DOUBLE AS v FROM lineitem GROUP BY ALL)
SELECT issuer, period, COUNT(*) AS holders, ROUND(SUM(v), 2) AS held, ROUND(MAX(v) / SUM(v), 9) AS top_share, ROUND(SUM(v * v) / (SUM(v) * SUM(v)), 9) AS hhi FROM h GROUP BY 1, 2""")
def issuer_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who holds an issuer in a year, and how concentrated that is."""
    line = read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("issuer"), F.year("l_shipdate").alias("period"), F.col("l_suppkey").alias("holder")).agg(F.sum(money("l_extendedprice")).cast("double").alias("value"))
    out = panels.issuer_panel(line, "issuer", "period", "holder", "value")
    return out.select("issuer", "period", "holders", F.round("held", 2).alias("held"), F.round("top_share", 9).alias("top_share"), F.round("hhi", 9).alias("hhi"))


@query("""WITH h AS (SELECT DISTINCT l_suppkey AS h, l_partkey % 50 AS i, year(l_shipdate) AS p FROM lineitem), f AS (SELECT DISTINCT h, p FROM h), b AS (SELECT x.h, x.p FROM f x JOIN f y ON y.h = x.h AND y.p = x.p - 1), n AS (SELECT p, COUNT(*) AS filers FROM b GROUP BY 1),
o AS (SELECT i, h.p, COUNT(*) AS opened FROM h JOIN b ON b.h = h.h AND b.p = h.p WHERE NOT EXISTS (FROM h z WHERE z.h = h.h AND z.i = h.i AND z.p = h.p - 1) GROUP BY 1, 2), q AS (SELECT i, z.p + 1 AS p, COUNT(*) AS held FROM h z JOIN b ON b.h = z.h AND b.p = z.p + 1 GROUP BY 1, 2)
SELECT o.i AS item, o.p AS period, opened, ROUND(opened::DOUBLE / NULLIF(filers - COALESCE(held, 0), 0), 9) AS rate FROM o JOIN n USING (p) LEFT JOIN q ON q.i = o.i AND q.p = o.p""")
def entry_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many holders open a position, of those who could."""
    h = read(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_partkey") % 50).alias("item"), F.year("l_shipdate").alias("y"))
    return panels.entry_rates(h, "l_suppkey", "item", "y").withColumn("rate", F.round("rate", 9))


@query("""WITH t AS (SELECT p_size % 10 AS k, 1995 + p_size % 10 % 4 * 2 AS year, MAX(p_retailprice) AS rate FROM part GROUP BY 1, 2), f AS (SELECT DISTINCT l_partkey % 10 AS k, year(l_shipdate) AS y FROM lineitem)
SELECT k, y, (SELECT ROUND(MAX_BY(rate, year), 4) FROM t WHERE t.k = f.k AND year <= y) AS rate, y - (SELECT MAX(year) FROM t WHERE t.k = f.k AND year <= y) AS age FROM f""")
def tariff_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows with the last tariff at or before their year."""
    t = read(spark, sf_dir, "part").groupBy((F.col("p_size") % 10).cast("long").alias("k"), (1995 + F.col("p_size") % 10 % 4 * 2).cast("int").alias("year")).agg(F.max("p_retailprice").alias("rate"))
    f = read(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 10).alias("k"), F.year("l_shipdate").alias("y")).distinct()
    return panels.tariff_for(f, t, ["k"], "y").withColumn("rate", F.round("rate", 4))


@query("SELECT c_custkey AS id, lat, lon FROM (SELECT c_custkey, c_nationkey * 5 - 60 AS lat, c_custkey % 360 - 180 AS lon FROM customer) WHERE lat BETWEEN -20 AND 40 AND (lon >= 150 OR lon <= -160)")
def points_in_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in a box across the date line."""
    cells = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_nationkey") * 5 - 60).alias("lat"), (F.col("c_custkey") % 360 - 180).alias("lon"))
    return panels.in_box(cells, 150, -20, -160, 40)


@query("SELECT id, area FROM (SELECT p_partkey AS id, p_size - 30 AS west, p_size % 7 - 3 AS south, p_partkey % 40 AS east, p_partkey % 9 AS north, (p_partkey % 40 - p_size + 30) * (p_partkey % 9 - p_size % 7 + 3) AS area FROM part) WHERE west <= 5 AND east >= 5 AND south <= 1 AND north >= 1")
def boxes_containing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes that hold a point."""
    boxes = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") - 30).alias("west"), (F.col("p_size") % 7 - 3).alias("south"), (F.col("p_partkey") % 40).alias("east"), (F.col("p_partkey") % 9).alias("north"))
    return panels.containing(boxes, 5, 1).select("id", "area")


@query("""WITH t AS (SELECT c_nationkey, c_mktsegment, c_custkey, ROW_NUMBER() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS turn FROM customer), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY c_nationkey ORDER BY turn, c_mktsegment, c_custkey) AS place FROM t) SELECT c_nationkey, c_mktsegment, c_custkey, place FROM r WHERE place <= 7""")
def round_robin_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven customers a nation, segments in turn."""
    rows = read(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment", "c_custkey")
    return panels.round_robin(rows, ["c_nationkey"], "c_mktsegment", ["c_custkey"], 7).select("c_nationkey", "c_mktsegment", "c_custkey", "place")


@query("""WITH w AS (SELECT s_nationkey AS k, s_suppkey AS u, s_suppkey % 13 + 1 AS weight, 101 AS total FROM supplier), e AS (SELECT *, total * weight / SUM(weight) OVER (PARTITION BY k)::DOUBLE AS e FROM w), f AS (SELECT *, floor(e) AS f, total - SUM(floor(e)) OVER (PARTITION BY k) AS rest FROM e),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY k ORDER BY e - f DESC, u) AS i FROM f) SELECT k, u, CAST(f + CASE WHEN i <= rest THEN 1 ELSE 0 END AS BIGINT) AS share FROM r""")
def largest_remainders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole number dealt out in proportion to weights."""
    w = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("u"), (F.col("s_suppkey") % 13 + 1).alias("weight"), F.lit(101).alias("total"))
    return panels.largest_remainder(w, ["k"], "u", "total").select("k", "u", "share")


@query("""WITH o AS (SELECT p_brand AS s, p_type AS c, MAX(p_retailprice) AS v FROM part GROUP BY ALL), m AS (SELECT s, AVG(v) AS mean, MIN(v) AS worst, COUNT(*) AS n FROM o GROUP BY 1),
d AS (SELECT a.s, b.s AS t FROM o a JOIN o b ON a.c = b.c AND a.s <> b.s GROUP BY 1, 2 HAVING MIN(a.v - b.v) >= 0 AND MAX(a.v - b.v) > 0) SELECT m.s AS strategy, ROUND(mean, 6) AS mean, worst, n AS scenarios, (SELECT COUNT(*) FROM d WHERE d.s = m.s) AS dominates FROM m""")
def strategy_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strategies by mean and worst outcome, and how many others each dominates."""
    o = read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("strategy"), F.col("p_type").alias("scenario")).agg(F.max("p_retailprice").alias("value"))
    return panels.compare_strategies(o).withColumn("mean", F.round("mean", 6))


@query("""SELECT p_partkey, ROUND(1000 * c * (1 - pow(1 + y, -n)) / y + 1000 * pow(1 + y, -n), 6) AS bond, ROUND((1 - exp(-n * 0.5)) / (n * 0.5), 9) AS slope, ROUND((1 - exp(-n * 0.5)) / (n * 0.5) - exp(-n * 0.5), 9) AS curvature, ROUND(1 + 0.25 * least(1.0, p_partkey * 10 / 3652.5::DOUBLE), 9) AS duration, ROUND(CASE WHEN n > 1 THEN pow(n - 1, -0.5) ELSE 0 END, 9) AS selectivity,
ROUND(50 * least(1.0, sqrt(20 / (n * 5.0::DOUBLE))), 9) AS wind, ROUND(-ln(exp(-2 * c * 10) + exp(-2 * y * 10) + exp(-2 * n / 10.0::DOUBLE)) / 2, 9) AS viability FROM (SELECT p_partkey, (p_partkey % 9 + 1) / 100.0::DOUBLE AS c, (p_partkey % 7 + 1) / 100.0::DOUBLE AS y, p_size AS n FROM part)""")
def valuation_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bond values, yield-curve loadings, and the weights that affinity, storms and margins use."""
    c, y, n = (F.col("p_partkey") % 9 + 1) / 100.0, (F.col("p_partkey") % 7 + 1) / 100.0, F.col("p_size")
    _, slope, curvature = panels.curve_loadings(n, 0.5)
    cols = {"bond": F.round(panels.bond_value(F.lit(1000.0), c, y, n), 6), "slope": F.round(slope, 9), "curvature": F.round(curvature, 9), "duration": F.round(panels.duration_multiplier(F.col("p_partkey") * 10), 9), "selectivity": F.round(panels.selectivity(n, 0.5), 9)}
    cols |= {"wind": F.round(panels.modelled_wind(F.lit(50.0), n * 5.0, F.lit(20.0)), 9), "viability": F.round(panels.soft_viability(F.array(c * 10, y * 10, n / 10.0), 2.0), 9)}
    return read(spark, sf_dir, "part").select("p_partkey", *[v.alias(k) for k, v in cols.items()])


@query("""WITH b AS (SELECT o_orderkey // 2 AS batch, o_custkey % 50 AS account, MIN(o_orderkey) AS seq, MIN(o_orderkey // 2 % 100) AS lo FROM orders GROUP BY 1, 2) SELECT account, batch, seq, CAST(SUM(lo) OVER (PARTITION BY account ORDER BY seq, batch ROWS UNBOUNDED PRECEDING) AS BIGINT) AS balance, FALSE AS conflict FROM b""")
def ledger_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances in which a batch counts once, however often it was sent."""
    half = F.expr("o_orderkey div 2")
    b = read(spark, sf_dir, "orders").select(half.alias("batch"), (F.col("o_custkey") % 50).alias("account"), F.col("o_orderkey").alias("seq"), (half % 100).alias("amount"))
    return panels.ledger(b, "account", "amount")


@query("""WITH f AS (SELECT c_nationkey % 3 AS i, c_custkey % 4 AS j, COUNT(*)::DOUBLE AS v FROM customer GROUP BY ALL), n AS (SELECT COUNT(*)::DOUBLE AS n FROM customer) SELECT i, ROUND(n / 3, 4) AS row_total FROM f, n GROUP BY i, n""")
def balanced_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows scaled until every origin has a third and every destination a quarter of the whole: the origins' totals."""
    s = read(spark, sf_dir, "customer")
    n = s.count()
    flows = s.groupBy((F.col("c_nationkey") % 3).alias("i"), (F.col("c_custkey") % 4).alias("j")).agg(F.count("*").alias("flow"))
    rows, columns = flows.select("i").distinct().withColumn("total", F.lit(n / 3)), flows.select("j").distinct().withColumn("total", F.lit(n / 4))
    out = panels.balance_flows(flows, rows, columns, Staging(spark, "balance"))
    return out.groupBy("i").agg(F.round(F.sum("flow"), 4).alias("row_total"))
