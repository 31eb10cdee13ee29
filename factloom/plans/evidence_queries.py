"""Queries on records, point-in-time reading, graphs and time, each with its oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from factloom.operators import asof, evidence, graph, temporal
from factloom.operators.staging import Staging
from factloom.plans.tables import EDGES_SQL, PLACED_SQL, SUPPLIES_SQL, edges, money, placed, read, supplies

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


LIVE = "valid_from <= TIMESTAMP '1999-01-01' AND (valid_to IS NULL OR valid_to > TIMESTAMP '1999-01-01')"
KNOWN = "published_at IS NOT NULL AND published_at <= TIMESTAMP '1999-06-01'"
POLICY = asof.AsOf("1999-01-01", "1999-06-01")


@query(f"SELECT subject, CAST(SUM(weight) AS DOUBLE) AS total, COUNT(*) AS n FROM {SUPPLIES_SQL} WHERE {LIVE} AND {KNOWN} GROUP BY subject ORDER BY SUM(weight) DESC, subject LIMIT 20")
def flow_by_subject_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.flow(POLICY.read(supplies(spark, sf_dir)), ["subject"], 20).withColumn("total", F.col("total").cast("double"))


@query(f"SELECT dataset, COUNT(*) AS n_withheld FROM {EDGES_SQL} WHERE {LIVE} AND published_at IS NULL GROUP BY dataset")
def exclusion_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return POLICY.report(edges(spark, sf_dir))


@query(f"SELECT dataset, predicate, COUNT(*) AS n, CAST(SUM(weight) AS DOUBLE) AS total FROM {EDGES_SQL} WHERE {LIVE} AND {KNOWN} GROUP BY ALL")
def asof_exclude_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return POLICY.read(edges(spark, sf_dir)).groupBy("dataset", "predicate").agg(F.count("*").alias("n"), F.sum("weight").cast("double").alias("total"))


@query(f"SELECT dataset, predicate, COUNT(*) AS n, CAST(SUM(weight) AS DOUBLE) AS total FROM {EDGES_SQL} WHERE {LIVE} AND (published_at IS NULL OR published_at <= TIMESTAMP '1999-06-01') GROUP BY ALL")
def asof_include_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    read_all = asof.AsOf("1999-01-01", "1999-06-01", include_unknown=True)
    return read_all.read(edges(spark, sf_dir)).groupBy("dataset", "predicate").agg(F.count("*").alias("n"), F.sum("weight").cast("double").alias("total"))


@query(f"SELECT dataset, COUNT(*) AS n, COUNT(published_at) AS dated, MIN(published_at) AS first_date, MAX(published_at) AS last_date, ROUND(COUNT(published_at)::DOUBLE / COUNT(*), 6) AS share FROM {EDGES_SQL} GROUP BY ROLLUP(dataset)")
def publication_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asof.publication_coverage(edges(spark, sf_dir))


@query("""WITH x AS (SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 10 DAY END AS a,
 CASE WHEN o_orderstatus = 'O' AND o_orderpriority NOT LIKE '1%' THEN o_orderdate + INTERVAL 20 DAY END AS r,
 CASE WHEN o_orderpriority NOT LIKE '5%' THEN CAST(last_day(CAST(o_orderdate AS DATE) + INTERVAL 2 MONTH) AS TIMESTAMP) END AS u FROM orders)
SELECT k AS order_key, COALESCE(a, r, u) AS published_at, CASE WHEN a IS NOT NULL THEN 'available_at' WHEN r IS NOT NULL THEN 'realtime_start' WHEN u IS NOT NULL THEN 'rule' END AS source FROM x""")
def publication_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    by_rule = F.when(~F.col("o_orderpriority").startswith("5"), asof.rule_publication(F.col("o_orderdate"), F.lit(None).cast("timestamp_ntz"), F.lit(2)))
    available = F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate") + F.expr("interval 10 days"))
    realtime = F.when(F.col("o_orderstatus") == "O", F.col("o_orderdate") + F.expr("interval 20 days"))
    date, source = asof.publication(available, realtime, F.col("o_orderpriority").startswith("1"), by_rule)
    return o.select(F.col("o_orderkey").alias("order_key"), date.alias("published_at"), source.alias("source"))


@query("""SELECT 'interval_not_positive' AS rule, COUNT(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate >= l_shipdate
UNION ALL SELECT 'confidence_out_of_range', COUNT(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_discount * 12 > 1""")
def validate_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    r = j.select(F.col("o_orderdate").alias("valid_from"), F.col("l_shipdate").alias("valid_to"), (F.col("l_discount") * 12).alias("confidence"))
    return evidence.violations(r).select(F.explode("violations").alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


@query("""SELECT 'customer:' || c_custkey AS subject, metric, CAST(v AS DOUBLE) AS value, unit FROM (
 SELECT c_custkey, 'balance' AS metric, 'USD' AS unit, c_acctbal AS v FROM customer UNION ALL SELECT c_custkey, 'nation', 'code', c_nationkey FROM customer)""")
def normalize_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    out = evidence.normalize(c, F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")), {"c_acctbal": ("balance", "USD"), "c_nationkey": ("nation", "code")}, ["c_custkey"], "customer")
    return out.select("subject", "metric", "value", "unit")


@query("""SELECT 'view:' || sha256(ref || '|' || id) AS id, ref || '/' || id AS parent, label FROM (
 SELECT 'customers' AS ref, 'customer:' || c_custkey AS id, c_name AS label FROM customer UNION ALL SELECT 'suppliers', 'supplier:' || s_suppkey, s_name FROM supplier)""")
def union_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("label"))
    s = read(spark, sf_dir, "supplier").select(F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("label"))
    return evidence.union_evidence(("customers", c), ("suppliers", s)).select("id", "parent", "label")


PROFILED = ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", COUNT(*) AS n, COUNT(*) FILTER ({c} IS NULL OR {c}::VARCHAR = '') AS missing, COUNT(DISTINCT {c}) AS distinct_values FROM orders" for c in PROFILED))
def profile_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.profile(read(spark, sf_dir, "orders").select(*PROFILED))


@query("SELECT l_orderkey, l_linenumber, COUNT(*) AS n FROM lineitem GROUP BY ALL HAVING COUNT(*) > 1")
def audit_duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.duplicate_ids(read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def audit_missing_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.missing_parents(read(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey", read(spark, sf_dir, "orders"), "o_custkey")


@query(f"SELECT dataset, predicate, COUNT(*) AS n FROM {EDGES_SQL} GROUP BY ALL")
def index_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir).groupBy("dataset", "predicate").agg(F.count("*").alias("n"))


# Graph


@query(f"SELECT node, COUNT(*) AS degree, CAST(SUM(weight) AS DOUBLE) AS weight FROM (SELECT subject AS node, weight FROM {SUPPLIES_SQL} UNION ALL SELECT object, weight FROM {SUPPLIES_SQL}) GROUP BY node")
def degree_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degree(supplies(spark, sf_dir)).withColumn("weight", F.col("weight").cast("double"))


@query(f"SELECT subject, object, CAST(SUM(weight) AS DOUBLE) AS total, COUNT(*) AS n FROM {SUPPLIES_SQL} GROUP BY subject, object ORDER BY SUM(weight) DESC, subject, object LIMIT 50")
def flow_by_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.flow(supplies(spark, sf_dir), ["subject", "object"], 50).withColumn("total", F.col("total").cast("double"))


@query(f"""WITH e AS (SELECT DISTINCT subject, object FROM {SUPPLIES_SQL}), n0 AS (SELECT 'supplier:1' AS node),
n1 AS (SELECT object AS node FROM e WHERE subject IN (FROM n0) UNION SELECT node FROM n0)
SELECT subject, object FROM e WHERE subject IN (FROM n1) OR object IN (FROM n1)""")
def neighborhood_2hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = supplies(spark, sf_dir).select("subject", "object")
    return graph.neighborhood(e, spark.range(1).select(F.lit("supplier:1").alias("node")), 2, Staging(spark, "graph")).select("subject", "object")


BOTH = f"(SELECT DISTINCT subject AS a, object AS b FROM {SUPPLIES_SQL} UNION SELECT object, subject FROM {SUPPLIES_SQL})"


@query(f"""WITH e AS {BOTH}, d0 AS (SELECT 'supplier:3' AS node, 0 AS hop), d1 AS (SELECT DISTINCT b AS node, 1 AS hop FROM e WHERE a = 'supplier:3'),
d2 AS (SELECT DISTINCT b AS node, 2 AS hop FROM e JOIN d1 ON a = node WHERE b NOT IN (SELECT node FROM d0) AND b NOT IN (SELECT node FROM d1)),
d3 AS (SELECT DISTINCT b AS node, 3 AS hop FROM e JOIN d2 ON a = node WHERE b NOT IN (SELECT node FROM d1) AND b NOT IN (SELECT node FROM d2)),
d AS (FROM d0 UNION ALL FROM d1 UNION ALL FROM d2 UNION ALL FROM d3)
SELECT d.node, d.hop, MIN(p.node) AS parent FROM d LEFT JOIN e ON e.b = d.node LEFT JOIN d p ON p.node = e.a AND p.hop = d.hop - 1 GROUP BY d.node, d.hop""")
def shortest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.shortest_paths(supplies(spark, sf_dir), "supplier:3", 3, Staging(spark, "graph"), "both")


def _pagerank_sql(rounds: int) -> str:
    steps = [f"e AS (SELECT subject AS a, object AS b, SUM(greatest(weight, 0))::DOUBLE AS w FROM {EDGES_SQL} WHERE subject <> object GROUP BY 1, 2)", f"n AS (SELECT subject AS node FROM {EDGES_SQL} UNION SELECT object FROM {EDGES_SQL})", "f AS (SELECT a, SUM(w) AS t FROM e GROUP BY a)", "c AS (SELECT COUNT(*) AS n FROM n)", "r0 AS (SELECT node, 1.0::DOUBLE / (SELECT n FROM c) AS rank FROM n)"]
    for i in range(1, rounds + 1):
        steps.append(f"l{i} AS (SELECT SUM(rank) AS lost FROM r{i - 1} WHERE node NOT IN (SELECT a FROM e))")
        steps.append(f"g{i} AS (SELECT e.b AS node, SUM(r.rank * e.w / f.t) AS got FROM e JOIN f ON f.a = e.a JOIN r{i - 1} r ON r.node = e.a GROUP BY e.b)")
        steps.append(f"r{i} AS (SELECT n.node, (0.15 + 0.85 * lost) / (SELECT n FROM c) + 0.85 * COALESCE(got, 0) AS rank FROM n CROSS JOIN l{i} LEFT JOIN g{i} g ON g.node = n.node)")
    return f"WITH {', '.join(steps)} SELECT node, ROUND(rank, 12) AS rank FROM r{rounds}"


@query(_pagerank_sql(5))
def pagerank_k_iterations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted PageRank of suppliers, parts, customers and orders after five rounds."""
    return graph.pagerank(edges(spark, sf_dir), 5, Staging(spark, "graph"), tolerance=0.0).select("node", F.round("rank", 12).alias("rank"))


SAME = "(SELECT DISTINCT c_custkey AS a, c_custkey + 1 AS b FROM customer WHERE c_custkey % 7 IN (1, 2, 4))"


def same_as(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").where("c_custkey % 7 in (1, 2, 4)").select(F.col("c_custkey").alias("a"), (F.col("c_custkey") + 1).alias("b"))


@query(f"""WITH RECURSIVE e AS (SELECT a, b FROM {SAME} UNION SELECT b, a FROM {SAME}), w AS (SELECT a AS entity, a AS c FROM e UNION SELECT w.entity, e.b FROM w JOIN e ON w.c = e.a)
SELECT entity, MIN(c) AS canonical FROM w GROUP BY entity""")
def identity_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.identity_clusters(same_as(spark, sf_dir), Staging(spark, "graph"))


@query(f"""WITH RECURSIVE e AS (SELECT a, b FROM {SAME} UNION SELECT b, a FROM {SAME}), w AS (SELECT a AS entity, a AS c FROM e UNION SELECT w.entity, e.b FROM w JOIN e ON w.c = e.a),
k AS (SELECT 'customer:' || entity AS entity, 'customer:' || MIN(c) AS canonical FROM w GROUP BY entity)
SELECT COALESCE(k.canonical, p.subject) AS node, COUNT(*) AS degree, CAST(SUM(p.weight) AS DOUBLE) AS weight FROM {PLACED_SQL} p LEFT JOIN k ON k.entity = p.subject GROUP BY 1""")
def resolved_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = lambda c: F.concat(F.lit("customer:"), F.col(c).cast("string")).alias(c)
    known = graph.identity_clusters(same_as(spark, sf_dir), Staging(spark, "graph")).select(named("entity"), named("canonical"))
    return graph.degree(graph.resolved(placed(spark, sf_dir), known), "out").withColumn("weight", F.col("weight").cast("double"))


# Time


@query("""SELECT e.event_id, (SELECT MAX_BY(value, (x.ts, value)) FROM events x WHERE x.user_id = e.user_id AND x.event_type = 'view' AND x.ts <= e.ts AND x.ts >= e.ts - INTERVAL 2 DAY AND x.value IS NOT NULL) AS value FROM events e WHERE e.event_type = 'purchase'""")
def asof_join_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    views = e.where("event_type = 'view' and value is not null").select("user_id", F.col("ts").alias("seen_at"), "value")
    buys = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return asof.asof_join(buys, views, ["user_id"], "ts", "seen_at", ["value"], "2 days", 2).select("event_id", "value")


@query("""SELECT o_orderkey, event_id FROM orders JOIN (SELECT event_id, user_id, ts - INTERVAL 9500 DAY AS ts FROM events) e
ON o_custkey = user_id AND ts >= o_orderdate AND ts < o_orderdate + INTERVAL 45 DAY""")
def interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("k"), (F.col("ts") - F.expr("interval 9500 days")).alias("ts"))
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("f"), (F.col("o_orderdate") + F.expr("interval 45 days")).alias("t"))
    return asof.interval_join(e, o, ["k"], "ts", "f", "t", 30).select("o_orderkey", "event_id")


FACTS = "(SELECT l_partkey AS part, l_suppkey AS supplier, l_shipdate AS t, MAX(CAST(l_quantity AS BIGINT)) AS v FROM lineitem GROUP BY ALL)"


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"), F.col("l_shipdate").alias("t")).agg(F.max(F.col("l_quantity").cast("long")).alias("v"))


@query(f"""WITH l AS (SELECT *, LAG(v) OVER w IS DISTINCT FROM v OR ROW_NUMBER() OVER w = 1 AS c FROM {FACTS} WINDOW w AS (PARTITION BY part, supplier ORDER BY t)),
r AS (SELECT *, SUM(c::BIGINT) OVER (PARTITION BY part, supplier ORDER BY t) AS run FROM l)
SELECT part, supplier, CAST(run AS BIGINT) AS run, MIN(t) AS available_at, MIN(v) AS v, COUNT(*) - 1 AS confirmations, CASE WHEN run = 1 THEN 'first_report' ELSE 'restated' END AS status FROM r GROUP BY part, supplier, run""")
def vintages_change_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.vintages(facts(spark, sf_dir), ["part", "supplier"], "v", "t")


@query(f"SELECT part, supplier, ARG_MIN(v, t) AS first_value, MIN(t) AS first_at, COUNT(DISTINCT v) > 1 AS revised FROM {FACTS} GROUP BY ALL")
def first_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.first_release(facts(spark, sf_dir), ["part", "supplier"], "v", "t")


@query("""SELECT event_type, CAST(date_trunc('month', ts) AS DATE) AS period, COUNT(*) AS n, CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total, ARG_MAX(value, (ts, value)) AS last FROM events
GROUP BY event_type, CAST(date_trunc('month', ts) AS DATE) HAVING CAST(date_trunc('month', ts) AS DATE) + INTERVAL 1 MONTH <= DATE '2024-02-01'""")
def resample_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").withColumn("amount", money("value"))
    out = temporal.resample(e, ["event_type"], "ts", "amount", "month", "2024-02-01")
    return out.select("event_type", "period", "n", F.col("total").cast("double").alias("total"), F.col("last").cast("double").alias("last"))


MONTHS = "(SELECT o_orderpriority AS p, year(o_orderdate) AS y, month(o_orderdate) AS m, SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS v FROM orders GROUP BY ALL)"


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("p"), F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m")).agg(F.sum(money("o_totalprice")).alias("v"))


@query(f"WITH c AS (SELECT p, y, m, SUM(v) OVER (PARTITION BY p, y ORDER BY m) AS ytd FROM {MONTHS}) SELECT p, y, m, CAST(ytd - COALESCE(LAG(ytd) OVER (PARTITION BY p, y ORDER BY m), 0) AS DOUBLE) AS discrete FROM c")
def ytd_to_quarter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    cumulative = monthly(spark, sf_dir).withColumn("ytd", F.sum("v").over(W.partitionBy("p", "y").orderBy("m")))
    return temporal.ytd_to_discrete(cumulative, ["p", "y"], "m", "ytd").select("p", "y", "m", F.col("discrete").cast("double").alias("discrete"))


@query(f"SELECT p, y, m, CASE WHEN COUNT(*) OVER w = 6 THEN ROUND(SQRT(AVG(v::DOUBLE * v::DOUBLE) OVER w), 2) END AS rms FROM {MONTHS} WINDOW w AS (PARTITION BY p ORDER BY y, m ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)")
def rolling_rms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = monthly(spark, sf_dir).withColumn("v", F.col("v").cast("double"))
    return temporal.trailing_rms(rows, ["p"], ["y", "m"], "v", 6).select("p", "y", "m", F.round("rms", 2).alias("rms"))


@query("SELECT c_custkey, CAST(FLOOR((ROW_NUMBER() OVER w - 1) * 7.0 / COUNT(*) OVER (PARTITION BY c_mktsegment)) AS BIGINT) AS part FROM customer WINDOW w AS (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey)")
def split_by_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.split_by_rank(read(spark, sf_dir, "customer"), ["c_acctbal", "c_custkey"], 7, ["c_mktsegment"]).select("c_custkey", "part")


@query("SELECT p_partkey, RANK() OVER (PARTITION BY p_brand ORDER BY p_size) + (COUNT(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0::DOUBLE AS r FROM part")
def avg_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", temporal.average_rank("p_size", ["p_brand"]).alias("r"))


@query("SELECT user_id, event_id, ts FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_type, ts DESC, event_id) AS r FROM events) WHERE r = 1")
def headline_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.headline(read(spark, sf_dir, "events"), ["user_id"], "event_type", "ts", "event_id").select("user_id", "event_id", "ts")


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice, l_extendedprice * POWER(0.5, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_suppkey, l_linenumber) - 1) AS discounted FROM lineitem")
def discounted_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = temporal.discounted(read(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_extendedprice", 0.5, "l_partkey", "l_suppkey", "l_linenumber")
    return out.select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "discounted")


@query(f"SELECT p, y, m, ROUND(LN(v::DOUBLE) - LAG(LN(v::DOUBLE), 12) OVER (PARTITION BY p ORDER BY y, m), 9) AS diff FROM {MONTHS}")
def seasonal_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = monthly(spark, sf_dir).withColumn("v", F.col("v").cast("double"))
    return temporal.seasonal_difference(rows, ["p"], ["y", "m"], "v", 12, True).select("p", "y", "m", F.round("diff", 9).alias("diff"))


@query("SELECT o_orderpriority, year(o_orderdate) AS year, ROUND(SUM(CAST(o_totalprice AS DECIMAL(18,2)))::DOUBLE / COUNT(*), 4) AS mean FROM orders GROUP BY ALL HAVING COUNT(DISTINCT month(o_orderdate)) = 12")
def complete_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.complete_years(read(spark, sf_dir, "orders").withColumn("o_totalprice", money("o_totalprice")), ["o_orderpriority"], "o_orderdate", "o_totalprice").withColumn("mean", F.round("mean", 4))
