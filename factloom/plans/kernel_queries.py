"""Queries on iterated systems, each with its oracle where SQL has one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from factloom.operators import kernels
from factloom.operators.staging import Staging
from factloom.plans.analysis_queries import SHARES, shares
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


LISTED = "(SELECT 'supplier:' || s_suppkey AS entity FROM supplier WHERE s_acctbal < 0)"


def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("entity"))


@query(f"SELECT entity, 1.0::DOUBLE AS exposure FROM {LISTED} UNION ALL SELECT object, ROUND(LEAST(1.0, SUM(share)), 9) FROM {SHARES} WHERE subject IN (FROM {LISTED}) GROUP BY object")
def look_through(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.look_through(shares(spark, sf_dir), listed(spark, sf_dir), Staging(spark, "kernel")).select("entity", F.round("exposure", 9).alias("exposure"))


@query()
def clearing(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    debts = o.select((F.col("o_custkey") % 97).alias("borrower"), ((F.col("o_custkey") * 31 + 7) % 97).alias("lender"), F.col("o_totalprice").alias("amount")).where("borrower <> lender")
    cash = spark.range(0, 97).select("id", (F.col("id") * 400.0).alias("cash"))
    out = kernels.clearing(debts, cash, Staging(spark, "kernel"))
    return out.select("id", *[F.round(c, 2).alias(c) for c in ("due", "paid", "shortfall")])


FIELD = [
    "l AS (SELECT DISTINCT c_nationkey AS a, (c_nationkey * 7 + 3) % 25 AS b FROM customer)",
    "n AS (SELECT a AS id, b AS o FROM l WHERE a <> b UNION ALL SELECT b, a FROM l WHERE a <> b)",
    "s0 AS (SELECT n_nationkey AS id, n_nationkey * 10.0::DOUBLE AS v FROM nation)",
]


def _field(steps: int) -> str:
    parts = list(FIELD)
    for i in range(1, steps + 1):
        parts.append(f"s{i} AS (SELECT x.id, x.v + 0.1 * COALESCE((SELECT SUM(0.5 * (y.v - x.v)) FROM n JOIN s{i - 1} y ON y.id = n.o WHERE n.id = x.id), 0) / 2 AS v FROM s{i - 1} x)")
    return f"WITH {', '.join(parts)} SELECT id, ROUND(v, 9) AS value FROM s{steps}"


@query(_field(3))
def field_flux_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.lit(2.0).alias("measure"), (F.col("n_nationkey") * 10.0).alias("value"))
    links = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("source"), ((F.col("c_nationkey") * 7 + 3) % 25).alias("target"), F.lit(0.5).alias("conductance")).distinct().where("source <> target")
    return kernels.diffuse(cells, links, 3, 0.1, Staging(spark, "kernel")).select("id", F.round("value", 9).alias("value"))


ROADS = "(SELECT DISTINCT 'n' || c_nationkey AS a, 'n' || (c_nationkey * 7 + c_custkey % 3 + 1) % 25 AS b, (c_nationkey % 5 + c_custkey % 3 + 1)::DOUBLE AS w FROM customer)"


@query(f"""WITH RECURSIVE e AS {ROADS}, r AS (SELECT 'n0' AS node, 0.0::DOUBLE AS cost, 0 AS k UNION ALL SELECT b, MIN(cost + w), MIN(k) + 1 FROM r JOIN e ON a = node WHERE k < 12 GROUP BY b)
SELECT node, MIN(cost) AS cost FROM r GROUP BY node""")
def route(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = F.col("c_nationkey"), F.col("c_custkey") % 3
    roads = read(spark, sf_dir, "customer").select(F.concat(F.lit("n"), c.cast("string")).alias("subject"), F.concat(F.lit("n"), ((c * 7 + k + 1) % 25).cast("string")).alias("object"), (c % 5 + k + 1).cast("double").alias("weight")).distinct()
    return kernels.routes(roads, "n0", Staging(spark, "kernel"))


PAYOFFS = "(SELECT p_brand AS game, p_size % 4 AS a, p_partkey % 5 AS b, MAX(p_partkey % 13) AS pay_a, MAX(p_partkey % 7) AS pay_b FROM part GROUP BY ALL)".replace("GROUP BY ALL", "GROUP BY p_brand, p_size % 4, p_partkey % 5")


@query(f"WITH m AS (SELECT *, MAX(pay_a) OVER (PARTITION BY game, b) AS x, MAX(pay_b) OVER (PARTITION BY game, a) AS y FROM {PAYOFFS}) SELECT game, a, b, pay_a, pay_b FROM m WHERE pay_a = x AND pay_b = y")
def pure_nash(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("game"), (F.col("p_size") % 4).alias("a"), (F.col("p_partkey") % 5).alias("b")).agg(F.max(F.col("p_partkey") % 13).alias("pay_a"), F.max(F.col("p_partkey") % 7).alias("pay_b"))
    return kernels.pure_nash(p)


@query("""WITH p AS (SELECT c_nationkey AS variable, SUM(c_acctbal / 1000) AS r, SUM(0.01) AS k, SUM(0.01 * (c_custkey % 100)) AS kc FROM customer GROUP BY 1)
SELECT n_nationkey AS variable, ROUND(CASE WHEN k > 0 THEN (r + kc) / k + (n_nationkey - (r + kc) / k) * exp(-k * 2.0) ELSE n_nationkey END, 6) AS value FROM nation LEFT JOIN p ON variable = n_nationkey""")
def apply_pressures(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("variable"), (F.col("c_acctbal") / 1000).alias("rate"), F.lit(0.01).alias("strength"), (F.col("c_custkey") % 100).alias("centre"))
    v = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("variable"), F.col("n_nationkey").cast("double").alias("value"))
    return kernels.apply_pressures(v, p, 2.0).select("variable", F.round("value", 6).alias("value"))


@query("""WITH d AS (SELECT n_nationkey AS id, (n_nationkey * 37 % 25 + 1)::DOUBLE AS demand, (n_nationkey % 3 + 1)::DOUBLE AS weight FROM nation), l AS (SELECT *, (150.0 - COALESCE(SUM(demand) OVER w, 0)) / (SUM(weight) OVER () - COALESCE(SUM(weight) OVER w, 0)) AS level FROM d WINDOW w AS (ORDER BY demand / weight, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT id, ROUND(LEAST(demand, (SELECT MAX(level) FROM l) * weight), 9) AS share FROM l""")
def fair_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), (F.col("n_nationkey") * 37 % 25 + 1).cast("double").alias("demand"), (F.col("n_nationkey") % 3 + 1).cast("double").alias("weight"))
    return kernels.fair_shares(d, 150.0).select("id", F.round("share", 9).alias("share"))


@query("SELECT a, b, c FROM (VALUES (1), (2), (3)) x(a), (VALUES ('p'), ('q')) y(b), (VALUES (0.5::DOUBLE), (1.5)) z(c)")
def parameter_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.expand_grid(spark, {"a": [1, 2, 3], "b": ["p", "q"], "c": [0.5, 1.5]})
