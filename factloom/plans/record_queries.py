"""Queries on identifiers, text, dates and numbers, each with its oracle where SQL has one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from factloom.functions import dates, identifiers, numeric, text
from factloom.plans.tables import money, read

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("""WITH c AS (SELECT c_custkey, lpad(CAST((c_custkey * 7919 + 1234567) % 9999999 AS VARCHAR), 7, '0') AS v FROM customer),
s AS (SELECT c_custkey, v, list_sum(list_transform(range(1, 7), lambda i: CAST(substr(v, i::INT, 1) AS INT) * (8 - i))) AS t FROM c)
SELECT c_custkey, v, CAST(t % 10 AS VARCHAR) = substr(v, 7, 1) AS ok FROM s""")
def imo_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.lpad(((F.col("c_custkey") * 7919 + 1234567) % 9999999).cast("string"), 7, "0")
    return read(spark, sf_dir, "customer").select("c_custkey", v.alias("v")).withColumn("ok", identifiers.valid_imo(F.col("v")))


@query("""WITH c AS (SELECT c_custkey, lpad(CAST((c_custkey * 104729 + 37) % 999999999 AS VARCHAR), 12, CASE WHEN c_custkey % 3 = 0 THEN '2' ELSE '1' END) || CAST(c_custkey % 10 AS VARCHAR) AS v FROM customer)
SELECT c_custkey, v, substr(v, 1, 1) IN ('1', '5') AND CAST(substr(v, 1, 12) AS BIGINT) % 11 % 10 = CAST(substr(v, 13, 1) AS INT) AS ok FROM c""")
def ogrn_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.concat(F.expr("lpad(cast((c_custkey * 104729 + 37) % 999999999 as string), 12, if(c_custkey % 3 = 0, '2', '1'))"), (F.col("c_custkey") % 10).cast("string"))
    return read(spark, sf_dir, "customer").select("c_custkey", v.alias("v")).withColumn("ok", identifiers.valid_ru_ogrn(F.col("v")))


@query("""WITH s AS (SELECT s_suppkey, lpad(CAST(s_suppkey * 48611 % 99999999 AS VARCHAR), 8, '0') AS v FROM supplier),
t AS (SELECT s_suppkey, v, list_sum(list_transform(range(1, 9), lambda i: CASE WHEN i % 2 = 0 THEN 2 * CAST(substr(v, i::INT, 1) AS INT) // 10 + 2 * CAST(substr(v, i::INT, 1) AS INT) % 10 ELSE CAST(substr(v, i::INT, 1) AS INT) END)) AS x FROM s)
SELECT s_suppkey, v, CAST((10 - x % 10) % 10 AS BIGINT) AS digit FROM t""")
def cusip_digit(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.lpad((F.col("s_suppkey") * 48611 % 99999999).cast("string"), 8, "0")
    return read(spark, sf_dir, "supplier").select("s_suppkey", v.alias("v")).withColumn("digit", identifiers.cusip_check_digit(F.col("v")).cast("long"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN lpad(CAST(s_suppkey AS VARCHAR), 8, '0') ELSE 'SC' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') END AS v FROM supplier")
def gb_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit(" "), F.col("s_suppkey").cast("string"))).otherwise(F.concat(F.lit("sc "), F.col("s_suppkey").cast("string")))
    return read(spark, sf_dir, "supplier").select("s_suppkey", identifiers.gb_company_number(raw).alias("v"))


@query("SELECT x.s_suppkey AS a, y.s_suppkey AS b, ROUND(jaro_winkler_similarity(x.n, y.n), 9) AS similarity FROM (SELECT s_suppkey, s_name || CASE WHEN s_suppkey % 3 = 0 THEN ' Ltd' ELSE '' END AS n FROM supplier) x JOIN (SELECT s_suppkey, replace(s_name, 'pp', 'p') AS n FROM supplier) y ON y.s_suppkey = x.s_suppkey + 1")
def jaro_winkler_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier")
    x = s.select(F.col("s_suppkey").alias("a"), F.concat("s_name", F.when(F.col("s_suppkey") % 3 == 0, " Ltd").otherwise("")).alias("x"))
    y = s.select((F.col("s_suppkey") - 1).alias("a"), F.col("s_suppkey").alias("b"), F.replace("s_name", F.lit("pp"), F.lit("p")).alias("y"))
    return x.join(y, "a").select("a", "b", F.round(text.jaro_winkler("x", "y"), 9).alias("similarity"))


@query("""WITH t AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '')) AS w FROM benchmark)
SELECT a.item_id AS a, b.item_id AS b, ROUND(len(list_intersect(a.w, b.w)) / len(list_distinct(a.w || b.w)), 9) AS jaccard FROM t a JOIN t b ON b.item_id = a.item_id + 1""")
def token_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("a"), text.tokens(F.col("text")).alias("x"))
    y = t.select((F.col("a") - 1).alias("a"), F.col("a").alias("b"), F.col("x").alias("y"))
    return t.join(y, "a").select("a", "b", F.round(text.token_jaccard(F.col("x"), F.col("y")), 9).alias("jaccard"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey // 10 = 0 THEN '31-33' WHEN n_nationkey // 10 = 1 THEN '44-45' ELSE '22' END AS sector FROM nation")
def naics_sector(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.element_at(F.array(F.lit("321113"), F.lit("452210"), F.lit("221112")), F.expr("cast(n_nationkey div 10 as int)") + 1)
    return read(spark, sf_dir, "nation").select("n_nationkey", identifiers.naics_parent(code, 2).alias("sector"))


@query("""SELECT o_orderkey, last_day(CAST(date_trunc('quarter', o_orderdate) AS DATE) + INTERVAL 2 MONTH) AS quarter_end, year(o_orderdate) * 12 + month(o_orderdate) - 1 AS month_index, year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) AS day_number,
ROUND(year(o_orderdate) + date_diff('day', make_date(year(o_orderdate), 1, 1), CAST(o_orderdate AS DATE))::DOUBLE / date_diff('day', make_date(year(o_orderdate), 1, 1), make_date(year(o_orderdate) + 1, 1, 1)), 9) AS fraction FROM orders""")
def calendar_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate").cast("date")
    return read(spark, sf_dir, "orders").select("o_orderkey", dates.quarter_end(d).alias("quarter_end"), dates.month_index(d).alias("month_index"), dates.day_number(d).alias("day_number"), F.round(dates.year_fraction(d), 9).alias("fraction"))


@query("""SELECT o_orderkey, (SELECT COUNT(*) FROM range(CAST(o_orderdate AS DATE) + INTERVAL 1 DAY, CAST(o_orderdate AS DATE) + INTERVAL (o_orderkey % 40 + 1) DAY, INTERVAL 1 DAY) r(d) WHERE isodow(d) < 6) AS days FROM orders""")
def business_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate").cast("date")
    return read(spark, sf_dir, "orders").select("o_orderkey", dates.business_days_between(d, F.date_add(d, (F.col("o_orderkey") % 40).cast("int"))).alias("days"))


@query("""SELECT c_custkey, ROUND(2 * 6371.0088 * asin(sqrt(pow(sin(radians(c_nationkey - 10) / 2), 2) + cos(radians(10)) * cos(radians(c_nationkey)) * pow(sin(radians(c_custkey % 90 - 20) / 2), 2))), 6) AS km FROM customer""")
def haversine(spark: SparkSession, sf_dir: str) -> DataFrame:
    km = numeric.haversine_km(F.lit(10.0), F.lit(20.0), F.col("c_nationkey"), F.col("c_custkey") % 90)
    return read(spark, sf_dir, "customer").select("c_custkey", F.round(km, 6).alias("km"))


@query("SELECT l_orderkey, ROUND(1 - product(1 - l_discount), 9) AS combined, ROUND(exp(-SUM(l_quantity / t * ln(l_quantity / t))), 8) AS effective FROM (SELECT *, SUM(l_quantity) OVER (PARTITION BY l_orderkey) AS t FROM lineitem) GROUP BY 1")
def combined_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_discount").alias("d"), F.collect_list("l_quantity").alias("q"))
    return g.select("l_orderkey", F.round(numeric.noisy_or(F.col("d")), 9).alias("combined"), F.round(numeric.effective_number(F.col("q")), 8).alias("effective"))


@query("SELECT l_returnflag, ROUND(AVG(0.5 * ln(2 * pi() * 250000) + pow(l_extendedprice - 1000 * l_quantity, 2) / 500000), 4) AS log_score, ROUND(AVG(greatest(0.9 * (l_extendedprice - 1000 * l_quantity), -0.1 * (l_extendedprice - 1000 * l_quantity))), 4) AS pinball FROM lineitem GROUP BY 1")
def density_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.operators.stats import pinball

    mean, y = 1000 * F.col("l_quantity"), F.col("l_extendedprice")
    return read(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.avg(numeric.gaussian_log_score(y, mean, F.lit(500.0))), 4).alias("log_score"), F.round(F.avg(pinball(0.9, mean, y)), 4).alias("pinball"))


@query()
def crps_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select("l_returnflag", numeric.crps_gaussian(F.col("l_extendedprice"), 1000 * F.col("l_quantity"), F.lit(500.0)).alias("crps"))
    return rows.groupBy("l_returnflag").agg(F.round(F.avg("crps"), 4).alias("crps"))


@query("SELECT o_orderpriority, COUNT(*) AS n, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (o_orderstatus = 'F') AS DOUBLE) AS f, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (o_orderstatus = 'O') AS DOUBLE) AS o, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (o_orderstatus = 'P') AS DOUBLE) AS p FROM orders GROUP BY 1")
def status_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda s: F.sum(F.when(F.col("o_orderstatus") == s, money("o_totalprice"))).cast("double").alias(s.lower())
    return read(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), of("F"), of("O"), of("P"))


@query("""SELECT n_regionkey, c_nationkey, COUNT(*) AS n, CAST(SUM(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP(n_regionkey, c_nationkey)""")
def county_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = read(spark, sf_dir, "customer").join(F.broadcast(read(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.rollup("n_regionkey", "c_nationkey").agg(F.count("*").alias("n"), F.sum(money("c_acctbal")).cast("double").alias("total"))


@query("""WITH r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders WHERE o_orderstatus <> 'P')
SELECT o_custkey, year(o_orderdate) AS y, MAX(o_orderkey) FILTER (k = 1) AS base, COUNT(*) - 1 AS superseded FROM r GROUP BY 1, 2""")
def ownership_base_filing(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = read(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").groupBy("o_custkey", F.year("o_orderdate").alias("y"))
    return kept.agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("m"), (F.count("*") - 1).alias("superseded")).select("o_custkey", "y", F.col("m.o_orderkey").alias("base"), "superseded")


@query("SELECT l_suppkey, year(l_shipdate) AS y, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags, COUNT(DISTINCT l_partkey) AS parts, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS value FROM lineitem GROUP BY 1, 2")
def pair_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = read(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.year("l_shipdate").alias("y"))
    return g.agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("flags"), F.count_distinct("l_partkey").alias("parts"), F.sum(money("l_extendedprice")).cast("double").alias("value"))
