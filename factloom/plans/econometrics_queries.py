"""Queries on distributions, scores, regressions, series and causal designs, each with its oracle where SQL has one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from factloom.functions import distributions as dist, numeric
from factloom.operators import causal, econometrics as eco, scoring
from factloom.operators.staging import Staging
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


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


@query("""SELECT o_orderkey, ROUND(0.5 + atan(x) / pi(), 8) AS t1, ROUND(0.5 + x / (2 * sqrt(2 + x * x)), 8) AS t2, ROUND(tan(pi() * (p - 0.5)), 6) AS q1, ROUND((2 * p - 1) / sqrt(2 * p * (1 - p)), 6) AS q2, ROUND(exp(-y / 2), 8) AS c2, ROUND(exp(-y / 2) * (1 + y / 2), 8) AS c4,
 ROUND(pow(1 + 2 * y / 10, -5), 8) AS f, ROUND(x, 6) AS z FROM (SELECT o_orderkey, (o_orderkey % 81 - 40) / 10.0::DOUBLE AS x, (o_orderkey % 97 + 1) / 100.0::DOUBLE AS p, o_orderkey % 50 / 2.0::DOUBLE AS y FROM orders)""")
def distribution_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Student t, chi-squared, F and normal functions against their closed forms for few degrees of freedom."""
    k = F.col("o_orderkey")
    x, p, y = (k % 81 - 40) / F.lit(10.0), (k % 97 + 1) / F.lit(100.0), k % 50 / F.lit(2.0)
    of = lambda n: F.lit(float(n))
    return read(spark, sf_dir, "orders").select(
        "o_orderkey", F.round(dist.t_cdf(x, of(1)), 8).alias("t1"), F.round(dist.t_cdf(x, of(2)), 8).alias("t2"), F.round(dist.t_ppf(p, of(1)), 6).alias("q1"), F.round(dist.t_ppf(p, of(2)), 6).alias("q2"),
        F.round(dist.chi2_sf(y, of(2)), 8).alias("c2"), F.round(dist.chi2_sf(y, of(4)), 8).alias("c4"), F.round(dist.f_sf(y, of(2), of(10)), 8).alias("f"), F.round(dist.norm_ppf(numeric.norm_cdf(x)), 6).alias("z"),
    )


@query("""WITH m AS (SELECT l_suppkey, l_extendedprice AS x, AVG(l_extendedprice) OVER (PARTITION BY l_suppkey) * 1.1 AS y, COUNT(*) OVER (PARTITION BY l_suppkey) AS n, ROW_NUMBER() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) AS i FROM lineitem)
SELECT l_suppkey, ROUND(SUM(abs(x - y)) / MAX(n) - SUM((2 * i - n - 1) * x) / (MAX(n) * MAX(n)), 2) AS crps FROM m GROUP BY 1""")
def ensemble_crps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of an ensemble against an outcome, in the order of one sort."""
    line = read(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_extendedprice").alias("x"))
    actual = line.groupBy("l_suppkey").agg((F.avg("x") * 1.1).alias("actual"))
    return scoring.crps_ensemble(line.join(actual, "l_suppkey"), ["l_suppkey"], "x", "actual").select("l_suppkey", F.round("crps", 2).alias("crps"))


@query("""WITH g AS (SELECT l_suppkey, list(l_quantity) AS q, quantile_cont(l_extendedprice, [0.1, 0.5, 0.9]) AS v, AVG(l_extendedprice) AS y FROM lineitem GROUP BY 1)
SELECT l_suppkey, ROUND(2 * (greatest(0.1 * (y - v[1]), -0.9 * (y - v[1])) + greatest(0.5 * (y - v[2]), -0.5 * (y - v[2])) + greatest(0.9 * (y - v[3]), -0.1 * (y - v[3]))) / 3, 4) AS crps FROM g""")
def quantile_crps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of stated quantiles: twice their mean pinball loss."""
    g = read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.percentile("l_extendedprice", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("v"), F.avg("l_extendedprice").alias("y"))
    return g.select("l_suppkey", F.round(scoring.crps_from_quantiles(F.col("y"), {q: F.get("v", F.lit(i)) for i, q in enumerate((0.1, 0.5, 0.9))}), 4).alias("crps"))


@query("""WITH r AS (SELECT l_linenumber, (l_partkey % 10 + 0.5) / 10.0::DOUBLE AS p, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END::DOUBLE AS o FROM lineitem)
SELECT l_linenumber, COUNT(*) AS n, ROUND(AVG(pow(p - o, 2)), 9) AS brier, ROUND(1 - AVG(pow(p - o, 2)) / AVG(pow(0.25 - o, 2)), 9) AS skill FROM r GROUP BY 1""")
def brier_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brier score and skill against a constant forecast."""
    r = read(spark, sf_dir, "lineitem").select("l_linenumber", ((F.col("l_partkey") % 10 + 0.5) / 10.0).alias("p"), (F.col("l_returnflag") == "R").cast("double").alias("o"), F.lit(0.25).alias("ref"))
    out = scoring.brier(r, ["l_linenumber"], "p", "o", "ref")
    return out.select("l_linenumber", "n", F.round("brier", 9).alias("brier"), F.round("skill", 9).alias("skill"))


MONTHS = "(SELECT year(o_orderdate) * 12 + month(o_orderdate) - 1 AS t, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / 1000000 AS y, COUNT(*)::DOUBLE / 100 AS x FROM orders GROUP BY 1)"


def months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turnover and orders by month, as an integer period."""
    t = F.year("o_orderdate") * 12 + F.month("o_orderdate") - 1
    return read(spark, sf_dir, "orders").groupBy(t.alias("t")).agg((F.sum(money("o_totalprice")).cast("double") / 1_000_000).alias("y"), (F.count("*").cast("double") / 100).alias("x"))


@query("""WITH m AS (SELECT o_orderpriority AS k, year(o_orderdate) * 12 + month(o_orderdate) - 1 AS t, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS y FROM orders GROUP BY 1, 2),
d AS (SELECT *, abs(y - LAG(y, 12) OVER (PARTITION BY k ORDER BY t)) AS s, abs(y - LAG(y, 1) OVER (PARTITION BY k ORDER BY t)) AS e FROM m)
SELECT k, ROUND(AVG(s), 2) AS scale, ROUND(AVG(e), 2) AS mae, ROUND(AVG(e) / AVG(s), 8) AS mase FROM d GROUP BY 1""")
def scaled_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean error of last month's value over the mean seasonal difference."""
    t = F.year("o_orderdate") * 12 + F.month("o_orderdate") - 1
    m = read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("k"), t.alias("t")).agg(F.sum(money("o_totalprice")).cast("double").alias("y"))
    out = scoring.mase(m, ["k"], "t", "y", 12)
    return out.select("k", F.round("scale", 2).alias("scale"), F.round("mae", 2).alias("mae"), F.round("mase", 8).alias("mase"))


@query("""WITH r AS (SELECT l_suppkey, l_extendedprice - 1000 * l_quantity AS e, ROW_NUMBER() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice - 1000 * l_quantity) AS i, COUNT(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem)
SELECT l_suppkey, ROUND(MAX(e) FILTER (i = greatest(1, least(n, ceil((n + 1) * 0.9 - 1e-9)))), 4) AS high, ROUND(MAX(e) FILTER (i = greatest(1, least(n, floor((n + 1) * 0.1 + 1e-9)))), 4) AS low FROM r GROUP BY 1""")
def conformal_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order statistics of errors that bound the next one with a stated chance."""
    rows = read(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_extendedprice") - 1000 * F.col("l_quantity")).alias("e"))
    out = scoring.conformal_quantiles(rows, ["l_suppkey"], "e", {"high": 0.9, "low": 0.1})
    return out.select("l_suppkey", F.round("high", 4).alias("high"), F.round("low", 4).alias("low"))


@query(f"""WITH e AS (SELECT t, y - x * 1.5 AS e FROM {MONTHS}), w AS (SELECT t, e, sqrt(AVG(e * e) OVER (ORDER BY t ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)) AS s, COUNT(*) OVER (ORDER BY t ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS c FROM e)
SELECT t, ROUND(e / s, 6) AS z FROM w WHERE c = 6 AND s > 0""")
def standard_errors_of_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors over the root mean square of the six before them."""
    e = months(spark, sf_dir).select(F.lit(1).alias("k"), "t", (F.col("y") - F.col("x") * 1.5).alias("e"))
    return scoring.standardized_errors(e, ["k"], "t", "e", 6).select("t", F.round("z", 6).alias("z"))


@query("""WITH o AS (SELECT l_extendedprice / 1000 AS y, l_quantity AS x, l_suppkey AS g FROM lineitem),
f AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, COUNT(*)::DOUBLE AS n, AVG(x) AS xm, regr_sxx(y, x) AS sxx FROM o),
e AS (SELECT g, x, y - a - b * x AS e, 1 / n - xm * (x - xm) / sxx AS ca, (x - xm) / sxx AS cb, n FROM o, f),
v AS (SELECT SUM(e * e) / (MAX(n) - 2) AS s2, MAX(n) / (MAX(n) - 2) * SUM(ca * ca * e * e) AS ha, MAX(n) / (MAX(n) - 2) * SUM(cb * cb * e * e) AS hb FROM e),
c AS (SELECT COUNT(*) / (COUNT(*) - 1.0::DOUBLE) * SUM(a * a) AS ga, COUNT(*) / (COUNT(*) - 1.0::DOUBLE) * SUM(b * b) AS gb FROM (SELECT SUM(ca * e) AS a, SUM(cb * e) AS b FROM e GROUP BY g))
SELECT k AS kind, p AS name, ROUND(CASE WHEN p = 'const' THEN a ELSE b END, 6) AS estimate, ROUND(sqrt(CASE k WHEN 'nonrobust' THEN CASE WHEN p = 'const' THEN s2 * (1 / n + xm * xm / sxx) ELSE s2 / sxx END WHEN 'HC1' THEN CASE WHEN p = 'const' THEN ha ELSE hb END ELSE CASE WHEN p = 'const' THEN ga ELSE gb END END), 6) AS se
FROM f, v, c, (VALUES ('nonrobust'), ('HC1'), ('cluster')) t(k), (VALUES ('const'), ('x')) u(p)""")
def ols_covariances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One regression with classical, heteroskedasticity-robust and clustered standard errors."""
    rows = read(spark, sf_dir, "lineitem").select((F.col("l_extendedprice") / 1000).alias("y"), F.col("l_quantity").alias("x"), F.col("l_suppkey").alias("g"))
    out = [(kind, name, round(b, 6), round(s, 6)) for kind in ("nonrobust", "HC1", "cluster") for name, b, s, _, _ in eco.ols(rows, "y", ["const", "x"], cov=kind, cluster="g").rows()]
    return _rows(spark, out, "kind string, name string, estimate double, se double")


@query("""WITH o AS (SELECT l_extendedprice / 1000 AS y, l_quantity AS x, l_discount * 100 + l_quantity / 5 AS z FROM lineitem),
f AS (SELECT covar_samp(z, y) / covar_samp(z, x) AS b, AVG(y) AS ym, AVG(x) AS xm, COUNT(*)::DOUBLE AS n, regr_slope(x, z) AS p, regr_intercept(x, z) AS q, regr_sxx(x, z) AS szz, regr_syy(x, z) AS sxx FROM o),
s AS (SELECT SUM(pow(y - (ym - b * xm) - b * x, 2)) / (MAX(n) - 2) AS s2, SUM(pow(x - q - p * z, 2)) AS r1 FROM o, f)
SELECT name, ROUND(v, 6) AS value FROM (SELECT ym - b * xm AS c, b, sqrt(s2 / (p * p * szz)) AS se, (sxx - r1) / (r1 / (n - 2)) AS f1 FROM f, s) UNPIVOT (v FOR name IN (c, b, se, f1))""")
def tsls_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-stage least squares with one instrument, and the strength of its first stage."""
    rows = read(spark, sf_dir, "lineitem").select((F.col("l_extendedprice") / 1000).alias("y"), F.col("l_quantity").alias("x"), (F.col("l_discount") * 100 + F.col("l_quantity") / 5).alias("z"))
    fit = eco.tsls(rows, "y", ["const"], ["x"], ["z"])
    return _rows(spark, [("c", round(fit.params["const"], 6)), ("b", round(fit.params["x"], 6)), ("se", round(fit.se["x"], 6)), ("f1", round(fit.extra["first_stage_f_x"], 6))], "name string, value double")


@query("""WITH o AS (SELECT l_extendedprice / 1000 AS y, l_quantity AS x FROM lineitem), f AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, COUNT(*)::DOUBLE AS n, regr_sxx(y, x) AS sxx FROM o),
s AS (SELECT SUM(pow(y - a - b * x, 2)) / (MAX(n) - 2) AS s2 FROM o, f) SELECT ROUND(pow(b - 1, 2) / (s2 / sxx), 4) AS statistic, ROUND(a / b, 6) AS ratio FROM f, s""")
def wald_and_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A test that the slope is one, and a ratio of coefficients."""
    rows = read(spark, sf_dir, "lineitem").select((F.col("l_extendedprice") / 1000).alias("y"), F.col("l_quantity").alias("x"))
    fit = eco.ols(rows, "y", ["const", "x"])
    ratio, _ = eco.delta_method(lambda b: [b[0] / b[1]], fit)
    return _rows(spark, [(round(eco.wald_test(fit, [{"x": 1.0}], [1.0])["statistic"], 4), round(float(ratio[0]), 6))], "statistic double, ratio double")


@query(f"""WITH m AS (SELECT y, LAG(y) OVER (ORDER BY t) AS z, LAG(t) OVER (ORDER BY t) = t - 1 AS ok FROM {MONTHS}), d AS (SELECT * FROM m WHERE ok),
s AS (SELECT COUNT(*)::DOUBLE AS n, regr_syy(y, z) AS s0, regr_syy(y, z) - pow(regr_sxy(y, z), 2) / regr_sxx(y, z) AS s1, regr_slope(y, z) AS phi, regr_intercept(y, z) AS c FROM d)
SELECT p AS "order", ROUND(n * (ln(2 * pi()) + ln(CASE p WHEN 0 THEN s0 ELSE s1 END / n) + 1) + 2 * (p + 2), 5) AS aic, ROUND(n * (ln(2 * pi()) + ln(CASE p WHEN 0 THEN s0 ELSE s1 END / n) + 1) + ln(n) * (p + 2), 5) AS bic, CASE WHEN p = 1 THEN ROUND(phi, 6) END AS phi FROM s, (VALUES (0), (1)) t(p)""")
def ar_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Autoregressions of order 0 and 1 on one sample."""
    m = months(spark, sf_dir)
    fit = eco.fit_ar(m, "t", "y", 1)
    out = [(r["order"], round(r["aic"], 5), round(r["bic"], 5), round(fit.params["phi1"], 6) if r["order"] else None) for r in eco.select_ar_order(m, "t", "y", 1)]
    return _rows(spark, out, "order int, aic double, bic double, phi double")


@query(f"""WITH m AS (SELECT (t - MIN(t) OVER ()) / 12.0::DOUBLE AS years, ln(y) AS v FROM {MONTHS}), f AS (SELECT regr_slope(v, years) AS r, regr_intercept(v, years) AS c FROM m) SELECT ROUND(r, 8) AS rate, ROUND(exp(r) - 1, 8) AS growth, ROUND(c, 8) AS log_level FROM f""")
def exponential_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Continuous growth rate of monthly turnover."""
    got = eco.fit_exponential_growth(months(spark, sf_dir).withColumn("years", F.col("t") / 12.0), "years", "y")
    return _rows(spark, [(round(got["rate"], 8), round(got["annual_growth"], 8), round(got["log_level"], 8))], "rate double, growth double, log_level double")


@query()
def adjustment_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial adjustment, error correction, a vector autoregression and HAC errors of monthly turnover and orders."""
    m = months(spark, sf_dir)
    pa, ec, var = eco.fit_partial_adjustment(m, "t", "y", "x"), eco.fit_error_correction(m, "t", "y", "x"), eco.fit_var(m, "t", ["y", "x"], 1)
    hac = eco.ols(m, "y", ["const", "x"], cov="HAC", time="t")
    out = [("long_run", pa["long_run"]), ("long_run_se", pa["long_run_se"]), ("pass_through", ec["pass_through"]), ("speed", ec["speed"]), ("var_y_x", var["coefficients"]["y"]["x_1"]), ("var_aic", var["aic"]), ("stable", float(var["stable"])), ("hac_se", hac.se["x"])]
    return _rows(spark, [(k, round(float(v), 6)) for k, v in out], "name string, value double")


@query("""WITH p AS (SELECT c_nationkey AS u, c_mktsegment AS t, CAST(SUM(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS y FROM customer GROUP BY 1, 2), w AS (SELECT u FROM p GROUP BY u HAVING COUNT(*) = 5), q AS (SELECT * FROM p WHERE u IN (FROM w))
SELECT u, t, ROUND(y - AVG(y) OVER (PARTITION BY u) - AVG(y) OVER (PARTITION BY t) + AVG(y) OVER (), 2) AS within FROM q""")
def two_way_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals without the means of nation and segment, for nations that have every segment."""
    p = read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("u"), F.col("c_mktsegment").alias("t")).agg(F.sum(money("c_acctbal")).cast("double").alias("y"))
    q = p.join(p.groupBy("u").count().where("count = 5").select("u"), "u", "left_semi")
    return eco.demean(q, ["y"], ["u", "t"], Staging(spark, "demean")).select("u", "t", F.round("y", 2).alias("within"))


@query()
def poisson_fixed_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of lines by supplier nation and mode on price, with effects of both; clustered by nation."""
    s = read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("i"))
    cells = read(spark, sf_dir, "lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("i", F.col("l_linenumber").alias("j")).agg(F.count("*").alias("y"), (F.avg("l_quantity") / 10).alias("x"))
    fit = eco.poisson_fe(cells, "y", ["x"], ["i", "j"], Staging(spark, "poisson"), "i")
    return _rows(spark, [(n, round(b, 5), round(se, 5)) for n, b, se, _, _ in fit.rows()], "name string, estimate double, se double")


@query()
def series_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ARIMA, smoothed level, GARCH and Student t scale of each priority's monthly turnover."""
    t = F.year("o_orderdate") * 12 + F.month("o_orderdate") - 1
    m = read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("k"), t.alias("t")).agg((F.sum(money("o_totalprice")).cast("double") / 1_000_000).alias("y"))
    arima = eco.fit_arima(m, ["k"], "t", "y", (1, 1, 1)).select("k", F.lit("arima_next").alias("name"), F.col("next").alias("value"))
    level = eco.smoothed_levels(m, ["k"], "t", "y", 1.0, 0.5).groupBy("k").agg(F.max_by("smoothed", "at").alias("value")).select("k", F.lit("level").alias("name"), "value")
    garch = eco.fit_garch(m, ["k"], "t", "y").select("k", F.lit("garch_beta").alias("name"), F.col("beta").alias("value"))
    scale = eco.student_t_scale(m.withColumn("y", F.col("y") - 5), ["k"], "t", "y").select("k", F.lit("t_scale").alias("name"), F.col("scale").alias("value"))
    return arima.unionByName(level).unionByName(garch).unionByName(scale).select("k", "name", F.round("value", 4).alias("value"))


PANEL = """p AS (SELECT c_custkey % 60 AS unit, CASE WHEN c_custkey % 60 < 20 THEN NULL ELSE 1997 + c_custkey % 60 % 3 END AS cohort, c_custkey % 60 % 2 AS stratum, year(o_orderdate) AS period, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / 100000 AS y
 FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2, 3, 4)"""


def did_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turnover of sixty groups of customers by year; forty are treated in three years."""
    j = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer").select("c_custkey"), F.col("c_custkey") == F.col("o_custkey"))
    unit = (F.col("c_custkey") % 60).cast("int")
    g = j.groupBy(unit.alias("unit"), F.year("o_orderdate").alias("period")).agg((F.sum(money("o_totalprice")).cast("double") / 100_000).alias("y"))
    return g.select("unit", "period", "y", F.when(F.col("unit") >= 20, 1997 + F.col("unit") % 3).alias("cohort"), (F.col("unit") % 2).alias("stratum"))


DID = f"""WITH {PANEL}, g AS (SELECT DISTINCT cohort AS g FROM p WHERE cohort IS NOT NULL),
d AS (SELECT g, x.period AS t, x.stratum, x.unit, x.y - b.y AS d, CASE WHEN x.cohort = g THEN 1 WHEN x.cohort IS NULL OR x.cohort > greatest(x.period, g - 1) THEN 0 END AS r FROM g JOIN p b ON b.period = g - 1 JOIN p x ON x.unit = b.unit AND x.period <> g - 1),
s AS (SELECT g, t, stratum, COUNT(*) FILTER (r = 1) AS nt, AVG(d) FILTER (r = 1) AS mt, COUNT(*) FILTER (r = 0) AS nc, AVG(d) FILTER (r = 0) AS mc FROM d GROUP BY 1, 2, 3),
c AS (SELECT g, t, SUM(nt) AS n, SUM(nc) AS n_control, SUM(nt * (mt - mc)) / SUM(nt) AS att FROM s WHERE nt > 0 AND nc > 0 GROUP BY 1, 2)"""


@query(DID + " SELECT g, t, n AS n_treated, n_control, ROUND(att, 6) AS att FROM c")
def att_gt_not_yet_treated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group-time effects with not-yet-treated controls within strata."""
    cells = causal.att_gt(did_panel(spark, sf_dir), Staging(spark, "did")).cells
    return cells.select("g", "t", "n_treated", "n_control", F.round("att", 6).alias("att"))


@query(DID + """, i AS (SELECT c.g, c.t, unit, SUM(CASE WHEN r = 1 THEN (d - mc - att) / n ELSE -(nt::DOUBLE / n) / nc * (d - mc) END) AS psi, SUM(r) AS r, MAX(att) AS att, MAX(n) AS n FROM d JOIN s USING (g, t, stratum) JOIN c ON c.g = d.g AND c.t = d.t WHERE r IS NOT NULL AND nt > 0 AND nc > 0 GROUP BY 1, 2, 3),
e AS (SELECT t - g AS e, SUM(n * att) / SUM(n) AS att, SUM(n) AS n FROM c WHERE t - g BETWEEN -3 AND 3 GROUP BY 1),
u AS (SELECT e.e, unit, SUM(i.n / e.n * psi + r * (i.att - e.att) / e.n) AS psi FROM i JOIN e ON e.e = i.t - i.g GROUP BY 1, 2)
SELECT e.e, ROUND(e.att, 6) AS att, CAST(e.n AS BIGINT) AS n_treated, ROUND(sqrt((SELECT COUNT(DISTINCT unit) / (COUNT(DISTINCT unit) - 1.0::DOUBLE) FROM p) * SUM(psi * psi)), 6) AS se FROM e JOIN u ON u.e = e.e GROUP BY e.e, e.att, e.n""")
def event_study_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effects by time since treatment with standard errors from their influence functions."""
    got = causal.event_study(did_panel(spark, sf_dir), Staging(spark, "did"), -3, 3)["event_time"]
    return got.select("e", F.round("att", 6).alias("att"), "n_treated", F.round("se", 6).alias("se"))


@query(f"""WITH {PANEL}, g AS (SELECT DISTINCT cohort AS g FROM p WHERE cohort IS NOT NULL), x AS (SELECT g, unit, stratum, period - g AS e, y, CASE WHEN cohort = g THEN 1 WHEN cohort IS NULL OR cohort > g + 1 THEN 0 END AS r FROM p, g WHERE period - g BETWEEN -2 AND 1),
w AS (SELECT *, MAX(CASE WHEN e = -1 THEN y END) OVER (PARTITION BY g, unit) AS y0, COUNT(*) OVER (PARTITION BY g, unit) AS k FROM x WHERE r IS NOT NULL),
s AS (SELECT g, stratum, e, COUNT(*) FILTER (r = 1) AS nt, COUNT(*) FILTER (r = 0) AS nc, AVG(y - y0) FILTER (r = 1) - AVG(y - y0) FILTER (r = 0) AS att FROM w WHERE k = 4 AND y0 IS NOT NULL AND e <> -1 GROUP BY 1, 2, 3)
SELECT e, ROUND(SUM(nt * nc / (nt + nc)::DOUBLE * att) / SUM(nt * nc / (nt + nc)::DOUBLE), 6) AS att, CAST(SUM(nt) AS BIGINT) AS n_treated, CAST(SUM(nc) AS BIGINT) AS n_control FROM s WHERE nt > 0 AND nc > 0 GROUP BY 1""")
def stacked_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stacked event study with clean controls."""
    got, _ = causal.stacked_did(did_panel(spark, sf_dir), Staging(spark, "did"), -2, 1)
    return got.select("e", F.round("att", 6).alias("att"), "n_treated", "n_control")


@query()
def did_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-way fixed effects, bootstrap bands, tests of leads, placebo dates and the least effect that could be found."""
    panel, st = did_panel(spark, sf_dir).where("stratum = 0").drop("stratum"), Staging(spark, "did")
    study = causal.event_study(panel, st, -2, 2, bootstrap=99)
    twfe = causal.twfe_static(panel, st)
    placebo = causal.placebo_dates(panel, st, 2)["overall"]
    out = [("twfe", twfe["beta"]), ("twfe_se", twfe["se"]), ("overall", study["overall"]["att"]), ("overall_se", study["overall"]["se"]), ("critical", study["critical"]), ("leads_p", study["leads"]["p"]), ("placebo", placebo["att"]), ("mde", causal.minimum_detectable_effect(study["overall"]["se"]))]
    return _rows(spark, [(k, None if v is None else round(float(v), 6)) for k, v in out], "name string, value double")


SCORED = "(SELECT n_regionkey AS event, s_suppkey AS unit, s_acctbal AS y, s_suppkey * 37 % 101 AS a, s_acctbal + s_suppkey * 13 % 997 AS b FROM supplier JOIN nation ON n_nationkey = s_nationkey)"


@query(f"""WITH l AS (SELECT event, unit, y, 'a' AS ranking, a::DOUBLE AS s FROM {SCORED} UNION ALL SELECT event, unit, y, 'b', b FROM {SCORED}),
r AS (SELECT *, RANK() OVER (PARTITION BY event, ranking ORDER BY s) + (COUNT(*) OVER (PARTITION BY event, ranking, s) - 1) / 2.0 AS rs, RANK() OVER (PARTITION BY event, ranking ORDER BY y) + (COUNT(*) OVER (PARTITION BY event, ranking, y) - 1) / 2.0 AS ry, COUNT(*) OVER (PARTITION BY event, ranking) AS n,
 ROW_NUMBER() OVER (PARTITION BY event, ranking ORDER BY s DESC, unit) AS ps, ROW_NUMBER() OVER (PARTITION BY event, ranking ORDER BY y DESC, unit) AS py FROM l), k AS (SELECT *, greatest(1, CAST(round_even(0.1 * n, 0) AS BIGINT)) AS k FROM r)
SELECT event, ranking, MAX(n) AS n, MAX(k) AS k, ROUND(CASE WHEN MAX(n) >= 3 THEN corr(rs, ry) END, 8) AS spearman, ROUND(COUNT(*) FILTER (ps <= k AND py <= k) / MAX(k)::DOUBLE, 8) AS capture, ROUND(AVG(y) FILTER (ps <= k) - AVG(y), 4) AS lift FROM k GROUP BY 1, 2""")
def event_rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skill of two rankings of suppliers in each region."""
    out = causal.score_events(_scored(spark, sf_dir), "event", "unit", "y", ["a", "b"])
    return out.select("event", "ranking", "n", "k", F.round("spearman", 8).alias("spearman"), F.round("capture", 8).alias("capture"), F.round("lift", 4).alias("lift"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    k = F.col("s_suppkey")
    return j.select(F.col("n_regionkey").alias("event"), k.alias("unit"), F.col("s_acctbal").alias("y"), (k * 37 % 101).alias("a"), (F.col("s_acctbal") + k * 13 % 997).alias("b"))


@query()
def ranking_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether one ranking beats another over the regions."""
    scores = causal.score_events(_scored(spark, sf_dir), "event", "unit", "y", ["a", "b"])
    got = causal.compare_rankings(scores, "b", "a")
    return _rows(spark, [(got["events"], got["better"], round(got["mean"], 6), round(got["p"], 6))], "events long, better long, difference double, p double")
