"""Regressions, series models, causal designs and units against numpy and closed forms."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.functions import units
from factloom.operators import beliefs, causal, crosswalk, econometrics as eco, scoring
from factloom.operators.staging import Staging


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(3)
    n = 120
    x, z = rng.normal(size=n), rng.normal(size=n)
    y = np.zeros(n)
    for t in range(n):
        y[t] = 0.5 + 0.6 * (y[t - 1] if t else 0) + 1.5 * x[t] + rng.normal() * 0.3
    frame = spark.createDataFrame([(t, float(y[t]), float(x[t]), float(z[t]), t % 7) for t in range(n)], "t long, y double, x double, z double, g int")
    return frame, y, x, z


def least_squares(design, y):
    beta, *_ = np.linalg.lstsq(design, y, rcond=None)
    return beta, y - design @ beta


def test_ols_covariances(spark, sample):
    frame, y, x, z = sample
    design = np.column_stack([np.ones(len(y)), x, z])
    beta, e = least_squares(design, y)
    bread = np.linalg.inv(design.T @ design)
    n, k = design.shape
    s = design * e[:, None]
    lags = eco.newey_west_lags(n)
    meat = s.T @ s + sum((1 - j / (lags + 1)) * (s[j:].T @ s[:-j] + (s[j:].T @ s[:-j]).T) for j in range(1, lags + 1))
    want = {"nonrobust": bread * (e @ e) / (n - k), "HC0": bread @ (s.T @ s) @ bread, "HAC": bread @ meat @ bread * n / (n - k)}
    for kind, cov in want.items():
        fit = eco.ols(frame, "y", ["const", "x", "z"], cov=kind, time="t")
        assert np.allclose(fit.beta, beta) and np.allclose(fit.cov, cov), kind
    w = eco.ols(frame.withColumn("w", F.col("g") + 1.0), "y", ["const", "x"], weight="w")
    root = np.sqrt(np.arange(n) % 7 + 1.0)
    assert np.allclose(w.beta, least_squares(design[:, :2] * root[:, None], y * root)[0])


def test_lagged_models(spark, sample):
    frame, y, x, _ = sample
    design = np.column_stack([np.ones(len(y) - 1), y[:-1], x[1:]])
    beta, _e = least_squares(design, y[1:])
    got = eco.fit_partial_adjustment(frame, "t", "y", "x")
    assert np.allclose(got["fit"].beta, beta) and got["long_run"] == pytest.approx(beta[2] / (1 - beta[1])) and got["stable"]
    design = np.column_stack([np.ones(len(y) - 1), np.diff(x), y[:-1], x[:-1]])
    beta, _e = least_squares(design, np.diff(y))
    ecm = eco.fit_error_correction(frame, "t", "y", "x")
    assert np.allclose(ecm["fit"].beta, beta) and ecm["pass_through"] == pytest.approx(-beta[3] / beta[2]) and ecm["correcting"]
    design = np.column_stack([np.ones(len(y) - 2), y[1:-1], x[1:-1], y[:-2], x[:-2]])
    var = eco.fit_var(frame, "t", ["y", "x"], 2)
    for name, target in (("y", y), ("x", x)):
        assert np.allclose(list(var["coefficients"][name].values()), least_squares(design, target[2:])[0])
    assert var["stable"]
    orders = eco.select_ar_order(frame, "t", "y", 3)
    assert min(orders, key=lambda r: r["bic"])["order"] == 1


def test_logistic_growth(spark):
    rows = [(float(t), 1000 / (1 + math.exp(-0.3 * (t - 20)))) for t in range(40)]
    got = eco.fit_logistic_growth(spark.createDataFrame(rows, "t double, v double"), "t", "v")
    assert got["capacity"] == pytest.approx(1000, rel=0.02) and got["rate"] == pytest.approx(0.3, rel=0.02) and got["midpoint"] == pytest.approx(20, abs=0.5)


def test_poisson_fixed_effects_equal_dummies(spark):
    rng = np.random.default_rng(8)
    rows = [(i, j, float(rng.normal())) for i in range(6) for j in range(5)]
    rows = [(i, j, v, float(rng.poisson(math.exp(0.5 * v + 0.2 * i - 0.1 * j)))) for i, j, v in rows]
    fit = eco.poisson_fe(spark.createDataFrame(rows, "i int, j int, x double, y double"), "y", ["x"], ["i", "j"], Staging(spark, "t"))
    design = np.array([[v, *(float(i == a) for a in range(6)), *(float(j == b) for b in range(1, 5))] for i, j, v, _ in rows])
    y, beta = np.array([r[3] for r in rows]), np.zeros(11)
    for _ in range(60):
        mu = np.exp(np.clip(design @ beta, -30, 30))
        beta = beta + np.linalg.lstsq(design.T @ (design * mu[:, None]), design.T @ (y - mu), rcond=None)[0]
    assert fit.params["x"] == pytest.approx(beta[0], abs=1e-6) and fit.se["x"] > 0


def test_series_models(spark):
    rng = np.random.default_rng(11)
    e = rng.normal(size=400)
    y = np.zeros(400)
    for t in range(1, 400):
        y[t] = 0.7 * y[t - 1] + e[t] + 0.4 * e[t - 1]
    h, g = 1.0, []
    for _ in range(600):
        g.append(math.sqrt(h) * rng.normal())
        h = 0.1 + 0.2 * g[-1] ** 2 + 0.7 * h
    frame = spark.createDataFrame([("a", t, float(v)) for t, v in enumerate(y)] + [("s", 0, 1.0)], "k string, t long, y double")
    arma = eco.fit_arima(frame, ["k"], "t", "y", (1, 0, 1)).collect()
    assert len(arma) == 1 and arma[0]["ar"][0] == pytest.approx(0.7, abs=0.1) and arma[0]["ma"][0] == pytest.approx(0.4, abs=0.12)
    garch = eco.fit_garch(spark.createDataFrame([("a", t, float(v)) for t, v in enumerate(g)], "k string, t long, y double"), ["k"], "t", "y").first()
    assert 0.05 < garch["alpha"] < 0.4 and 0.4 < garch["beta"] < 0.9
    tails = eco.student_t_scale(spark.createDataFrame([("a", t, float(v)) for t, v in enumerate(rng.standard_t(4, 2000))], "k string, t long, y double"), ["k"], "t", "y").first()
    assert tails["df"] == pytest.approx(4, abs=1.2) and tails["scale"] == pytest.approx(1, abs=0.1)


def test_level_smoother_is_the_regression(spark):
    """The smoothed level minimises the squared errors over eps plus the squared steps over eta."""
    y = np.array([1.0, 3.0, 2.0, 6.0, 5.0, 4.0])
    eps, eta = 2.0, 0.5
    d = np.diff(np.eye(6), axis=0)
    want = np.linalg.solve(np.eye(6) / eps + d.T @ d / eta, y / eps)
    got = eco.smoothed_levels(spark.createDataFrame([("a", t, float(v)) for t, v in enumerate(y)], "k string, t long, y double"), ["k"], "t", "y", eps, eta).orderBy("at").collect()
    assert np.allclose([r["smoothed"] for r in got], want, atol=1e-5)


def test_diebold_mariano(spark):
    rng = np.random.default_rng(2)
    a, b = rng.random(40), rng.random(40) + 0.2
    d = a - b
    c = d - d.mean()
    gamma = [(c[k:] @ c[: len(c) - k]) / len(c) for k in range(2)]
    stat = d.mean() / math.sqrt((gamma[0] + 2 * gamma[1]) / 40) * math.sqrt((40 + 1 - 4 + 2 / 40) / 40)
    got = scoring.diebold_mariano(spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(zip(a, b))], "t long, m double, b double"), "t", "m", "b", 2)
    assert got["statistic"] == pytest.approx(stat) and got["p"] < 0.05
    assert scoring.diebold_mariano(spark.range(5).select(F.col("id").alias("t"), F.lit(1.0).alias("m"), F.lit(1.0).alias("b")), "t", "m", "b")["p"] is None


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(4)
    rows = []
    for u in range(60):
        cohort = None if u < 25 else 4 + u % 3
        for t in range(9):
            rows.append((u, t, float(u % 5 + t + (2.0 if cohort and t >= cohort else 0) + rng.normal() * 0.2), cohort))
    return spark.createDataFrame(rows, "unit int, period int, y double, cohort int")


def test_event_study_finds_the_effect(spark, panel):
    got = causal.event_study(panel, Staging(spark, "t"), -3, 3, bootstrap=99)
    by = {r["e"]: r for r in got["event_time"].collect()}
    assert all(abs(by[e]["att"] - (2 if e >= 0 else 0)) < 0.25 for e in by) and -1 not in by
    assert got["overall"]["att"] == pytest.approx(2, abs=0.15) and got["overall"]["p"] < 1e-6 and got["leads"]["p"] > 0.001 and got["critical"] > 1.5
    assert all(r["band_low"] <= r["ci_low"] + 0.2 and r["se"] > 0 for r in by.values())
    twfe = causal.twfe_static(panel, Staging(spark, "t"))
    assert twfe["beta"] == pytest.approx(2, abs=0.2) and twfe["clusters"] == 60
    stacked, stacks = causal.stacked_did(panel, Staging(spark, "t"), -2, 1)
    assert stacks == 3 and all(abs(r["att"] - (2 if r["e"] >= 0 else 0)) < 0.2 and r["se"] > 0 for r in stacked.collect())


def test_placebos(spark, panel):
    dates = causal.placebo_dates(panel, Staging(spark, "t"), 2)["overall"]
    assert abs(dates["att"]) < 0.2
    units_ = causal.placebo_units(panel, Staging(spark, "t"), 2, -1, 1, observed=2.0)
    assert units_["ran"] == 2 and abs(units_["mean"]) < 0.2 and units_["p"] == pytest.approx(1 / 3)
    assert causal.placebo_units(panel, Staging(spark, "t"), 1, -1, 1, min_never=100)["ran"] == 0


def test_sign_flip(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "d double")
    assert causal.sign_flip(df, "d") == {"n": 3, "mean": pytest.approx(2.0), "p": pytest.approx(1 / 8)}
    assert causal.sign_flip(df.where("false"), "d")["p"] is None


@pytest.mark.parametrize("text", ["ton", "", None, "furlong", "degC/kg", "USD//kg", "oz"])
def test_refused_units(text):
    assert not units.is_valid(text)


def test_unit_conversions():
    assert units.factor("degF", "degC") == (459.67, pytest.approx(5 / 9), 273.15)
    assert units.check_conversion("lb", "kg", 0.45359237) and not units.check_conversion("lb", "kg", 0.5)
    assert units.factor("USD/bu", "USD/t", commodity="corn")[1] == pytest.approx(1000 / (56 * 0.45359237))
    assert units.factor("bbl", "mmbtu", commodity="crude_oil", approximate=True)[1] == pytest.approx(5.8)
    assert units.factor("bbl", "t", bridges=(("bbl", "kg", 136.0),))[1] == pytest.approx(0.136)
    with pytest.raises(units.UnitError):
        units.factor("year", "day")


def test_belief_policies(spark):
    with pytest.raises(ValueError):
        beliefs.checked_policy("source_priority", {}, 0.5, [], 0.25, None, None)
    stamp = "2020-01-01"
    claims = spark.createDataFrame([(1, "s", 10.0, "kg", "a", None), (2, "s", 10.0000001, "kg", "b", None), (3, "s", 22.0462262, "lb", "c", None), (4, "s", 5.0, "m", "d", None), (5, "r", 1.0, "kg", "a", [6]), (6, "q", 2.0, "kg", "a", None)], "id int, subject string, value double, unit string, dataset string, retracts array<int>")
    claims = claims.select("*", F.lit(stamp).cast("timestamp_ntz").alias("observed_at"), F.lit(None).cast("timestamp_ntz").alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to"))
    got = {r["subject"]: r for r in beliefs.materialize(claims, ["subject"], "2021-01-01", rule="reliability_weighted", unit="kg", tolerance=1e-6).collect()}
    assert got["s"]["status"] == "known" and got["s"]["supporting_claims"] == 3 and got["s"]["unconvertible"] == 1 and got["s"]["value"] == pytest.approx(10, rel=1e-6)
    assert got["q"]["status"] == "retracted" and got["q"]["value"] is None and got["r"]["status"] == "known"


def test_apportion_conserves(spark):
    values = spark.createDataFrame([("a", 10.0), ("b", 6.0), ("z", 1.0)], "source string, value double")
    rows = spark.createDataFrame([("a", "x", 0.25), ("a", "y", 0.75), ("b", "x", None), ("b", "y", None)], "source string, target string, weight double")
    r = crosswalk.apportion_report(values, rows).first()
    assert (r["total_in"], r["total_out"], r["unmapped"], r["conserved"]) == (17.0, 16.0, 1.0, True) and r["error_bound"] == pytest.approx(6.0)
