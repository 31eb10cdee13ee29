"""Operators on small literal tables: NULLs, ties, contradictions and empty inputs."""

import gzip
import json
import zipfile
from datetime import datetime as dt

import pytest
from pyspark.sql import functions as F, types as T

from factloom.functions import identifiers, numeric, text
from factloom.operators import asof, beliefs, components, crosswalk, econometrics, evidence, graph, identity, kernels, panels, products, resolution, stats, temporal
from factloom.operators.staging import Staging
from factloom.sources import readers
from factloom.sources.store import Store

CLAIM = "id string, subject string, value double, dataset string, observed_at timestamp_ntz, valid_from timestamp_ntz, valid_to timestamp_ntz, retracts array<string>"


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns or df.columns).collect()), key=str)


def day(s):
    return dt.fromisoformat(s)


@pytest.fixture(scope="module")
def claims(spark):
    return spark.createDataFrame(
        [
            ("c:1", "s:1", 0.6, "a", day("2024-02-01"), day("2024-01-01"), None, None),
            ("c:2", "s:1", 0.8, "b", day("2024-09-01"), day("2024-01-01"), None, None),
            ("c:3", "s:2", 5.0, "a", day("2024-02-01"), None, None, None),
            ("c:4", "s:2", None, "b", day("2024-03-01"), None, None, ["c:3"]),
            ("c:5", "s:3", 1.0, "a", day("2024-02-01"), day("2024-01-01"), day("2024-02-01"), None),
        ],
        CLAIM,
    )


def test_contradictions_stay(claims):
    got = rows(beliefs.reconcile(claims, ["subject"], "2024-06-01", "2024-12-01"), "subject", "status", "value")
    assert got == [("s:1", "conflicting", None)]
    assert rows(beliefs.reconcile(claims, ["subject"], "2024-06-01", "2024-03-01"), "subject", "value") == [("s:1", 0.6)]
    assert rows(beliefs.reconcile(claims, ["subject"], "2024-06-01", "2024-12-01", "latest"), "subject", "value") == [("s:1", 0.8)]
    assert rows(beliefs.reconcile(claims, ["subject"], "2024-06-01", "2024-12-01", "source_priority", ["a"]), "subject", "value") == [("s:1", 0.6)]
    assert rows(beliefs.standing(claims, "2024-02-15"), "id") == [("c:1",), ("c:3",), ("c:5",)]


def test_asof_excludes_and_counts_unknown(spark):
    t = "dataset string, valid_from timestamp_ntz, valid_to timestamp_ntz, published_at timestamp_ntz"
    r = spark.createDataFrame([("a", day("2020-01-01"), None, day("2020-02-01")), ("a", None, None, None), ("b", None, day("2020-03-01"), day("2020-01-01")), ("b", day("2020-03-01"), None, day("2021-01-01"))], t)
    policy = asof.AsOf("2020-03-01", "2020-12-31")
    assert policy.read(r).count() == 1 and rows(policy.report(r)) == [("a", 1)]
    assert asof.AsOf("2020-03-01", "2020-12-31", True).read(r).count() == 2
    assert asof.AsOf().read(r).count() == 4 and policy.read(r.where("false")).count() == 0


def test_asof_join_tolerance_and_ties(spark):
    left = spark.createDataFrame([(1, "k", day("2024-01-10")), (2, "k", day("2024-01-01")), (3, "z", day("2024-01-10")), (4, None, day("2024-01-10"))], "id int, key string, t timestamp_ntz")
    right = spark.createDataFrame([("k", day("2024-01-09"), 1.0), ("k", day("2024-01-09"), 2.0), ("k", day("2023-12-01"), 3.0)], "key string, at timestamp_ntz, v double")
    for days in (None, 10):
        got = asof.asof_join(left, right, ["key"], "t", "at", ["v"], "5 days", days)
        assert rows(got, "id", "v") == [(1, 2.0), (2, None), (3, None), (4, None)]


def test_interval_join_is_half_open(spark):
    points = spark.createDataFrame([(i, "k", day(f"2024-01-{i:02d}")) for i in range(1, 29)], "id int, key string, t timestamp_ntz")
    spans = spark.createDataFrame([("k", day("2024-01-05"), day("2024-01-20"), "x"), ("k", day("2024-01-20"), day("2024-01-20"), "empty")], "key string, f timestamp_ntz, e timestamp_ntz, name string")
    assert [r[0] for r in rows(asof.interval_join(points, spans, ["key"], "t", "f", "e", 7), "id")] == sorted(range(5, 20), key=lambda i: str((i,)))


def test_violations(spark):
    r = spark.createDataFrame([("a:1", "entity", day("2020-01-02"), day("2020-01-01"), 0.5), ("x", "thing", None, None, 2.0), ("a:2", "event", None, day("2020-01-01"), None)], "id string, kind string, valid_from timestamp_ntz, valid_to timestamp_ntz, confidence double")
    assert [r["violations"] for r in evidence.violations(r).collect()] == [["interval_not_positive"], ["confidence_out_of_range", "id_not_namespaced", "unknown_kind"], []]
    with pytest.raises(Exception, match="record breaks"):
        evidence.valid_or_raise(r).collect()


def test_normalize_marks_missing(spark):
    r = spark.createDataFrame([("AA", "5", "n/a"), ("BB", "", "x")], "k string, income string, life string")
    got = evidence.normalize(r, F.col("k"), {"income": ("income", "USD"), "life": ("life", "1")}, ["k"], "d", ("", "n/a"))
    assert rows(got, "subject", "metric", "value", "missing_reason") == [("AA", "income", 5.0, None), ("AA", "life", None, "blank"), ("BB", "income", None, "blank"), ("BB", "life", None, "not_a_number")]
    assert got.select("id").distinct().count() == 4


def test_components_and_clusters(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (100, 100), (None, 7)], "a long, b long")
    got = dict(rows(components.connected_components(e, Staging(spark, "t"))))
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100
    assert rows(graph.identity_clusters(e, Staging(spark, "t"), max_size=5)) == [(100, 100), (101, 100)]
    assert components.connected_components(e.where("false"), Staging(spark, "t")).count() == 0


def test_paths_and_pagerank(spark):
    e = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e")], "subject string, object string")
    assert rows(graph.shortest_paths(e, "a", 3, Staging(spark, "t"))) == [("a", 0, None), ("b", 1, "a"), ("c", 1, "a"), ("d", 2, "b"), ("e", 3, "d")]
    ranks = dict(rows(graph.pagerank(e, 30, Staging(spark, "t"), weighted=False)))
    assert sum(ranks.values()) == pytest.approx(1) and ranks["d"] > ranks["b"] == pytest.approx(ranks["c"])
    loops = e.withColumn("weight", F.lit(2.0)).unionByName(spark.createDataFrame([("a", "a", 9.0), ("a", "b", -5.0)], "subject string, object string, weight double"))
    assert dict(rows(graph.pagerank(loops, 30, Staging(spark, "t")))) == pytest.approx(ranks)


def test_vintages_with_nulls(spark):
    f = spark.createDataFrame([("k", None, day("2024-01-01")), ("k", None, day("2024-02-01")), ("k", 3, day("2024-03-01")), ("k", 3, day("2024-04-01"))], "key string, v int, t timestamp_ntz")
    assert rows(temporal.vintages(f, ["key"], "v", "t"), "run", "v", "confirmations", "status") == [(1, None, 1, "first_report"), (2, 3, 1, "restated")]


def test_crosswalk_conserves_and_reports(spark):
    x = spark.createDataFrame([("p", "x", 0.25), ("p", "y", 0.75), ("q", "y", None), ("q", "z", 1.0)], "source string, target string, weight double")
    v = spark.createDataFrame([("p", 100.0), ("q", 10.0), ("r", 7.0)], "source string, value double")
    mapped, unmapped = crosswalk.apportion(v, x)
    assert rows(mapped) == [("x", 25.0), ("y", 80.0), ("z", 5.0)] and rows(unmapped) == [("r", 7.0)]
    strict, left = crosswalk.apportion(v, x, equal_if_unweighted=False)
    assert rows(strict) == [("x", 25.0), ("y", 75.0)] and left.count() == 2
    assert rows(crosswalk.check_partition(x), "source") == [("q",)]


def test_exact_translation_is_division(spark):
    x = spark.createDataFrame([("a", "T"), ("b", "T"), ("c", "U"), ("c", "V"), ("d", "W"), ("e", "W")], "source string, target string")
    r = spark.createDataFrame([("a", 5), ("b", 5), ("c", 1), ("d", 2), ("e", 3)], "source string, rate int")
    assert rows(crosswalk.exact_translation(x, r)) == [("T", 5)]
    assert rows(crosswalk.exact_translation(x, r.where("source <> 'b'"))) == []


def test_identifier_links(spark):
    c = spark.createDataFrame([("s1", "n", "1"), ("s2", "n", "1"), ("s3", "n", "1"), ("s3", "n", "2"), ("s4", "m", "1")], "subject string, namespace string, value string")
    assert rows(identity.shared_identifier_links(c), "a", "b") == [("s1", "s2")]
    spans = spark.createDataFrame([("x", "1", day("2020-01-01"), day("2021-01-01")), ("x", "2", day("2020-06-01"), None), ("x", "3", day("2019-01-01"), day("2020-01-01")), ("y", "1", None, None)], "one string, other string, valid_from timestamp_ntz, valid_to timestamp_ntz")
    assert rows(identity.overlapping_conflicts(spans, "one", "other"), "other") == [("1",), ("2",)]


def test_linkage_learns(spark):
    model = resolution.FellegiSunter({"x": 3, "y": 3}).fit({"22": 30, "00": 300, "20": 15, "0_": 5})
    assert model.converged and model.weight("22") > 0 > model.weight("00") and model.weight("22") > model.weight("20")
    assert model.probability("22") > 0.9 > 0.1 > model.probability("00") and model.weight("0_") == pytest.approx(model.weight("0_"))


def test_constrained_clusters(spark):
    """Links join in falling probability unless size, reviews, identifiers, types or unlike pairs forbid it."""
    scored = spark.createDataFrame([(1, 2, 0.99), (2, 3, 0.98), (1, 3, 0.1), (4, 5, 0.99), (6, 7, 0.99), (8, 9, 0.99), (10, 11, 0.96), (11, 12, 0.97)], "a long, b long, probability double")
    facts = [(i, "firm" if i != 9 else "person", [("tax", f"T{i}")] if i in (4, 5) else []) for i in range(1, 14)]
    records = spark.createDataFrame(facts, "rid long, entity_type string, ids array<struct<namespace:string,value:string>>")
    reviews = spark.createDataFrame([(6, 7, False), (12, 13, True)], "a long, b long, accepted boolean")
    clusters, links = resolution.cluster(scored, records, Staging(spark, "t"), max_size=3, unique=["tax"], reviews=reviews)
    assert rows(resolution.members_of(clusters).where("size > 1"), "members") == [([1, 2],), ([11, 12, 13],)]
    assert {(r[0], r[1]): r[3] for r in rows(links)} == {(1, 2): "used", (2, 3): "transitivity_conflict", (4, 5): "identifier_conflict", (6, 7): "rejected_review", (8, 9): "entity_type_conflict", (10, 11): "max_cluster_size", (11, 12): "used", (12, 13): "used"}
    assert sorted(tuple(r) for r in resolution.resolved_view(clusters).collect()) == [(1, 1), (2, 1), (11, 11), (12, 11), (13, 11)]


def test_ledger_counts_a_batch_once(spark):
    b = spark.createDataFrame([(1, "a", 1, 5), (1, "a", 1, 5), (2, "a", 2, 7), (2, "a", 3, 8), (3, "a", 4, 1)], "batch int, account string, seq int, amount int")
    assert rows(panels.ledger(b, "account", "amount"), "batch", "balance", "conflict") == [(1, 5, False), (2, 5, True), (3, 6, False)]


def test_run_order_refuses_circles(spark):
    stages = spark.createDataFrame([("a",), ("b",), ("c",)], "stage string")
    with pytest.raises(ValueError, match="circle"):
        panels.run_order(stages, spark.createDataFrame([("a", "b"), ("b", "a")], "stage string, need string"), Staging(spark, "t"))
    with pytest.raises(ValueError, match="isn't there"):
        panels.run_order(stages, spark.createDataFrame([("a", "x")], "stage string, need string"), Staging(spark, "t"))


def test_screening_is_never_clear_of_the_unseen(spark):
    own = spark.createDataFrame([("l", "a", 0.5), ("a", "b", 0.5), ("b", "c", 0.5), ("x", "d", 1.0), ("m", "l", 1.0)], "subject string, object string, share double")
    listed, subjects = spark.createDataFrame([("l",), ("m",)], "entity string"), spark.createDataFrame([(s,) for s in "abcd"], "entity string")
    got = {r["subject"]: (r["listed"], r["hop"], r["share"], r["status"]) for r in products.screen(own, listed, subjects, 2, Staging(spark, "t")).collect()}
    assert got == {"a": ("l", 1, 0.5, "match"), "b": ("l", 2, 0.25, "match"), "c": (None, None, None, "inconclusive"), "d": (None, None, None, "clear")}


def test_clearing(spark):
    debts = spark.createDataFrame([("a", "b", 100.0), ("b", "c", 80.0), ("c", "a", 10.0)], "borrower string, lender string, amount double")
    cash = spark.createDataFrame([("a", 40.0), ("b", 0.0)], "id string, cash double")
    got = {r[0]: r[2] for r in rows(kernels.clearing(debts, cash, Staging(spark, "t")))}
    assert got == {"a": pytest.approx(50), "b": pytest.approx(50), "c": pytest.approx(10)}


def test_ownership_adds_up(spark):
    own = spark.createDataFrame([("x", "a", 0.3), ("y", "a", 0.3), ("a", "b", 0.5), ("b", "c", 0.4)], "subject string, object string, share double")
    listed = spark.createDataFrame([("x",), ("y",)], "entity string")
    assert rows(products.aggregate_ownership(own, listed, 0.5, Staging(spark, "t")), "entity", "round") == [("a", 1), ("b", 2), ("x", 0), ("y", 0)]
    control = spark.createDataFrame([("b", "d"), ("c", "e")], "controller string, controlled string")
    assert rows(products.aggregate_ownership(own, listed, 0.6, Staging(spark, "t"), control), "entity", "basis") == [("a", "ownership_aggregate"), ("x", "designated"), ("y", "designated")]
    assert dict(rows(kernels.look_through(own, listed, Staging(spark, "t"))))["c"] == pytest.approx(0.12)


def test_scores_and_ranks(spark):
    r = spark.createDataFrame([(0.0, 0), (1.0, 1), (0.95, 1), (0.5, 0)], "p double, y int")
    assert rows(stats.calibration_curve(r, 10), "bin", "n") == [(0, 1), (5, 1), (9, 2)]
    assert stats.spearman(r.withColumn("k", F.lit(1)), ["k"], "p", "p").first()["rho"] == pytest.approx(1)
    b = econometrics.ols(spark.range(50).select(F.col("id").alias("x"), (3 + 2 * F.col("id")).alias("y")), "y", ["const", "x"]).params
    assert b["const"] == pytest.approx(3) and b["x"] == pytest.approx(2)


def test_check_digits(spark):
    r = spark.createDataFrame([("US0378331005", "037833100", "9074729", "7830002293", "5493001KJTIIGC8Y1R12")], "isin string, cusip string, imo string, inn string, lei string")
    got = r.select(identifiers.valid_isin(F.col("isin")), identifiers.cusip_from_isin(F.col("isin")), identifiers.valid_cusip(F.col("cusip")), identifiers.valid_imo(F.col("imo")), identifiers.valid_ru_inn(F.col("inn")), identifiers.valid_lei(F.col("lei")), identifiers.valid_isin(F.lit("US0378331006")), identifiers.valid_lei(F.lit("")))
    assert tuple(got.first()) == (True, "037833100", True, True, True, True, False, False)


def test_names(spark):
    r = spark.createDataFrame([("The A.B.C. Trading Co., Ltd.", "O'Neil, Dr. Mary Jr."), (None, ""), ("Inc", "Solo")], "org string, person string")
    got = r.select(text.organization(F.col("org")).alias("o"), text.person(F.col("person")).alias("p")).collect()
    assert got[0]["o"] == "a b c trading" or got[0]["o"] == "abc trading"
    assert tuple(got[0]["p"]) == ("mary oneil", "mary", "oneil", "m") and got[1]["o"] is None and tuple(got[2]["p"]) == ("solo", "solo", "solo", "")
    assert text.jaro("martha", "marhta") == pytest.approx(0.944444, abs=1e-6) and text.jaro("", "x") == 0


def test_distributions(spark):
    got = spark.range(1).select(numeric.poisson_binomial(F.array(F.lit(0.5), F.lit(0.5))).alias("d"), numeric.norm_cdf(F.lit(1.96)).alias("c"), numeric.crps_gaussian(F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("s"), numeric.logistic(F.lit(-800.0)).alias("l")).first()
    assert got["d"] == [0.25, 0.5, 0.25] and got["c"] == pytest.approx(0.9750021, abs=1e-6) and got["s"] == pytest.approx(0.2336950, abs=1e-6) and got["l"] == 0


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('k,v\n1,"x, y"\n2,\n')
    with gzip.open(tmp_path / "b.jsonl.gz", "wt") as f:
        f.write('{"k": 1, "v": "x"}\n\n{"k": 2}\n')
    (tmp_path / "c.json").write_text(json.dumps({"data": {"rows": [{"k": "1"}, {"k": "2"}]}}))
    with zipfile.ZipFile(tmp_path / "d.zip", "w") as z:
        z.writestr("in/One.TSV", "k\tv\n1\tx\n")
        z.writestr("skip.txt", "")
    with zipfile.ZipFile(tmp_path / "e.xlsx", "w") as z:
        n = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{n}"><si><t>k</t></si><si><t>name</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{n}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row r="3"><c r="A3"><v>7</v></c><c r="B3" t="inlineStr"><is><t>seven</t></is></c></row></sheetData></worksheet>')
    p = str(tmp_path)
    assert rows(readers.read_rows(spark, f"{p}/a.csv", {"format": "csv"}), "k", "v") == [("1", "x, y"), ("2", None)]
    assert [r["row"] for r in readers.read_rows(spark, f"{p}/b.jsonl.gz", {"format": "jsonl"}).collect()] == [{"k": "1", "v": "x"}, {"k": "2"}]
    assert readers.read_rows(spark, f"{p}/c.json", {"format": "json", "records_path": ["data", "rows"]}).count() == 2
    assert readers.read_rows(spark, f"{p}/d.zip", {"format": "tsv", "member": "IN/*.tsv"}).first()["row"] == {"k": "1", "v": "x"}
    assert readers.read_rows(spark, f"{p}/e.xlsx", {"format": "xlsx"}).collect()[0]["row"] == {"k": "7", "name": "seven"}
    (tmp_path / "q.csv").write_text('k,v\n1,"two\nlines"\n2,z\n')
    assert rows(readers.read_rows(spark, f"{p}/q.csv", {"format": "csv", "columns": ["v"]}), "v") == [("two\nlines",), ("z",)]
    with zipfile.ZipFile(tmp_path / "j.zip", "w") as z:
        z.writestr("a.json", json.dumps({"rows": [{"k": 1, "v": {"x": 2}}, {"k": 2}]}))
    got = readers.read_rows(spark, f"{p}/j.zip", {"format": "json", "member": "*.json", "records_path": ["rows"], "columns": ["k"]}).collect()
    assert [r["row"] for r in got] == [{"k": "1"}, {"k": "2"}]
    with zipfile.ZipFile(tmp_path / "e.xlsx", "a") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{n}"><sheets><sheet name="First"/><sheet name="Other"/></sheets></workbook>')
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet xmlns="{n}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c></row><row r="2"><c r="A2"><v>9</v></c></row></sheetData></worksheet>')
    assert [r["row"] for r in readers.read_rows(spark, f"{p}/e.xlsx", {"format": "xlsx", "sheet": "Other"}).collect()] == [{"k": "9"}]
    with pytest.raises(ValueError, match="unknown reader options"):
        readers.read_rows(spark, p, {"format": "csv", "typo": 1})


def test_feed(spark, tmp_path):
    (tmp_path / "f.jsonl").write_text('{"k": "a", "n": 3}\n{"k": "b", "n": -1}\nnot json\n')
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("n", T.IntegerType())])
    good, bad = readers.feed(spark, str(tmp_path / "f.jsonl"), schema, {"positive": "n > 0"})
    assert rows(good) == [("a", 3)] and sorted(r["broken"][0] for r in bad.collect()) == ["malformed", "positive"]


def test_store(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    a = spark.createDataFrame([(1, None), (2, "x")], "k int, v string")
    first = s.publish("d", "raw", a)
    assert s.publish("d", "raw", a.orderBy(F.desc("k"))) == first == s.latest("d", "raw")
    second = s.publish("d", "clean", a.where("v is not null"), [first])
    assert s.lineage(second) == [second, first] and s.verify(second) and s.records(second).count() == 1
    s.records(second).union(s.records(second)).write.mode("append").parquet(f"{tmp_path}/store/d/clean/{second['version']}")
    assert not s.verify(second) and s.latest("d", "none") is None


def test_clearing_reaches_the_fixed_point(spark):
    """A ring that loses 4 of 9 parts a step settles long after 20 rounds."""
    n = 8
    links = [(i, (i + 1) % n, 100.0) for i in range(n)] + [(i, n, 80.0) for i in range(n)]
    cash = {0: 5.0, 3: 1.0}
    paid, due = {i: 180.0 for i in range(n)}, 180.0
    for _ in range(500):
        paid = {i: min(due, cash.get(i, 0.0) + paid[(i - 1) % n] * 100 / due) for i in range(n)}
    debts = spark.createDataFrame(links, "borrower int, lender int, amount double")
    funds = spark.createDataFrame(list(cash.items()), "id int, cash double")
    got = {r["id"]: r["paid"] for r in kernels.clearing(debts, funds, Staging(spark, "t")).collect()}
    assert {i: got[i] for i in range(n)} == {i: pytest.approx(paid[i], abs=1e-4) for i in range(n)}
    with pytest.raises(RuntimeError):
        kernels.clearing(debts, funds, Staging(spark, "t"), max_rounds=5)


def test_chains_longer_than_the_old_caps(spark):
    chain = lambda n, w: spark.createDataFrame([(f"n{i}", f"n{i + 1}", w) for i in range(n)], "subject string, object string, share double")
    first = spark.createDataFrame([("n0",)], "entity string")
    assert dict(rows(kernels.look_through(chain(13, 0.9), first, Staging(spark, "t"))))["n13"] == pytest.approx(0.9**13)
    assert dict(rows(products.aggregate_ownership(chain(23, 1.0), first, 0.5, Staging(spark, "t")), "entity", "round"))["n23"] == 23
    for short in (lambda: kernels.look_through(chain(13, 0.9), first, Staging(spark, "t"), max_rounds=5), lambda: products.aggregate_ownership(chain(23, 1.0), first, 0.5, Staging(spark, "t"), max_rounds=5)):
        with pytest.raises(RuntimeError):
            short()


def test_routes_beyond_the_old_cap(spark):
    far = spark.createDataFrame([(f"n{i}", f"n{i + 1}", 1.0) for i in range(67)], "subject string, object string, weight double")
    assert dict(rows(kernels.routes(far, "n0", Staging(spark, "t"))))["n67"] == 67
    with pytest.raises(RuntimeError):
        kernels.routes(far, "n0", Staging(spark, "t"), max_rounds=5)
