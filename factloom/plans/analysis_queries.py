"""Queries on crosswalks, identity, beliefs, products, statistics and streams, each with its oracle where SQL has one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from factloom import streaming
from factloom.operators import beliefs, causal, crosswalk, econometrics, identity, products, stats
from factloom.operators.staging import Staging
from factloom.plans.tables import SUPPLIES_SQL, money, read, supplies

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# Crosswalks: part types map to brands with weights by count; brands map to size classes.
XW = "(SELECT p_type AS source, p_brand AS target, COUNT(*)::DOUBLE AS weight, TIMESTAMP '1995-01-01' AS valid_from, TIMESTAMP '1999-01-01' AS valid_to FROM part GROUP BY ALL)"
XW2 = "(SELECT p_brand AS source, CAST(p_size // 10 AS VARCHAR) AS target, CASE WHEN p_size // 10 = 4 THEN NULL ELSE 0.5 END::DOUBLE AS weight, TIMESTAMP '1997-01-01' AS valid_from, TIMESTAMP '2001-01-01' AS valid_to FROM part GROUP BY ALL)"
VALUES = "(SELECT p_type AS source, SUM(CAST(p_retailprice AS DECIMAL(18,2)))::DOUBLE AS value, COUNT(*)::DOUBLE AS mass FROM part GROUP BY ALL)"


def _stamp(s: str):
    return F.lit(s).cast("timestamp_ntz")


def xw(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = read(spark, sf_dir, "part").groupBy(F.col("p_type").alias("source"), F.col("p_brand").alias("target")).agg(F.count("*").cast("double").alias("weight"))
    return g.withColumns({"valid_from": _stamp("1995-01-01"), "valid_to": _stamp("1999-01-01")})


def xw2(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.floor(F.col("p_size") / 10)
    g = read(spark, sf_dir, "part").select(F.col("p_brand").alias("source"), t.cast("string").alias("target"), F.when(t != 4, 0.5).alias("weight")).distinct()
    return g.withColumns({"valid_from": _stamp("1997-01-01"), "valid_to": _stamp("2001-01-01")})


def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").groupBy(F.col("p_type").alias("source")).agg(F.sum(money("p_retailprice")).cast("double").alias("value"), F.count("*").cast("double").alias("mass"))


@query(f"WITH s AS (SELECT source, target, weight / SUM(weight) OVER (PARTITION BY source) AS share FROM {XW}) SELECT target, ROUND(SUM(value * share), 4) AS value FROM {VALUES} JOIN s USING (source) GROUP BY target")
def apportion(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapped, _ = crosswalk.apportion(totals(spark, sf_dir), crosswalk.active(xw(spark, sf_dir), "1998-01-01"))
    return mapped.withColumn("value", F.round("value", 4))


@query(f"SELECT target, ROUND(SUM(value * mass * weight) / SUM(mass * weight), 6) AS value FROM {VALUES} JOIN {XW} USING (source) GROUP BY target")
def weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosswalk.weighted_mean(totals(spark, sf_dir), xw(spark, sf_dir)).withColumn("value", F.round("value", 6))


@query(f"""SELECT a.source, b.target, GREATEST(a.valid_from, b.valid_from) AS valid_from, LEAST(a.valid_to, b.valid_to) AS valid_to,
CASE WHEN COUNT(*) = COUNT(b.weight) THEN SUM(a.weight * b.weight) END AS weight FROM (SELECT source, target, valid_from, valid_to, COALESCE(weight, CASE WHEN COUNT(*) OVER (PARTITION BY source) = 1 THEN 1.0 END) AS weight FROM {XW}) a
JOIN (SELECT source, target, valid_from, valid_to, COALESCE(weight, CASE WHEN COUNT(*) OVER (PARTITION BY source) = 1 THEN 1.0 END) AS weight FROM {XW2}) b ON a.target = b.source GROUP BY 1, 2, 3, 4""")
def crosswalk_compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosswalk.compose(xw(spark, sf_dir), xw2(spark, sf_dir))


@query(f"SELECT source, SUM(weight) AS total, COUNT(*) FILTER (weight IS NULL) AS unweighted FROM {XW2} GROUP BY source HAVING COUNT(*) FILTER (weight IS NULL) > 0 OR ABS(COALESCE(SUM(weight), 0) - 1) > 1e-6")
def check_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosswalk.check_partition(xw2(spark, sf_dir))


PAIRS = "(SELECT DISTINCT o_custkey AS source, o_custkey // 3 + CASE WHEN o_custkey % 10 = 0 THEN o_orderkey % 2 ELSE 0 END AS target FROM orders)"


@query(f"""WITH p AS {PAIRS}, r AS (SELECT c_custkey AS source, c_nationkey // 13 AS rate FROM customer WHERE c_custkey % 11 <> 0),
split AS (SELECT source FROM p GROUP BY source HAVING COUNT(*) > 1), ok AS (SELECT * FROM p WHERE target NOT IN (SELECT target FROM p WHERE source IN (FROM split)))
SELECT target, MIN(rate) AS rate FROM ok LEFT JOIN r USING (source) GROUP BY target HAVING COUNT(*) = COUNT(rate) AND COUNT(DISTINCT rate) = 1""")
def exact_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    third = F.expr("o_custkey div 3 + case when o_custkey % 10 = 0 then o_orderkey % 2 else 0 end")
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source"), third.alias("target"))
    rates = read(spark, sf_dir, "customer").where("c_custkey % 11 <> 0").select(F.col("c_custkey").alias("source"), F.expr("cast(c_nationkey div 13 as int)").alias("rate"))
    return crosswalk.exact_translation(rows, rates)


@query(f"""WITH p AS {PAIRS} SELECT source, target FROM p WHERE source IN (SELECT source FROM p GROUP BY 1 HAVING COUNT(*) = 1) AND target IN (SELECT target FROM p GROUP BY 1 HAVING COUNT(*) = 1)""")
def one_to_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    third = F.expr("o_custkey div 3 + case when o_custkey % 10 = 0 then o_orderkey % 2 else 0 end")
    return crosswalk.one_to_one(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source"), third.alias("target")))


@query("""WITH r AS (SELECT DISTINCT event_type AS currency, date_trunc('day', ts) AS t FROM events WHERE event_id % 40 = 0), x AS (SELECT currency, t, (day(t) + 10) / 10.0::DOUBLE AS rate FROM r)
SELECT event_id, ROUND(value * (SELECT MAX_BY(rate, t) FROM x WHERE currency = event_type AND t <= ts AND t >= ts - INTERVAL 1 DAY), 6) AS converted FROM events""")
def currency_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    rates = e.where("event_id % 40 = 0").select(F.col("event_type").alias("currency"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("at")).distinct().withColumn("rate", (F.day("at") + 10) / 10)
    amounts = e.select("event_id", "ts", F.col("event_type").alias("currency"), F.col("value").alias("amount"))
    return crosswalk.convert_currency(amounts, rates, "ts", "1 day").select("event_id", F.round("converted", 6).alias("converted"))


@query("""WITH i AS (SELECT year(o_orderdate) AS y, AVG(CAST(o_totalprice AS DECIMAL(18,2))::DOUBLE) AS level FROM orders GROUP BY 1)
SELECT o_orderkey, ROUND(o_totalprice * (SELECT level FROM i WHERE y = 1996) / level, 4) AS real FROM orders JOIN i ON y = year(o_orderdate)""")
def deflate(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"), F.col("o_totalprice").alias("amount"))
    index = o.groupBy(F.col("y").alias("period")).agg(F.avg("amount").alias("level"))
    return crosswalk.deflate(o, index, "y", 1996).select("o_orderkey", F.round("real", 4).alias("real"))


@query("""SELECT p_partkey, ROUND(CASE p_size % 3 WHEN 0 THEN p_retailprice * 1000 WHEN 1 THEN p_retailprice * 453.59237 END / 1000, 9) AS converted FROM part""")
def unit_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.element_at(F.array(F.lit("kg"), F.lit("lb"), F.lit("m")), F.col("p_size") % 3 + 1)
    units = spark.createDataFrame([("kg", 1000.0, 0.0, "mass"), ("lb", 453.59237, 0.0, "mass"), ("m", 1.0, 0.0, "length")], "unit string, scale double, shift double, dimension string")
    values = read(spark, sf_dir, "part").select("p_partkey", unit.alias("unit"), F.col("p_retailprice").alias("value"))
    return crosswalk.convert_units(values, units, "kg").select("p_partkey", F.round("converted", 9).alias("converted"))


# Identity

CLAIMS = "(SELECT 'customer:' || c_custkey AS subject, 'balance' AS namespace, CAST(CAST(c_acctbal AS BIGINT) // 5 AS VARCHAR) AS value, 'd' || c_nationkey % 2 AS dataset FROM customer UNION ALL SELECT 'customer:' || c_custkey // 2, 'balance', CAST(CAST(c_acctbal AS BIGINT) // 5 AS VARCHAR), 'd2' FROM customer WHERE c_custkey % 50 = 0)"


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    value = F.expr("cast(cast(bround(c_acctbal) as bigint) div 5 as string)").alias("value")
    first = c.select(F.expr("concat('customer:', c_custkey)").alias("subject"), F.lit("balance").alias("namespace"), value, F.expr("concat('d', c_nationkey % 2)").alias("dataset"))
    second = c.where("c_custkey % 50 = 0").select(F.expr("concat('customer:', c_custkey div 2)").alias("subject"), F.lit("balance").alias("namespace"), value, F.lit("d2").alias("dataset"))
    return first.unionByName(second)


@query(f"""WITH c AS (SELECT DISTINCT subject, namespace, value FROM {CLAIMS}), k AS (SELECT * FROM c WHERE subject NOT IN (SELECT subject FROM c GROUP BY subject HAVING COUNT(*) > 1)),
f AS (SELECT value, MIN(subject) AS a FROM k GROUP BY value) SELECT a, subject AS b, namespace, value FROM k JOIN f USING (value) WHERE subject <> a""")
def shared_identifier_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.shared_identifier_links(claims(spark, sf_dir).drop("dataset"))


@query(f"SELECT * FROM {CLAIMS} c WHERE NOT EXISTS (SELECT 1 FROM (SELECT dataset, value FROM {CLAIMS} GROUP BY 1, 2 HAVING COUNT(DISTINCT subject) > 1) v WHERE v.dataset = c.dataset AND v.value = c.value)")
def cardinality_refusal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.refuse_cardinality(claims(spark, sf_dir), "subject", "value").select("subject", "namespace", "value", "dataset")


@query("""WITH r AS (SELECT l_suppkey AS source, l_linenumber AS target, l_shipdate AS valid_from, l_shipdate + INTERVAL 2 DAY AS valid_to, l_orderkey AS k FROM lineitem)
SELECT DISTINCT k, source, target FROM r a WHERE EXISTS (SELECT 1 FROM r b WHERE b.source = a.source AND b.target <> a.target AND b.valid_from < a.valid_to AND a.valid_from < b.valid_to)""")
def link_mapping_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_linenumber").alias("target"), F.col("l_shipdate").alias("valid_from"), (F.col("l_shipdate") + F.expr("interval 2 days")).alias("valid_to"), F.col("l_orderkey").alias("k"))
    return identity.overlapping_conflicts(r, "source", "target").select("k", "source", "target").distinct()


BLOCKS = "(SELECT c_custkey AS rid, c_nationkey || '|' || CAST(floor(c_acctbal / 100) AS BIGINT) AS key FROM customer)"


def block_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("rid"), F.concat_ws("|", "c_nationkey", F.floor(F.col("c_acctbal") / 100).cast("long")).alias("key"))


@query(f"SELECT DISTINCT x.rid AS a, y.rid AS b FROM {BLOCKS} x JOIN {BLOCKS} y ON x.key = y.key AND x.rid < y.rid")
def blocking_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.blocked_pairs(read(spark, sf_dir, "customer"), block_keys(spark, sf_dir))


@query(f"""SELECT x.rid AS a, y.rid AS b, CASE WHEN cx.c_mktsegment = cy.c_mktsegment THEN 2 ELSE 0 END AS segment,
CASE WHEN levenshtein(cx.c_name, cy.c_name) <= 1 THEN 2 WHEN levenshtein(cx.c_name, cy.c_name) <= 2 THEN 1 ELSE 0 END AS name
FROM {BLOCKS} x JOIN {BLOCKS} y ON x.key = y.key AND x.rid < y.rid JOIN customer cx ON cx.c_custkey = x.rid JOIN customer cy ON cy.c_custkey = y.rid""")
def agreement_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("rid"), F.col("c_mktsegment").alias("segment"), F.col("c_name").alias("name"))
    return identity.agreement(identity.blocked_pairs(records, block_keys(spark, sf_dir)), records, ["segment"], {"name": (1, 2)})


TOKENS = "(SELECT item_id AS rid, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM benchmark)"


@query(f"""WITH t AS {TOKENS}, tf AS (SELECT rid, token, COUNT(*) AS tf FROM t GROUP BY ALL), d AS (SELECT token, COUNT(*) AS df FROM tf GROUP BY 1),
v AS (SELECT rid, token, tf * (ln((1 + (SELECT COUNT(DISTINCT rid) FROM t))::DOUBLE / (1 + df)) + 1) AS w FROM tf JOIN d USING (token)), n AS (SELECT rid, sqrt(SUM(w * w)) AS norm FROM v GROUP BY 1)
SELECT a.rid AS a, b.rid AS b, ROUND(COALESCE(SUM(x.w * y.w), 0) / (ANY_VALUE(a.norm) * ANY_VALUE(b.norm)), 9) AS cosine FROM n a JOIN n b ON b.rid = a.rid + 1 LEFT JOIN v x ON x.rid = a.rid LEFT JOIN v y ON y.rid = b.rid AND y.token = x.token GROUP BY 1, 2""")
def tfidf_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "benchmark")
    pairs = items.select(F.col("item_id").alias("a"), (F.col("item_id") + 1).alias("b")).join(items.select(F.col("item_id").alias("b")), "b").select("a", "b")
    tokens = products.tokens(items, "item_id", "text").withColumnRenamed("id", "rid")
    return identity.tfidf_similarity(tokens, pairs).withColumn("cosine", F.round("cosine", 9))


@query("""WITH m AS (SELECT 'n' || c_nationkey AS entity, 'customer' AS dataset FROM customer WHERE c_acctbal > 9000 UNION SELECT 'n' || s_nationkey, 'supplier' FROM supplier WHERE s_acctbal > 5000 UNION SELECT 'n' || n_nationkey, 'nation' FROM nation),
s AS (SELECT entity, string_agg(dataset, '+' ORDER BY dataset) AS datasets, COUNT(*) AS k FROM m GROUP BY 1) SELECT datasets, k, COUNT(*) AS entities FROM s GROUP BY ALL""")
def join_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda c: F.concat(F.lit("n"), F.col(c).cast("string")).alias("entity")
    m = read(spark, sf_dir, "customer").where("c_acctbal > 9000").select(name("c_nationkey"), F.lit("customer").alias("dataset"))
    m = m.unionByName(read(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(name("s_nationkey"), F.lit("supplier").alias("dataset")))
    m = m.unionByName(read(spark, sf_dir, "nation").select(name("n_nationkey"), F.lit("nation").alias("dataset")))
    return identity.join_coverage(m, spark.createDataFrame([], "entity string, canonical string"))


# Beliefs: what lines say about the quantity of a part, by shipping mode of claim.
BELIEF = "(SELECT 'c:' || l_partkey || ':' || l_orderkey || ':' || l_suppkey || ':' || l_linenumber AS id, l_partkey AS subject, CAST(l_quantity AS BIGINT) AS value, 'd' || l_linenumber AS dataset, l_shipdate AS observed_at, l_shipdate AS valid_from FROM lineitem)"
DISTINCT_BELIEF = f"(SELECT id, subject, MAX(value) AS value, MIN(dataset) AS dataset, MAX(observed_at) AS observed_at, MIN(valid_from) AS valid_from FROM {BELIEF} GROUP BY id, subject)"


def belief_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = read(spark, sf_dir, "lineitem")
    rows = line.select(F.concat_ws(":", F.lit("c"), "l_partkey", "l_orderkey", "l_suppkey", "l_linenumber").alias("id"), F.col("l_partkey").alias("subject"), F.col("l_quantity").cast("long").alias("value"), F.concat(F.lit("d"), F.col("l_linenumber").cast("string")).alias("dataset"), F.col("l_shipdate").alias("t"))
    one = rows.groupBy("id", "subject").agg(F.max("value").alias("value"), F.min("dataset").alias("dataset"), F.max("t").alias("observed_at"), F.min("t").alias("valid_from"))
    return one.withColumn("valid_to", F.lit(None).cast("timestamp_ntz"))


@query(f"""WITH s AS (SELECT * FROM {DISTINCT_BELIEF} WHERE observed_at <= TIMESTAMP '1999-01-01'), m AS (SELECT subject, ARG_MAX(value, (observed_at, id, value)) AS v, MAX(observed_at) AS o FROM s GROUP BY 1)
SELECT subject, ANY_VALUE(v) AS value, date_diff('day', CAST(ANY_VALUE(o) AS DATE), DATE '1999-01-01') AS age_days, COUNT(*) AS claims, ROUND(COUNT(*) FILTER (value IS DISTINCT FROM v) / COUNT(*), 9) AS conflict_share FROM s JOIN m USING (subject) GROUP BY subject""")
def beliefs_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return beliefs.latest_beliefs(belief_claims(spark, sf_dir), ["subject"], "1999-01-01").withColumn("conflict_share", F.round("conflict_share", 9))


@query(f"""WITH s AS (SELECT *, CASE dataset WHEN 'd1' THEN 1.0 WHEN 'd2' THEN 0.8 ELSE 0.5 END * POWER(0.5, date_diff('day', CAST(observed_at AS DATE), DATE '1999-01-01') / 365.0) AS w FROM {DISTINCT_BELIEF} WHERE observed_at <= TIMESTAMP '1999-01-01')
SELECT subject, ROUND(SUM(value * w) / SUM(w), 6) AS value, ROUND(SUM(w), 6) AS weight, COUNT(*) AS claims FROM s GROUP BY subject""")
def beliefs_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = beliefs.weighted_beliefs(belief_claims(spark, sf_dir), ["subject"], "1999-01-01", {"d1": 1.0, "d2": 0.8}, 365.0)
    return out.select("subject", F.round("value", 6).alias("value"), F.round("weight", 6).alias("weight"), "claims")


@query(f"""WITH s AS (SELECT * FROM {DISTINCT_BELIEF} WHERE observed_at <= TIMESTAMP '1999-01-01' AND valid_from <= TIMESTAMP '1998-06-01'),
r AS (SELECT *, DENSE_RANK() OVER (PARTITION BY subject ORDER BY CASE dataset WHEN 'd2' THEN 1 WHEN 'd1' THEN 2 ELSE 3 END) AS k FROM s)
SELECT subject, CASE WHEN COUNT(DISTINCT value) = 1 THEN 'resolved' ELSE 'conflicting' END AS status, CASE WHEN COUNT(DISTINCT value) = 1 THEN MIN(value) END AS value, COUNT(*) AS claims, COUNT(DISTINCT value) AS kinds FROM r WHERE k = 1 GROUP BY subject""")
def reconcile_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return beliefs.reconcile(belief_claims(spark, sf_dir), ["subject"], "1998-06-01", "1999-01-01", "source_priority", ["d2", "d1"])


@query("""SELECT 'balance' AS namespace, CAST(o_custkey // 4 AS VARCHAR) AS value, CASE COUNT(DISTINCT CASE WHEN o_orderdate <= TIMESTAMP '1998-01-01' AND o_orderdate + INTERVAL 60 DAY > TIMESTAMP '1998-01-01' THEN o_custkey END) WHEN 0 THEN 'expired' WHEN 1 THEN 'resolved' ELSE 'ambiguous' END AS status FROM orders GROUP BY 2""")
def resolve_identifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select(F.lit("balance").alias("namespace"), F.expr("cast(o_custkey div 4 as string)").alias("value"), F.col("o_custkey").alias("subject"), F.col("o_orderdate").alias("valid_from"), (F.col("o_orderdate") + F.expr("interval 60 days")).alias("valid_to"))
    return beliefs.identifier_status(o, "1998-01-01").select("namespace", "value", "status")


@query("""WITH e AS (SELECT * FROM events WHERE ts <= TIMESTAMP '2024-01-20'), g AS (SELECT user_id, MIN(ts) FILTER (event_type = 'signup') AS born, MAX(ts) FILTER (event_type = 'error') AS ended, COUNT(*) AS n_events FROM e GROUP BY 1)
SELECT user_id AS entity, born, ended, n_events, CASE WHEN born IS NULL THEN 'unborn' WHEN ended > born THEN 'ended' ELSE 'alive' END AS state FROM g""")
def lifecycle_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("entity"), F.col("event_type").alias("type"), F.col("ts").alias("occurred_at"))
    return beliefs.lifecycle(e, ["signup"], ["error"], "2024-01-20")


# Products

WORDS = ("the", "tion", "und", "license")


@query("WITH d AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents), s AS (SELECT COUNT(*) AS n, AVG(len(w)) AS m FROM d), t AS (SELECT id, len(w) AS l, " + ", ".join(f"len(list_filter(w, lambda x: x = '{w}')) AS t{i}" for i, w in enumerate(WORDS)) + " FROM d), f AS (SELECT " + ", ".join(f"COUNT(*) FILTER (t{i} > 0) AS f{i}" for i in range(len(WORDS))) + " FROM t), r AS (SELECT id, " + " + ".join(f"ln((n - f{i} + 0.5) / (f{i} + 0.5) + 1) * t{i} * 2.2 / (t{i} + 1.2 * (0.25 + 0.75 * l / m))" for i in range(len(WORDS))) + " AS score FROM t, s, f) SELECT id, ROUND(score, 9) AS score FROM r WHERE score > 0 ORDER BY ROUND(score, 9) DESC, id LIMIT 20")
def search_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products.bm25(read(spark, sf_dir, "documents"), "doc_id", "text", list(WORDS)).withColumn("score", F.round("score", 9))


@query("""SELECT qid, id, rank, ROUND(distance, 6) AS distance FROM (SELECT q.vec_id AS qid, v.vec_id AS id, list_distance(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS distance,
ROW_NUMBER() OVER (PARTITION BY q.vec_id ORDER BY list_distance(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), v.vec_id) AS rank FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0) WHERE rank <= 10""")
def nearest_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = read(spark, sf_dir, "embeddings")
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").cast("array<double>").alias("q"))
    return products.nearest(v.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), q, 10).withColumn("distance", F.round("distance", 6))


SHARES = f"(SELECT subject, object, SUM(weight)::DOUBLE / SUM(SUM(weight)::DOUBLE) OVER (PARTITION BY object) AS share FROM {SUPPLIES_SQL} GROUP BY subject, object)"


def shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    g = supplies(spark, sf_dir).groupBy("subject", "object").agg(F.sum("weight").cast("double").alias("w"))
    return g.select("subject", "object", (F.col("w") / F.sum("w").over(W.partitionBy("object"))).alias("share"))


@query(f"""WITH l AS (SELECT 'supplier:' || s_suppkey AS entity FROM supplier WHERE s_acctbal < 0), h AS (SELECT object AS entity, SUM(share) AS held FROM {SHARES} WHERE subject IN (FROM l) GROUP BY 1)
SELECT entity, 0 AS round, 'designated' AS basis FROM l UNION ALL SELECT entity, 1, 'ownership_aggregate' FROM h WHERE held >= 0.25 - 1e-12 AND held > 0""")
def blocking_fixpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = read(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("entity"))
    return products.aggregate_ownership(shares(spark, sf_dir), listed, 0.25, Staging(spark, "screen"))


@query(f"""WITH l AS (SELECT 'supplier:' || s_suppkey AS entity FROM supplier WHERE s_acctbal < 0), s AS (SELECT 'part:' || p_partkey AS subject FROM part UNION ALL FROM l),
m AS (SELECT object AS subject, subject AS listed, 1 AS hop, share FROM {SHARES} WHERE subject IN (FROM l) AND share >= 0.05 UNION ALL SELECT entity, entity, 0, 1.0 FROM l)
SELECT subject, listed, hop, ROUND(share, 9) AS share, 'match' AS status FROM m UNION ALL SELECT subject, NULL, NULL, NULL, 'clear' FROM s WHERE subject NOT IN (SELECT subject FROM m)""")
def screen_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and suppliers screened for listed suppliers above them."""
    listed = read(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("entity"))
    subjects = read(spark, sf_dir, "part").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("entity")).unionByName(listed)
    return products.screen(shares(spark, sf_dir), listed, subjects, 2, Staging(spark, "screen"), 0.05).withColumn("share", F.round("share", 9))


@query(f"""WITH p AS (SELECT 'out' AS direction, predicate, object AS other, COUNT(*) AS n FROM {SUPPLIES_SQL} WHERE subject = 'supplier:5' GROUP BY ALL), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY direction, predicate ORDER BY n DESC, other) AS k FROM p)
SELECT direction, predicate, SUM(n)::BIGINT AS n_edges, COUNT(*) AS n_others, string_agg(other, ',' ORDER BY k) FILTER (k <= 3) AS examples FROM r GROUP BY ALL""")
def dossier_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products.edge_groups(supplies(spark, sf_dir), "supplier:5")


@query(f"""WITH e AS (SELECT DISTINCT subject AS a, object AS b FROM {SUPPLIES_SQL} UNION SELECT object, subject FROM {SUPPLIES_SQL}), d AS (SELECT a, COUNT(*) AS k FROM e WHERE a IN (SELECT b FROM e WHERE a = 'supplier:5') GROUP BY 1)
SELECT e.b AS entity, COUNT(*) AS shared FROM e JOIN d ON e.a = d.a WHERE k <= 25 AND e.b <> 'supplier:5' GROUP BY 1""")
def counterparties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products.counterparties(supplies(spark, sf_dir), "supplier:5", 25)


# Statistics

FORECASTS = "(SELECT l_returnflag AS model, l_extendedprice AS actual, l_quantity * 1050.0 AS mean, 500.0 + l_quantity * 20 AS sd FROM lineitem)"


@query(f"""SELECT model, ROUND(AVG(ABS(mean - actual)), 4) AS mae, ROUND(SQRT(AVG((mean - actual) * (mean - actual))), 4) AS rmse, ROUND(AVG(mean - actual), 4) AS bias, ROUND(AVG(CASE WHEN ABS(mean - actual) <= 1.2815515655446004 * sd THEN 1.0 ELSE 0 END), 9) AS coverage, ROUND(AVG(2 * 1.2815515655446004 * sd), 4) AS width, COUNT(*) AS n FROM {FORECASTS} GROUP BY model""")
def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("model"), F.col("l_extendedprice").alias("actual"), (F.col("l_quantity") * 1050.0).alias("mean"), (F.col("l_quantity") * 20 + 500.0).alias("sd"))
    out = stats.forecast_scores(rows, ["model"])
    return out.select("model", *[F.round(c, 9 if c == "coverage" else 4).alias(c) for c in ("mae", "rmse", "bias", "coverage", "width")], "n")


@query("SELECT CAST(LEAST(FLOOR(l_discount * 10 * 10), 9) AS BIGINT) AS bin, COUNT(*) AS n, ROUND(AVG(l_discount * 10), 6) AS predicted, ROUND(AVG(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0 END), 9) AS observed FROM lineitem GROUP BY 1")
def calibration_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select((F.col("l_discount") * 10).alias("p"), (F.col("l_returnflag") == "R").cast("int").alias("y"))
    return stats.calibration_curve(rows, 10).select("bin", "n", F.round("predicted", 6).alias("predicted"), F.round("observed", 9).alias("observed"))


@query("""WITH r AS (SELECT l_shipdate, l_returnflag AS g, RANK() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (COUNT(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS x, RANK() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (COUNT(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0 AS y FROM lineitem)
SELECT g, ROUND(CORR(x::DOUBLE, y::DOUBLE), 8) AS rho, COUNT(*) AS n FROM r GROUP BY g""")
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "g")
    return stats.spearman(rows, ["g"], "l_quantity", "l_extendedprice").withColumn("rho", F.round("rho", 8))


@query("""WITH r AS (SELECT c_nationkey, c_acctbal, ROW_NUMBER() OVER (PARTITION BY c_nationkey ORDER BY c_custkey % 97 DESC, c_custkey) AS s, ROW_NUMBER() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS o FROM customer)
SELECT c_nationkey, ROUND(COUNT(*) FILTER (s <= 20 AND o <= 20) / LEAST(20, COUNT(*)), 9) AS capture, ROUND(AVG(c_acctbal) FILTER (s <= 20) - AVG(c_acctbal), 4) AS lift FROM r GROUP BY 1""")
def topk_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "customer").withColumn("score", F.col("c_custkey") % 97)
    return stats.top_k_capture(rows, ["c_nationkey"], "score", "c_acctbal", "c_custkey", 20).select("c_nationkey", F.round("capture", 9).alias("capture"), F.round("lift", 4).alias("lift"))


@query(f"""WITH p AS (SELECT object, subject, SUM(weight)::DOUBLE AS w FROM {SUPPLIES_SQL} GROUP BY ALL) SELECT object, ROUND(SUM(w), 2) AS inflow, COUNT(*) AS sources, ROUND(SUM(w * w) / (SUM(w) * SUM(w)), 9) AS hhi, ROUND(MAX(w) / SUM(w), 9) AS top_share FROM p GROUP BY 1""")
def hhi_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = supplies(spark, sf_dir).withColumn("weight", F.col("weight").cast("double"))
    return stats.concentration(e).select("object", F.round("inflow", 2).alias("inflow"), "sources", F.round("hhi", 9).alias("hhi"), F.round("top_share", 9).alias("top_share"))


CELLS = "(SELECT c_nationkey AS region, c_mktsegment AS industry, SUM(CASE WHEN year(o_orderdate) = 1996 THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END)::DOUBLE AS base, SUM(CASE WHEN year(o_orderdate) = 1999 THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END)::DOUBLE AS later FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"


@query(f"""WITH c AS (SELECT *, SUM(base) OVER (PARTITION BY industry) - base AS b, SUM(later) OVER (PARTITION BY industry) - later AS l, SUM(base) OVER (PARTITION BY region) AS r FROM {CELLS}) SELECT region, ROUND(SUM(base / r * LN(l / b)), 8) AS shock FROM c WHERE b > 0 AND l > 0 AND r > 0 GROUP BY 1""")
def shift_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    of = lambda y: F.sum(F.when(F.year("o_orderdate") == y, money("o_totalprice")).otherwise(0)).cast("double")
    cells = j.groupBy(F.col("c_nationkey").alias("region"), F.col("c_mktsegment").alias("industry")).agg(of(1996).alias("base"), of(1999).alias("later"))
    return stats.shift_share(cells).withColumn("shock", F.round("shock", 8))


@query("""WITH s AS (SELECT MIN(l_quantity) AS a, MAX(l_quantity) AS b, MIN(l_linenumber) AS c, MAX(l_linenumber) AS d FROM lineitem), r AS (SELECT unnest(['l_quantity', 'l_linenumber']) AS dimension, unnest([LEAST(FLOOR((l_quantity - a) * 8 / (b - a)), 7), LEAST(FLOOR((l_linenumber - c) * 8.0 / (d - c)), 7)]) AS bin, l_returnflag = 'R' AS f FROM lineitem, s)
SELECT dimension, CAST(bin AS BIGINT) AS bin, COUNT(*) AS n, ROUND(AVG(f::INT), 9) AS rate FROM r GROUP BY ALL HAVING COUNT(*) >= 10""")
def failure_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").withColumn("failed", (F.col("l_returnflag") == "R").cast("int"))
    return stats.failure_regions(rows, ["l_quantity", "l_linenumber"], 8, 10).withColumn("rate", F.round("rate", 9))


PANEL = "(SELECT c_custkey AS unit, y AS period, c_acctbal / 100 + y * (1 + c_custkey % 3) + CASE WHEN c_custkey % 4 > 0 AND y >= 3 + c_custkey % 4 THEN 5 ELSE 0 END AS y, CASE WHEN c_custkey % 4 > 0 THEN 3 + c_custkey % 4 END AS cohort FROM customer, range(0, 10) t(y))"


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").withColumn("period", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))))
    cohort = F.when(F.col("c_custkey") % 4 > 0, F.col("c_custkey") % 4 + 3)
    y = F.col("c_acctbal") / 100 + F.col("period") * (1 + F.col("c_custkey") % 3) + F.when(F.col("period") >= cohort, 5).otherwise(0)
    return c.select(F.col("c_custkey").alias("unit"), "period", y.alias("y"), cohort.alias("cohort"))


ATT = f"""p AS {PANEL}, t AS (SELECT a.cohort, a.period, AVG(a.y - b.y) AS d1, COUNT(*) AS n_treated FROM p a JOIN p b ON a.unit = b.unit AND b.period = a.cohort - 1 GROUP BY ALL),
k AS (SELECT g.cohort, a.period, AVG(a.y - b.y) AS d0, COUNT(*) AS n_control FROM (SELECT DISTINCT cohort FROM p WHERE cohort IS NOT NULL) g JOIN p b ON b.period = g.cohort - 1 AND b.cohort IS NULL JOIN p a ON a.unit = b.unit AND a.cohort IS NULL GROUP BY ALL),
att AS (SELECT cohort, period, d1 - d0 AS att, n_treated, n_control FROM t JOIN k USING (cohort, period) WHERE period <> cohort - 1)"""


@query(f"WITH {ATT} SELECT cohort, period, ROUND(att, 8) AS att, n_treated, n_control FROM att")
def att_gt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group-time effects with never-treated controls."""
    cells = causal.att_gt(panel(spark, sf_dir), Staging(spark, "did"), "never_treated").cells
    return cells.select(F.col("g").alias("cohort"), F.col("t").alias("period"), F.round("att", 8).alias("att"), "n_treated", "n_control")


@query(f"WITH {ATT} SELECT period - cohort AS event_time, ROUND(SUM(att * n_treated) / SUM(n_treated), 8) AS att, SUM(n_treated)::BIGINT AS n_treated FROM att GROUP BY 1")
def event_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    st = Staging(spark, "did")
    by_e, _ = causal.event_time(causal.att_gt(panel(spark, sf_dir), st, "never_treated"), st, -100, 100)
    return by_e.select(F.col("e").alias("event_time"), F.round("att", 8).alias("att"), "n_treated")


@query("""WITH o AS (SELECT p_brand AS policy, p_type AS scenario, 1.0 AS p, SUM(CAST(p_retailprice AS DECIMAL(18,2)))::DOUBLE AS value FROM part GROUP BY ALL), r AS (SELECT *, MAX(value) OVER (PARTITION BY scenario) - value AS g FROM o)
SELECT policy, ROUND(SUM(p * value) / SUM(p), 4) AS expected, ROUND(MIN(value), 2) AS worst, ROUND(MAX(g), 2) AS max_regret FROM r GROUP BY 1""")
def regret_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("policy"), F.col("p_type").alias("scenario")).agg(F.sum(money("p_retailprice")).cast("double").alias("value")).withColumn("p", F.lit(1.0))
    return stats.regret_ranking(o).select("policy", F.round("expected", 4).alias("expected"), F.round("worst", 2).alias("worst"), F.round("max_regret", 2).alias("max_regret"))


@query("""WITH k AS (SELECT DISTINCT o_custkey AS key FROM orders WHERE o_orderstatus = 'F'), m AS (SELECT c_custkey AS key FROM customer WHERE c_custkey % 5 <> 0)
SELECT (SELECT COUNT(*) FROM k) AS measured, (SELECT COUNT(*) FROM m) AS population, (SELECT COUNT(*) FROM k WHERE key IN (FROM m)) AS covered, (SELECT COUNT(*) FROM k WHERE key NOT IN (FROM m)) AS outside, (SELECT COUNT(*) FROM k WHERE key IN (FROM m))::DOUBLE / (SELECT COUNT(*) FROM m) AS share""")
def coverage_of_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.coverage_of_population(read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("key")), read(spark, sf_dir, "customer").where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("key")))


@query("SELECT l_returnflag, ROUND(quantile_cont(l_extendedprice, 0.25), 6) AS q25, ROUND(quantile_cont(l_extendedprice, 0.5), 6) AS q50, ROUND(quantile_cont(l_extendedprice, 0.9), 6) AS q90 FROM lineitem GROUP BY 1")
def quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.column_quantiles(read(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.25, 0.5, 0.9])
    return out.select("l_returnflag", *[F.round(c, 6).alias(c) for c in ("q25", "q50", "q90")])


@query("SELECT ROUND(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, ROUND(regr_slope(l_extendedprice, l_quantity), 6) AS slope FROM lineitem")
def ols_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = econometrics.ols(read(spark, sf_dir, "lineitem"), "l_extendedprice", ["const", "l_quantity"]).params
    return spark.range(1).select(F.round(F.lit(b["const"]), 4).alias("intercept"), F.round(F.lit(b["l_quantity"]), 6).alias("slope"))


# Streams, each run to the end over the event file


def _events(df: DataFrame) -> DataFrame:
    return df.select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), money("value").alias("amount"))


def _stream(spark: SparkSession, sf_dir: str, shape, mode: str) -> DataFrame:
    return streaming.run_available(spark, f"{sf_dir}/events.parquet", lambda df: shape(_events(df)), mode)


@query("SELECT CAST(time_bucket(INTERVAL 1 HOUR, ts) AS TIMESTAMP) AS start, event_type, COUNT(*) AS n, SUM(CAST(value AS DECIMAL(18,2)))::DOUBLE AS total FROM events GROUP BY ALL".replace("GROUP BY ALL", "GROUP BY 1, 2"))
def tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _stream(spark, sf_dir, lambda e: streaming.tumbling(e, "ts", ["event_type"], "1 hour", "365 days"), "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.col("total").cast("double").alias("total"))


@query("SELECT CAST(time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL (h) HOUR AS TIMESTAMP) AS start, event_type, COUNT(*) AS n FROM events, range(0, 3) r(h) GROUP BY 1, 2")
def sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _stream(spark, sf_dir, lambda e: streaming.sliding(e, "ts", ["event_type"], "3 hours", "1 hour", "365 days"), "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("""WITH g AS (SELECT *, CASE WHEN ts - LAG(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, SUM(f) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
SELECT user_id, MIN(ts) AS start, MAX(ts) + INTERVAL 30 MINUTE AS "end", COUNT(*) AS n FROM s GROUP BY user_id, k""")
def session(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _stream(spark, sf_dir, lambda e: streaming.sessions(e, "ts", ["user_id"], "30 minutes", "365 days"), "complete")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("SELECT DISTINCT event_id, user_id FROM events")
def dedup_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stream(spark, sf_dir, lambda e: streaming.deduplicated(e, "ts", ["event_id", "user_id"], "365 days"), "append").select("event_id", "user_id")


@query("SELECT user_id, MAX(ts) AS ts, ARG_MAX(CAST(value AS DECIMAL(18,2)), (ts, CAST(value AS DECIMAL(18,2))))::DOUBLE AS amount FROM events GROUP BY 1")
def stateful_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _stream(spark, sf_dir, lambda e: streaming.latest(e, ["user_id"], "ts", "amount"), "complete")
    return out.select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("amount").cast("double").alias("amount"))


@query("""SELECT event_id, CASE WHEN ts >= TIMESTAMP '2024-01-01' + to_days(CAST(c_custkey % 20 AS INT)) THEN c_mktsegment END AS segment FROM events LEFT JOIN customer ON c_custkey = user_id""")
def stream_table_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a stream with a table that is valid from a date of each key."""
    since = F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(cast(c_custkey % 20 as int))").cast("timestamp")
    table = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"), since.alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"))
    return _stream(spark, sf_dir, lambda e: streaming.enriched(e, table, ["user_id"], "ts").select("event_id", "segment"), "append")


@query("""SELECT a.event_id AS first_id, b.event_id AS then_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 2 HOUR WHERE a.event_type = 'click' AND b.event_type <> 'click'""")
def stream_stream_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks with what the same user does within two hours, both sides streams."""

    def shape(e: DataFrame) -> DataFrame:
        return streaming.followed(e.where("event_type = 'click'"), e.where("event_type <> 'click'"), "user_id", "ts", "2 hours", "1 day").select("first_id", "then_id")

    return _stream(spark, sf_dir, shape, "append")
