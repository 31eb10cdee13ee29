"""Queries on calendar, text and identifier functions, each beside its oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from factloom.functions import dates, identifiers, text
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


def _pick(number: Column, *values: str | None) -> Column:
    """One of the values by a number, as ``_sql_pick`` does in SQL."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(number, F.lit(len(values))) + 1).cast("int"))


def _sql_pick(number: str, *values: str | None) -> str:
    listed = ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values)
    return f"(CAST([{listed}] AS VARCHAR[]))[({number}) % {len(values)} + 1]"


def _period_sql(name: str, part: str, months: int | None, days: int = 0) -> str:
    start = f"CAST(date_trunc('{part}', d) AS DATE)"
    end = f"CAST({start} + INTERVAL {months} MONTH AS DATE)" if months else f"CAST({start} + INTERVAL {days} DAY AS DATE)"
    return f"{start} AS {name}_start, {end} AS {name}_end"


@query(f"""WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT o_orderkey, {_period_sql("daily", "day", None, 1)}, {_period_sql("weekly", "week", None, 7)}, {_period_sql("monthly", "month", 1)}, {_period_sql("quarterly", "quarter", 3)}, {_period_sql("annual", "year", 12)} FROM o""")
def calendar_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start and exclusive end of the period of each frequency that holds a date."""
    d = F.col("o_orderdate").cast("date")
    cols = []
    for f in dates.UNITS:
        start = dates.period_start(d, f)
        cols += [start.alias(f"{f}_start"), dates.period_end(start, f).alias(f"{f}_end")]
    return read(spark, sf_dir, "orders").select("o_orderkey", *cols)


@query("""WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(o_orderkey % 30 AS INT) AS k FROM orders)
SELECT o_orderkey, last_day(CAST(date_trunc('month', d) + to_months(k) AS DATE)) AS month_end_after, CAST(d + to_months(k) AS DATE) AS same_day_after, last_day(make_date(year(d), 12, 31) + to_months(k)) AS year_available,
 d + 1 AS next_day, last_day(d) AS month_end, CAST(date_trunc('month', d) + to_months(k) AS DATE) AS period_end_day, make_date(year(d) + 2, 1, 31) AS flow_available_at, strftime(d, '%Y-%m') AS month_label FROM o""")
def calendar_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates moved by months and years, and what each rule makes of them."""
    d, k = F.col("o_orderdate").cast("date"), (F.col("o_orderkey") % 30).cast("int")
    return read(spark, sf_dir, "orders").select(
        "o_orderkey",
        dates.month_end_after(d, k).alias("month_end_after"),
        dates.same_day_after(d, k).alias("same_day_after"),
        dates.year_available(F.year(d), k).alias("year_available"),
        dates.next_day(d).alias("next_day"),
        dates.month_end(d).alias("month_end"),
        dates.period_end_day(d, k).alias("period_end_day"),
        dates.flow_available_at(F.year(d), 2).alias("flow_available_at"),
        dates.month_label(dates.month_index(d)).alias("month_label"),
    )


@query("""WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(o_orderkey % 23 AS INT) AS k FROM orders)
SELECT o_orderkey, CASE WHEN k = 0 THEN d ELSE (SELECT list(CAST(x AS DATE) ORDER BY x) FILTER (isodow(x) < 6) FROM range(d + INTERVAL 1 DAY, d + INTERVAL 40 DAY, INTERVAL 1 DAY) r(x))[k] END AS due FROM o""")
def business_day_deadlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day a number of weekdays after a date."""
    d, k = F.col("o_orderdate").cast("date"), (F.col("o_orderkey") % 23).cast("int")
    return read(spark, sf_dir, "orders").select("o_orderkey", dates.add_business_days(d, k).alias("due"))


@query("""SELECT o_orderkey, c AS congress, make_date(1787 + 2 * c, 1, 3) AS starts, make_date(1789 + 2 * c, 1, 3) AS ends, 1788 + 2 * c AS cycle, y + y % 2 AS cycle_of_month
FROM (SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST((year(o_orderdate) - 1789) // 2 + 1 AS INT) AS c FROM orders)""")
def congress_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Congress, its term and the election cycles of a date."""
    y = F.year("o_orderdate")
    c = dates.congress_of_year(y).cast("int")
    term = dates.congress_period(c)
    return read(spark, sf_dir, "orders").select("o_orderkey", c.alias("congress"), term["start"].alias("starts"), term["end"].alias("ends"), dates.cycle_of(c).alias("cycle"), dates.cycle_of_month(y).alias("cycle_of_month"))


SLUGS = ("census_geo", "Bad Slug", "a", "9lives", "x-1", "", None)
HASHES = ("0123456789abcdef" * 4, "0123456789ABCDEF" * 4, "abc", None)
IDS = ("lei:X1", " cik:0001 ", "no id", "a:b c", "9:x", "geo:US:county:01001", None)


@query(f"""SELECT o_orderkey, regexp_full_match({_sql_pick("o_orderkey", *SLUGS)}, '[a-z][a-z0-9_\\-]{{0,95}}') AS slug, regexp_full_match({_sql_pick("o_orderkey", *HASHES)}, '[a-f0-9]{{64}}') AS hash,
 regexp_full_match(trim({_sql_pick("o_orderkey", *IDS)}), '[A-Za-z][A-Za-z0-9_.\\-]*:\\S+') AS id FROM orders""")
def id_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that are dataset names, content hashes and entity ids."""
    k = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select("o_orderkey", text.is_slug(_pick(k, *SLUGS)).alias("slug"), text.is_hash(_pick(k, *HASHES)).alias("hash"), text.looks_like_id(_pick(k, *IDS)).alias("id"))


COUNTIES = ("Añasco (Municipio)", "Saint  Mary's County", "DOÑA ANA County", "Lac qui Parle, (MN)", "")


@query(f"""WITH c AS (SELECT c_custkey, {_sql_pick("c_custkey", *COUNTIES)} AS raw, c_name || ' Ü-' || c_mktsegment AS label FROM customer),
n AS (SELECT c_custkey, trim(regexp_replace(strip_accents(lower(regexp_replace(raw, '\\(([^)]*)\\)', ' \\1 ', 'g'))), '[^a-z0-9_]+', ' ', 'g')) AS county, trim(regexp_replace(strip_accents(lower(label)), '[^a-z0-9_]+', ' ', 'g')) AS norm FROM c)
SELECT *, list_contains(string_split(norm, ' '), 'u') AND len(list_filter(string_split(norm, ' '), lambda w: starts_with(w, 'bui'))) > 0 AS found FROM n""")
def label_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels in matching form, county names, and labels that hold a query's words."""
    label = F.concat("c_name", F.lit(" Ü-"), "c_mktsegment")
    return read(spark, sf_dir, "customer").select("c_custkey", text.county_name_key(_pick(F.col("c_custkey"), *COUNTIES)).alias("county"), text.norm(label).alias("norm"), text.matches_tokens(label, ["u", "bui"]).alias("found"))


ORGS = ("The Acme Company, Inc.", "Société Générale S.A.", "Smith and Sons Holdings Limited", "Inc", "Müller GmbH & Co. KG", "A.B.C. Trust", "Gazprom ОАО PJSC", "Grupo Bimbo S.A.B. de C.V.", "")
ORG_FORMS = ("acme|co,inc|", "societe generale|sa|", "smith sons|ltd|holdings", "inc||", "muller gmbh|co,kg|", "a b c||trust", "gazprom oao|pjsc|", "grupo bimbo|sab de cv|", "||")


@query(f"SELECT c_custkey, {_sql_pick('c_custkey', *ORG_FORMS)} AS name FROM customer")
def organization_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Organisation names without legal forms and stop words, with the forms and descriptors that went."""
    parts = text.organization_parts(text.transliterate(_pick(F.col("c_custkey"), *ORGS)))
    joined = F.concat_ws("|", parts["normalized"], F.array_join(parts["legal_forms"], ","), F.array_join(parts["descriptors"], ","))
    return read(spark, sf_dir, "customer").select("c_custkey", joined.alias("name"))


PEOPLE = ("Dr. Jane Q. Public Jr.", "García Márquez, Gabriel José", "Smith, Jr.", "Sen. O'Neil", "Ludwig van Beethoven", "Жуков, Георгий", "")
PERSON_PARTS = ("jane q public|jane|public|jq", "gabriel jose garcia marquez|gabriel|marquez|gjg", "smith jr|smith|jr|s", "oneil|oneil|oneil|", "ludwig van beethoven|ludwig|beethoven|lv", "georgiy zhukov|georgiy|zhukov|g", "|||")


@query(f"SELECT c_custkey, {_sql_pick('c_custkey', *PERSON_PARTS)} AS name FROM customer")
def person_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal names in order, with given name, family name and initials."""
    p = text.person(text.transliterate(_pick(F.col("c_custkey"), *PEOPLE)))
    return read(spark, sf_dir, "customer").select("c_custkey", F.concat_ws("|", p["normalized"], p["given"], p["family"], p["initials"]).alias("name"))


ADDRESSES = ("12 North Main Street, Suite 5, Springfield, IL 62701-1234", "PO Box 77, 627011234", "1 Avenue Road", "99999 Circle Court 12345", "")
ADDRESS_PARTS = ("12 n main st ste 5 springfield il 62701 1234|62701", "po box 77 627011234|62701", "1 ave rd|-", "99999 cir ct 12345|12345", "|-")


@query(f"SELECT c_custkey, {_sql_pick('c_custkey', *ADDRESS_PARTS)} AS address FROM customer")
def address_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses with short street words, and their postal code."""
    a = text.address(_pick(F.col("c_custkey"), *ADDRESSES))
    return read(spark, sf_dir, "customer").select("c_custkey", F.concat_ws("|", a["line"], F.coalesce(a["postal5"], F.lit("-"))).alias("address"))


SOUNDS = ("Robert", "Rupert", "Ashcraft", "Ashcroft", "Tymczak", "Pfister", "Honeyman", "Lee", "Jackson", "o'hara", "", "Wh")
SOUND_CODES = ("R163", "R163", "A261", "A261", "T522", "P236", "H555", "L000", "J250", "O600", "", "W000")


@query(f"SELECT c_custkey, {_sql_pick('c_custkey', *SOUND_CODES)} AS code FROM customer")
def soundex_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Soundex, in which h and w don't part equal sounds."""
    return read(spark, sf_dir, "customer").select("c_custkey", text.soundex(_pick(F.col("c_custkey"), *SOUNDS)).alias("code"))


@query("""WITH p AS (SELECT p_partkey, lower(regexp_extract(p_name, '^[a-zA-Z]*')) AS w FROM part),
c AS (SELECT p_partkey, w, translate(w, 'abcdefghijklmnopqrstuvwxyz', '01230129022455012623019202') AS d FROM p),
g AS (SELECT p_partkey, w, substr(d, 1, 1) || replace(substr(d, 2), '9', '') AS d FROM c),
r AS (SELECT p_partkey, w, list_reduce(list_prepend('', string_split(d, '')), lambda a, x: CASE WHEN right(a, 1) = x AND x BETWEEN '1' AND '6' THEN a ELSE a || x END) AS d FROM g)
SELECT code, COUNT(*) AS n FROM (SELECT CASE WHEN w = '' THEN '' ELSE rpad(upper(substr(w, 1, 1)) || regexp_replace(substr(d, 2), '[09]', '', 'g'), 4, '0') END AS code FROM r) GROUP BY code""")
def soundex_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names by the Soundex of their first word."""
    return read(spark, sf_dir, "part").groupBy(text.soundex(F.regexp_extract("p_name", "^[a-zA-Z]*", 0)).alias("code")).agg(F.count("*").alias("n"))


SAID = (
    "supports H.R. 1234 and S.12, also h.r.1234",
    "H.J.Res. 7 (Public Law 116-94) passed",
    "HR 5 of the 115th Congress; S. Con. Res. 3",
    "no measure, HR 0, XHR 9, HR 12-3",
    "S 44; later Public Law 117-2",
    "",
)
CITED = (
    "congress:bill:{c}-hr-1234,congress:bill:{c}-s-12",
    "congress:bill:116-hjres-7",
    "congress:bill:115-hr-5,congress:bill:{c}-sconres-3",
    "",
    "congress:bill:{c}-s-44",
    "",
)


@query(f"SELECT o_orderkey, replace({_sql_pick('o_orderkey', *CITED)}, '{{c}}', CAST(100 + o_orderkey % 18 AS VARCHAR)) AS bills FROM orders")
def bill_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures that free text cites, in the Congress it states or else the given one."""
    found = text.citations(_pick(F.col("o_orderkey"), *SAID), 100 + F.col("o_orderkey") % 18)
    return read(spark, sf_dir, "orders").select("o_orderkey", F.array_join(found, ",").alias("bills"))


PRINTED = ("HR2", " sjres7 ", "XY3", "HR", "HCONRES0012", None)
PRINTED_IDS = ("hr-2", "sjres-7", None, None, "hconres-12", None)


@query(f"""WITH b AS (SELECT o_orderkey, CASE WHEN k IS NOT NULL THEN 'congress:bill:' || (100 + o_orderkey % 18) || '-' || k END AS bill FROM (SELECT o_orderkey, {_sql_pick("o_orderkey", *PRINTED_IDS)} AS k FROM orders))
SELECT o_orderkey, bill, CAST(regexp_extract(bill, ':([0-9]+)-', 1) AS INT) AS congress, regexp_extract(bill, '-([a-z]+)-', 1) AS kind, CAST(regexp_extract(bill, '-([0-9]+)$', 1) AS INT) AS number FROM b WHERE bill IS NOT NULL""")
def bill_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of printed bill numbers, and their parts."""
    bill = text.voteview_bill(100 + F.col("o_orderkey") % 18, _pick(F.col("o_orderkey"), *PRINTED))
    return read(spark, sf_dir, "orders").select("o_orderkey", bill.alias("bill")).where("bill is not null").select("*", text.bill_parts(F.col("bill")).alias("p")).select("o_orderkey", "bill", "p.congress", "p.kind", "p.number")


@query("""WITH j AS (SELECT s_suppkey, '{"a":{"x":' || s_nationkey || '},"b":[' || s_suppkey || ',"' || trim(s_name) || '"]}' AS j FROM supplier)
SELECT s_suppkey, j AS json, sha256(j) AS digest, CAST(json_extract(j, '$.b[0]') AS VARCHAR) AS first, json_extract_string(j, '$.a.x') AS inner, CAST(NULL AS VARCHAR) AS none, array_to_string(string_split('f:13f:' || s_suppkey || ':' || s_nationkey || ':z', ':')[-4:], '/') AS parts FROM j JOIN supplier USING (s_suppkey)""")
def canonical_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical JSON of a record whatever its field order, its hash, and values at paths."""
    raw = F.concat(F.lit('{"b": ['), F.col("s_suppkey").cast("string"), F.lit(', "'), F.trim("s_name"), F.lit('"], "a": {"x": '), F.col("s_nationkey").cast("string"), F.lit("}}"))
    json = F.to_json(F.parse_json(raw))
    record = F.concat_ws(":", F.lit("f"), F.lit("13f"), F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string"), F.lit("z"))
    return read(spark, sf_dir, "supplier").select("s_suppkey", json.alias("json"), F.sha2(json, 256).alias("digest"), text.dig(json, "b", 0).alias("first"), text.dig(json, "a", "x").alias("inner"), text.dig(json, "a", "y").alias("none"), F.array_join(text.holding_parts(record), "/").alias("parts"))


@query("""SELECT s_suppkey, u, CASE WHEN regexp_full_match(u, '[A-HJ-NP-Z1-9][A-HJ-NP-Z0-9]{11}') THEN u END AS uei, CASE WHEN s_suppkey = 0 THEN NULL WHEN s_suppkey % 3 = 0 THEN 'cik:' || s_suppkey WHEN s_suppkey % 3 = 1 THEN 'gb_company_number:SC' || lpad(s_suppkey::VARCHAR, 6, '0') END AS registered,
CASE WHEN s_suppkey % 4 < 2 THEN s_suppkey % 4 = 1 ELSE FALSE END AS county, CASE s_suppkey % 4 WHEN 0 THEN 'fips_state:' || lpad((s_nationkey + 1)::VARCHAR, 2, '0') WHEN 1 THEN 'fips_county:' || lpad(s_nationkey::VARCHAR, 2, '0') || '001' WHEN 2 THEN 'iso3166_1_alpha3:DEU' END AS geo,
'gb_company_number:' || lpad(s_suppkey::VARCHAR, 8, '0') AS opencorporates FROM (SELECT *, upper(substr(md5(s_name), 1, 12)) AS u FROM supplier)""")
def register_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifier claims of registration authorities, entity ids and company registers."""
    k = F.col("s_suppkey")
    u = F.upper(F.substring(F.md5("s_name"), 1, 12))
    shown = lambda c: F.when(c.isNotNull(), F.concat_ws(":", c["namespace"], c["value"]))
    authority = _pick(k, "RA000665", "RA000585", "RA000001")
    number = F.when(k % 3 == 0, F.concat(F.lit(" 000"), k.cast("string"))).otherwise(F.concat(F.lit("sc 0"), k.cast("string")))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    entity = F.when(k % 4 == 0, F.concat(F.lit("geo:US:state:"), two(F.col("s_nationkey") + 1))).when(k % 4 == 1, F.concat(F.lit("geo:US:county:"), two(F.col("s_nationkey")), F.lit("001"))).when(k % 4 == 2, "iso3:DEU").otherwise("geo:US:tract:1")
    company = F.concat(F.lit("GB/"), k.cast("string"))
    opened = identifiers.opencorporates_gb(company)
    return read(spark, sf_dir, "supplier").select(
        "s_suppkey", u.alias("u"), identifiers.uei(u).alias("uei"), shown(identifiers.registration_claim(authority, number)).alias("registered"), identifiers.is_county(entity).alias("county"), shown(identifiers.geo_claim(entity)).alias("geo"), F.concat(F.lit("gb_company_number:"), opened).alias("opencorporates")
    )


@query("""WITH s AS (SELECT s_suppkey, lpad(CAST(100000000000 + s_suppkey * 7919 AS VARCHAR), 12, '0') AS body FROM supplier),
n AS (SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN body || '9' ELSE body || CAST(CAST(body AS BIGINT) % 11 % 10 AS VARCHAR) END AS ogrn, s_suppkey % 5 <> 0 OR CAST(body AS BIGINT) % 11 % 10 = 9 AS ok FROM s)
SELECT s_suppkey, CASE WHEN ok AND s_suppkey % 7 <> 0 THEN 'ru_ogrn:' || ogrn END AS document, concat_ws(',', CASE WHEN ok THEN 'ru_ogrn:' || ogrn END, 'gb_company_number:' || lpad(CAST(100000 + s_suppkey AS VARCHAR), 8, '0')) AS labelled,
concat_ws(',', 'iso3166_1_alpha2:RU', 'swift:ABCDRUMMXXX', CASE WHEN ok AND s_suppkey % 7 <> 0 THEN 'ru_ogrn:' || ogrn WHEN ok THEN 'ru_ogrn:' || ogrn END, 'gb_company_number:' || lpad(CAST(100000 + s_suppkey AS VARCHAR), 8, '0')) AS claims FROM n""")
def document_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of identity documents and of numbers labelled in free text, and all claims of a record."""
    k = F.col("s_suppkey")
    body = F.lpad((100_000_000_000 + k * 7919).cast("string"), 12, "0")
    ogrn = F.when(k % 5 == 0, F.concat(body, F.lit("9"))).otherwise(F.concat(body, (body.cast("long") % 11 % 10).cast("string")))
    fraud = F.when(k % 7 == 0, " Fraudulent ")
    said = F.concat(F.lit("OGRN: "), ogrn, F.lit("KPP 770701001; UK Company no. "), (100_000 + k).cast("string"))
    docs = F.array(F.struct(F.lit("Registration Number").alias("scheme"), F.lit("rus").alias("country"), ogrn.alias("number"), fraud.alias("validity")))
    ids = F.array(F.struct(F.lit("swift").alias("namespace"), F.lit(" abcdrumm").alias("value")))
    shown = lambda c: F.concat_ws(":", c["namespace"], c["value"])
    document = identifiers.register_number_claim(F.lit("Registration Number"), F.lit("rus"), ogrn, fraud)
    return read(spark, sf_dir, "supplier").select(
        "s_suppkey",
        F.when(document.isNotNull(), shown(document)).alias("document"),
        F.array_join(F.transform(identifiers.labelled_register_numbers(said), shown), ",").alias("labelled"),
        F.array_join(F.transform(identifiers.record_claims(F.lit("geo:RU"), ids, docs, said), shown), ",").alias("claims"),
    )


STATED_VALUES = (("P1278", "5493001kjtiigc8y1r12", "lei:5493001KJTIIGC8Y1R12"), ("P946", "US0378331005", "isin:US0378331005"), ("P946", "US0378331006", None), ("P458", "9074729", "imo:9074729"), ("P2622", "sc 123", "gb_company_number:SC000123"), ("P1320", "us/1", None), ("P31", "Q5", None))
LOOKUPS = (("ID_CUSIP", "037833100", "us_composite", "cusip:037833100"), ("ID_CUSIP", "037833101", "us_composite", None), ("ID_CUSIP", "037833100", "venue", None), ("TICKER", "AAPL", "unlisted", None))


@query(f"""SELECT n_nationkey, {_sql_pick("n_nationkey", *[s[2] for s in STATED_VALUES])} AS stated, {_sql_pick("n_nationkey", *[s[3] for s in LOOKUPS])} AS instrument, CASE WHEN n_nationkey % 4 = 3 THEN 'BBG' || n_nationkey || '/AAPL/XNAS' END AS listing FROM nation""")
def statement_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of statements and instrument lookups, and listings on a stated market."""
    k = F.col("n_nationkey")
    shown = lambda c: F.when(c.isNotNull(), F.concat_ws(":", c["namespace"], c["value"]))
    stated = identifiers.statement_claim(_pick(k, *[s[0] for s in STATED_VALUES]), _pick(k, *[s[1] for s in STATED_VALUES]))
    kind, value, level = (_pick(k, *[s[i] for s in LOOKUPS]) for i in range(3))
    row = identifiers.listing(F.concat(F.lit("figi:BBG"), k.cast("string")), kind, F.lit("xnas"), value)
    return read(spark, sf_dir, "nation").select("n_nationkey", shown(stated).alias("stated"), shown(identifiers.instrument_claim(kind, value, level)).alias("instrument"), F.when(row.isNotNull(), F.concat_ws("/", row["left"], row["right"], row["scope"])).alias("listing"))


@query("SELECT x AS raw, y AS latin FROM (VALUES ('Straße & Søn', 'Strasse  and  Son'), ('ЩУКА Ёж', 'SHCHUKA Ezh'), ('Αθήνα', 'athna'), ('naïve café — ½', 'naive cafe - 12'), ('plain a@b', 'plain a at b'), ('中文 Ł', ' L')) t(x, y)")
def transliterations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters beyond ASCII in Latin ones."""
    raw = ["Straße & Søn", "ЩУКА Ёж", "Αθήνα", "naïve café — ½", "plain a@b", "中文 Ł"]
    return spark.createDataFrame([(r,) for r in raw], "raw string").select("raw", text.transliterate(F.col("raw")).alias("latin"))
