"""Check digits and normal forms of published identifiers, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _chars(s: Column) -> Column:
    return F.split(s, "")


def _value(c: Column) -> Column:
    """0-9 as themselves, A-Z as 10 to 35."""
    return F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def luhn_sum(digits: Column, first_doubled: int) -> Column:
    """Luhn sum of a digit string; places count from the right, 0 first."""
    step = lambda c, i: _let(F.ascii(c) - 48, lambda d: F.when(i % 2 == first_doubled, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d))
    return _sum(F.transform(_chars(F.reverse(digits)), step))


def expanded(s: Column) -> Column:
    """Letters written as their two-digit values."""
    return F.array_join(F.transform(_chars(s), lambda c: _value(c).cast("string")), "")


def mod97(s: Column) -> Column:
    fold = lambda a, x: F.when(x > 9, a * 100 + x).otherwise(a * 10 + x) % 97
    return F.aggregate(F.transform(_chars(s), _value), F.lit(0), fold)


def isin_check_digit(body: Column) -> Column:
    return F.pmod(10 - luhn_sum(expanded(body), 0) % 10, F.lit(10))


def valid_isin(s: Column) -> Column:
    return F.when(s.rlike("^[A-Z]{2}[A-Z0-9]{9}[0-9]$"), isin_check_digit(F.substring(s, 1, 11)).cast("string") == F.substring(s, 12, 1)).otherwise(False)


def cusip_check_digit(body: Column) -> Column:
    def step(c: Column, i: Column) -> Column:
        v = _value(c) * F.when(i % 2 == 1, 2).otherwise(1)
        return F.floor(v / 10) + v % 10

    return F.pmod(10 - F.aggregate(F.transform(_chars(body), step), F.lit(0).cast("long"), lambda a, x: a + x) % 10, F.lit(10))


def valid_cusip(s: Column) -> Column:
    return F.when(s.rlike("^[A-Z0-9]{8}[0-9]$"), cusip_check_digit(F.substring(s, 1, 8)).cast("string") == F.substring(s, 9, 1)).otherwise(False)


def cusip_from_isin(s: Column) -> Column:
    return F.when(valid_isin(s) & F.substring(s, 1, 2).isin("US", "CA"), F.substring(s, 3, 9))


def valid_lei(s: Column) -> Column:
    return F.when(s.rlike("^[A-Z0-9]{18}[0-9]{2}$"), mod97(s) == 1).otherwise(False)


def valid_imo(s: Column) -> Column:
    weighted = lambda d: _sum(F.transform(_chars(F.substring(d, 1, 6)), lambda c, i: (F.ascii(c) - 48) * (7 - i)))
    return F.when(s.rlike("^[0-9]{7}$"), (weighted(s) % 10).cast("string") == F.substring(s, 7, 1)).otherwise(False)


def _weighted(s: Column, weights: tuple[int, ...]) -> Column:
    w = F.array(*[F.lit(x) for x in weights])
    return _sum(F.zip_with(F.transform(_chars(F.substring(s, 1, len(weights))), lambda c: F.ascii(c) - 48), w, lambda d, x: d * x)) % 11 % 10


def _plain_digits(s: Column) -> Column:
    return F.regexp_replace(s, "[ -]", "")


def valid_ru_inn(s: Column) -> Column:
    """Ten or twelve digits with one or two check digits, blanks and hyphens apart; the weights are fixed values of the scheme."""
    w10, w11, w12 = (2, 4, 10, 3, 5, 9, 4, 6, 8), (7, 2, 4, 10, 3, 5, 9, 4, 6, 8), (3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8)

    def holds(d: Column) -> Column:
        digit = lambda n: F.ascii(F.substring(d, n, 1)) - 48
        return F.when(d.rlike("^[0-9]{10}$"), _weighted(d, w10) == digit(10)).when(d.rlike("^[0-9]{12}$"), (_weighted(d, w11) == digit(11)) & (_weighted(d, w12) == digit(12))).otherwise(False)

    return _let(_plain_digits(s), holds)


def valid_ru_ogrn(s: Column) -> Column:
    """Thirteen digits from 1 or 5, or fifteen from 3, with a check digit, blanks and hyphens apart."""

    def holds(d: Column) -> Column:
        body = lambda n: F.substring(d, 1, n).cast("long")
        last = lambda n: F.substring(d, n, 1).cast("int")
        return F.when(d.rlike("^[15][0-9]{12}$"), body(12) % 11 % 10 == last(13)).when(d.rlike("^3[0-9]{14}$"), body(14) % 13 % 10 == last(15)).otherwise(False)

    return _let(_plain_digits(s), holds)


def ru_inn(s: Column) -> Column:
    return F.when(valid_ru_inn(s), _plain_digits(s))


def ru_ogrn(s: Column) -> Column:
    return F.when(valid_ru_ogrn(s), _plain_digits(s))


def gb_company_number(s: Column) -> Column:
    """Eight characters, digits padded after a two-letter prefix if there is one; NULL otherwise."""
    v = F.upper(F.replace(F.trim(s), F.lit(" "), F.lit("")))

    def padded(x: Column) -> Column:
        prefix, digits = F.regexp_extract(x, "^([A-Z]{2})", 1), F.regexp_extract(x, "^(?:[A-Z]{2})?0*([0-9]{1,8})$", 1)
        return F.when(digits == "", None).when(prefix == "", F.lpad(digits, 8, "0")).when(F.length(digits) <= 6, F.concat(prefix, F.lpad(digits, 6, "0")))

    return _let(v, padded)


def cik10(s: Column) -> Column:
    digits = F.regexp_extract(s, "([0-9]{1,10})$", 1)
    return F.when(digits != "", F.lpad(digits, 10, "0"))


def normal_value(namespace: Column, value: Column) -> Column:
    """Trimmed; upper case for code namespaces; CIK without leading zeros; the last part of a ROR address; a BIC of eight
    characters is the main office, branch XXX."""
    v = F.trim(value)
    bic = F.when(F.length(v) == 8, F.concat(F.upper(v), F.lit("XXX"))).otherwise(F.upper(v))
    return (
        F.when(namespace.isin("lei", "isin", "cusip", "figi", "uei", "iata", "icao", "orcid", "gb_company_number"), F.upper(v))
        .when(namespace == "cik", F.regexp_replace(v, "^0+(?=[0-9])", ""))
        .when(namespace == "ror", F.element_at(F.split(F.lower(v), "/"), -1))
        .when(namespace.isin("swift", "bic"), bic)
        .otherwise(v)
    )


def uei(s: Column) -> Column:
    """A Unique Entity ID in capitals: twelve letters and digits without I and O, not from 0; NULL otherwise."""
    v = F.upper(F.trim(s))
    return F.when(v.rlike("^[A-HJ-NP-Z1-9][A-HJ-NP-Z0-9]{11}$"), v)


def _claim(namespace: str | Column, value: Column) -> Column:
    named = F.lit(namespace) if isinstance(namespace, str) else namespace
    return F.when(value.isNotNull(), F.struct(named.alias("namespace"), value.alias("value")))


def registration_claim(authority: Column, entity_id: Column) -> Column:
    """Claim of a registration authority's entity id: EDGAR numbers that are decimal, and Companies House numbers."""
    raw = F.upper(F.replace(F.trim(entity_id), F.lit(" "), F.lit("")))
    cik = F.nullif(F.regexp_extract(raw, "^0*([1-9][0-9]{0,9})$", 1), F.lit(""))
    return F.when(authority == "RA000665", _claim("cik", cik)).when(authority == "RA000585", _claim("gb_company_number", gb_company_number(raw)))


def flagged_fraudulent(validity: Column) -> Column:
    return F.coalesce(F.lower(F.trim(validity)) == "fraudulent", F.lit(False))


def register_number_claim(scheme: Column, country: Column, number: Column, validity: Column) -> Column:
    """Claim of an identity document whose scheme and country name one register; a fraudulent one makes none."""
    kind = F.concat_ws("|", F.lower(F.trim(scheme)), F.upper(F.trim(country)))
    found = (
        F.when(kind == "tax id no.|RUS", _claim("ru_inn", ru_inn(number)))
        .when(kind.isin("registration number|RUS", "business registration number|RUS"), _claim("ru_ogrn", ru_ogrn(number)))
        .when(kind == "company number|GBR", _claim("gb_company_number", gb_company_number(number)))
    )
    return F.when(~flagged_fraudulent(validity), found)


def labelled_register_numbers(text: Column) -> Column:
    """Array of claims of numbers that a label in free text names by register, check digits held."""
    before = "(?<![A-Za-z\u0400-\u04FF])"
    kinds = [
        ("ru_ogrn", before + "(?:OGRN|\u041E\u0413\u0420\u041D)\\s*[:#\u2116.\\-\u2013]?\\s*([0-9]{15}|[0-9]{13})(?![0-9])", ru_ogrn),
        ("ru_inn", before + "(?:INN|\u0418\u041D\u041D)\\s*[:#\u2116.\\-\u2013]?\\s*([0-9]{12}|[0-9]{10})(?![0-9])", ru_inn),
        ("gb_company_number", "(?i)UK Company (?:no\\.?|number)\\s*[:\\-\u2013]?\\s*([A-Z]{2}[0-9]{6}|[0-9]{6,8})(?![0-9A-Z])", gb_company_number),
    ]

    def found(name: str, pattern: str, form) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda v: _claim(name, form(v)))

    return F.array_distinct(F.filter(F.concat(*[found(*k) for k in kinds]), lambda c: c.isNotNull()))


def geo_claim(entity: Column) -> Column:
    """Claim that a geographic entity id is."""
    shapes = (("fips_county", "^geo:US:county:([0-9]{5})$"), ("fips_state", "^geo:US:state:([0-9]{2})$"), ("iso3166_1_alpha3", "^iso3:([A-Z]{3})$"), ("iso3166_1_alpha2", "^geo:([A-Z]{2})$"), ("iso3166_2", "^iso3166-2:([A-Z]{2}-[A-Z0-9]{1,3})$"))
    return F.coalesce(*[_claim(name, F.nullif(F.regexp_extract(entity, shape, 1), F.lit(""))) for name, shape in shapes])


def opencorporates_gb(s: Column) -> Column:
    """The Companies House number within a gb/... company id."""
    return F.when(F.lower(F.substring_index(F.trim(s), "/", 1)) == "gb", gb_company_number(F.nullif(F.regexp_extract(F.trim(s), "^[^/]*/(.+)$", 1), F.lit(""))))


#: Statement properties and the identifiers they carry.
PROPERTIES = {"P1278": ("lei", "valid_lei"), "P946": ("isin", "valid_isin"), "P458": ("imo", "valid_imo"), "P2622": ("gb_company_number", "gb_company_number"), "P1320": ("gb_company_number", "opencorporates_gb")}


def statement_claim(prop: Column, value: Column) -> Column:
    """Claim of a statement about an identifier, if its form and check digits hold."""
    out = None
    for p, (namespace, rule) in PROPERTIES.items():
        check = globals()[rule]
        held = F.when(check(F.upper(F.trim(value))), F.upper(F.trim(value))) if rule.startswith("valid") else check(value)
        out = F.when(prop == p, _claim(namespace, held)) if out is None else out.when(prop == p, _claim(namespace, held))
    return out


def cusip(s: Column) -> Column:
    """A CUSIP in capitals if its check digit holds."""
    v = F.upper(F.trim(s))
    return F.when(valid_cusip(v), v)


def instrument_claim(id_type: Column, id_value: Column, level: Column, levels: tuple[str, ...] = ("us_composite", "unlisted")) -> Column:
    """Claim of an instrument lookup's answer to a CUSIP at a level that names one instrument."""
    return F.when((id_type == "ID_CUSIP") & level.isin(*levels), _claim("cusip", cusip(id_value)))


def listing(subject: Column, id_type: Column, mic: Column, ticker: Column) -> Column:
    """``struct(left, right, scope)``: an instrument's ticker on the market that the lookup was asked about."""
    scope, name = F.upper(F.trim(mic)), F.upper(F.trim(ticker))
    usable = subject.startswith("figi:") & (id_type == "TICKER") & scope.rlike("^[A-Z0-9]{4}$") & (name != "")
    return F.when(usable, F.struct(F.substr(subject, F.lit(6)).alias("left"), name.alias("right"), scope.alias("scope")))


def is_county(entity: Column) -> Column:
    """A county id whose five digits aren't a state total (000) or an unknown county (999)."""
    return F.coalesce(entity.rlike("^geo:US:county:[0-9]{2}(?!000$|999$)[0-9]{3}$"), F.lit(False))


def record_claims(entity: Column, identifiers: Column, documents: Column, text: Column) -> Column:
    """All claims of one record: of its id, its typed ``identifiers`` (array of namespace and value), its identity
    ``documents`` (array of scheme, country, number, validity) and of labels in free text. Check digits must hold."""

    def typed(c: Column) -> Column:
        value = normal_value(c["namespace"], c["value"])
        ok = F.when(c["namespace"] == "ru_inn", valid_ru_inn(value)).when(c["namespace"] == "ru_ogrn", valid_ru_ogrn(value)).when(c["namespace"] == "lei", valid_lei(value)).otherwise(value.isNotNull())
        return F.when(ok, F.struct(c["namespace"].alias("namespace"), value.alias("value")))

    none = F.array().cast("array<struct<namespace:string,value:string>>")
    parts = [
        F.array(geo_claim(entity)),
        F.coalesce(F.transform(identifiers, typed), none),
        F.coalesce(F.transform(documents, lambda d: register_number_claim(d["scheme"], d["country"], d["number"], d["validity"])), none),
        F.coalesce(labelled_register_numbers(text), none),
    ]
    return F.array_distinct(F.filter(F.concat(*parts), lambda c: c.isNotNull()))


def naics_parent(code: Column, level: int) -> Column:
    """The code's prefix; at two digits the ranges 31-33, 44-45 and 48-49 are single sectors."""
    two = F.substring(code, 1, 2)
    if level == 2:
        return F.when(two.isin("31", "32", "33"), "31-33").when(two.isin("44", "45"), "44-45").when(two.isin("48", "49"), "48-49").otherwise(two)
    return F.substring(code, 1, level)
