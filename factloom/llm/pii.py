"""Format-preserving pseudonyms for personal data, in DataFrame operations only.

Values are found by pattern, validated, and permuted within their own format by a keyed Feistel
network: under one key a value maps to one pseudonym everywhere, so records stay linked, and no two
values of a format share a pseudonym. A round adds, position by position and within the position's
alphabet (0-9, a-z, A-Z), a keyed hash of the other half. Then what makes the value valid is restored:

    card     Luhn-valid, 13 to 19 digits     digits but the last permuted, check digit recomputed
    iban     valid modulo 97                 account part permuted, check digits recomputed
    ssn      valid area, group, serial       permuted within the valid ranges
    phone    10 to 15 digits                 digits after the country code permuted
    ip       four numbers up to 255          permuted as four numbers of 0 to 255
    date     a calendar date, 1800 to 2199   permuted among the 146,097 days of those 400 years
    email    local part and host             letters and digits of the local part permuted
    secret   access keys, password=, token=  letters and digits permuted, lower-case hexadecimal within itself

Separators stay where they are and don't enter the hash, so one card with and without spaces has one
pseudonym. A span of groups that isn't valid as a card or IBAN is cut before and after its longest run of whole
groups that is, and the text around that run is searched again. A secret runs to the next quote or white space;
without an opening quote it has 8 characters at least. Values that fail validation stay as they are.

Defined cases: null text stays null with no values; empty text stays empty; a null id is kept; repeated rows give
equal rows; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

ROUNDS = 8
SPANS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}",
    "secret": r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])|(?:password|token|secret|api_key) ?[=:] ?(?:\"[^\s\"']+|[^\s\"']{8,})",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])",
    "date": r"(?<![0-9/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![0-9/-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9])|(?<![0-9A-Za-z+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){3,5}(?![0-9])",
    "card": r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])",
}
PATTERN = "|".join(f"(?:{p})" for p in SPANS.values())


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _only(s: Column, keep: str) -> Column:
    return F.regexp_replace(s, f"[^{keep}]", "")


def _digit_sum(chars: Column, step) -> Column:
    """Sum of ``step(digit, place)`` over a string of digits, place counted from the right, 0 first."""
    return F.aggregate(F.transform(F.split(F.reverse(chars), ""), lambda c, i: step(F.ascii(c) - 48, i)), F.lit(0), lambda a, x: a + x)


def _luhn(digits: Column, first_doubled: int) -> Column:
    doubled = lambda d, i: F.when(i % 2 == first_doubled, F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)).otherwise(d)
    return _digit_sum(digits, doubled) % 10


def _mod97(text: Column) -> Column:
    """A string of digits and capitals, letters as 10 to 35, modulo 97."""
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.transform(F.split(text, ""), value), F.lit(0), lambda a, x: F.when(x > 9, a * 100 + x).otherwise(a * 10 + x) % 97)


HEX = "0123456789abcdef"


def _added(part: Column, other: Column, key: str, tag: str, r: Column) -> Column:
    """``part`` with each letter or digit moved within its alphabet by the keyed hash of ``other``."""

    def moved(h: Column) -> Column:
        def one(i: Column) -> Column:
            c = F.substr(part, i, F.lit(1))
            k = F.conv(F.substr(h, F.pmod(i - 1, F.lit(32)) * 4 + 1, F.lit(4)), 16, 10).cast("int")
            turn = lambda base, size: F.chr(F.lit(base) + F.pmod(F.ascii(c) - base + k, F.lit(size)))
            if tag == "hex":
                return F.substr(F.lit(HEX), F.pmod(F.instr(F.lit(HEX), c) - 1 + k, F.lit(16)) + 1, F.lit(1))
            return F.when(c.between("0", "9"), turn(48, 10)).when(c.between("a", "z"), turn(97, 26)).when(c.between("A", "Z"), turn(65, 26)).otherwise(c)

        return F.array_join(F.transform(F.sequence(F.lit(1), F.length(part)), one), "")

    return F.when(F.length(part) == 0, part).otherwise(_let(F.sha2(F.concat(F.lit(f"{key}|{tag}|"), r.cast("string"), F.lit("|"), other), 512), moved))


def permuted(s: Column, key: str, tag: str) -> Column:
    """A keyed permutation of the strings with this length and these alphabets by position."""
    half = F.floor(F.length(s) / 2).cast("int")
    start = F.struct(F.substr(s, F.lit(1), half).alias("l"), F.substr(s, half + 1).alias("r"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, lambda a, r: F.struct(a["r"].alias("l"), _added(a["l"], a["r"], key, tag, r).alias("r")), lambda a: F.concat(a["l"], a["r"]))


def permuted_pair(x: Column, y: Column, nx: int, ny: int, key: str, tag: str) -> Column:
    """``struct(x, y)``: a keyed permutation of the pairs with 0 <= x < nx and 0 <= y < ny."""
    draw = lambda r, v: F.conv(F.substring(F.sha2(F.concat(F.lit(f"{key}|{tag}|"), r.cast("string"), F.lit("|"), v.cast("string")), 256), 1, 12), 16, 10).cast("long")
    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"))
    step = lambda a, r: F.struct(F.when(r % 2 == 1, F.pmod(a["x"] + draw(r, a["y"]), F.lit(nx))).otherwise(a["x"]).alias("x"), F.when(r % 2 == 0, F.pmod(a["y"] + draw(r, a["x"]), F.lit(ny))).otherwise(a["y"]).alias("y"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)


def _refilled(shape: Column, values: Column, keep: str) -> Column:
    """``shape`` with its characters of class ``keep`` replaced by those of ``values`` in order."""
    place = lambda i: F.length(_only(F.substr(shape, F.lit(1), i), keep))
    one = lambda c, i: F.when(c.rlike(f"[{keep}]"), F.substr(values, place(i + 1), F.lit(1))).otherwise(c)
    return F.array_join(F.transform(F.split(shape, ""), one), "")


def _card(m: Column, key: str) -> Column:
    def body(d: Column) -> Column:
        size = F.length(d)
        new = lambda p: F.concat(p, F.pmod(10 - _luhn(p, 0), F.lit(10)).cast("string"))
        return F.when(size.between(13, 19) & (_luhn(d, 1) == 0), _let(_let(permuted(F.substr(d, F.lit(1), size - 1), key, "card"), new), lambda n: _refilled(m, n, "0-9")))

    return _let(_only(m, "0-9"), body)


def _iban(m: Column, key: str) -> Column:
    def body(s: Column) -> Column:
        head, account = F.substr(s, F.lit(1), F.lit(2)), F.substr(s, F.lit(5))
        valid = F.length(s).between(15, 34) & (_mod97(F.concat(account, F.substr(s, F.lit(1), F.lit(4)))) == 1)
        new = lambda p: F.concat(head, F.lpad((98 - _mod97(F.concat(p, head, F.lit("00")))).cast("string"), 2, "0"), p)
        return F.when(valid, _let(_let(permuted(account, key, "iban"), new), lambda n: _refilled(m, n, "A-Z0-9")))

    return _let(_only(m, "A-Z0-9"), body)


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.substr(m, F.lit(a), F.lit(b)).cast("int") for a, b in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    place = F.when(area > 666, area - 2).otherwise(area - 1)
    back = lambda p: F.concat_ws("-", F.lpad(F.when(p["x"] >= 665, p["x"] + 2).otherwise(p["x"] + 1).cast("string"), 3, "0"), F.lpad((F.floor(p["y"] / 9999) + 1).cast("string"), 2, "0"), F.lpad((p["y"] % 9999 + 1).cast("string"), 4, "0"))
    return F.when(valid, _let(permuted_pair(place, (group - 1) * 9999 + serial - 1, 898, 99 * 9999, key, "ssn"), back))


def _ip(m: Column, key: str) -> Column:
    def body(o: Column) -> Column:
        n = [F.element_at(o, i).cast("int") for i in (1, 2, 3, 4)]
        valid = F.forall(o, lambda x: x.cast("int") <= 255)
        back = lambda p: F.concat_ws(".", *[x.cast("string") for x in (F.floor(p["x"] / 256), p["x"] % 256, F.floor(p["y"] / 256), p["y"] % 256)])
        return F.when(valid, _let(permuted_pair(n[0] * 256 + n[1], n[2] * 256 + n[3], 65536, 65536, key, "ip"), back))

    return _let(F.split(m, r"\."), body)


def _date(m: Column, key: str) -> Column:
    zero = F.lit("1800-01-01").cast("date")
    iso = m.rlike("^[0-9]{4}-")

    def body(f: Column) -> Column:
        y, mo, d = F.when(iso, F.get(f, 0)).otherwise(F.get(f, 2)), F.get(f, 1), F.when(iso, F.get(f, 2)).otherwise(F.get(f, 0))
        day_first = F.try_to_date(F.concat_ws("-", y, F.lpad(mo, 2, "0"), F.lpad(d, 2, "0")))
        month_first = F.when(~iso & m.contains("/"), F.try_to_date(F.concat_ws("-", y, F.lpad(d, 2, "0"), F.lpad(mo, 2, "0"))))

        def out(day: Column, mdy: bool) -> Column:
            n = F.date_diff(day, zero)

            def back(p: Column) -> Column:
                def text(t: Column) -> Column:
                    parts = [F.date_format(t, x) for x in ("yyyy", "MM", "dd")]
                    a, b = (parts[1], parts[2]) if mdy else (parts[2], parts[1])
                    sep = F.when(m.contains("/"), "/").otherwise(".")
                    return F.when(iso, F.concat_ws("-", *parts)).otherwise(F.concat(a, sep, b, sep, parts[0]))

                return _let(F.date_add(zero, (p["x"] * 5411 + p["y"]).cast("int")), text)

            return F.when(n.between(0, 146_096), _let(permuted_pair(F.floor(n / 5411), n % 5411, 27, 5411, key, "date"), back))

        return F.coalesce(out(day_first, False), out(month_first, True))

    return _let(F.split(m, "[-/.]"), body)


def _phone(m: Column, key: str) -> Column:
    head = F.regexp_extract(m, r"^\+1(?=[0-9]{10}$)|^\+[0-9]{1,3}(?=[^0-9]|$)", 0)

    def body(s: Column) -> Column:
        d = _only(s, "0-9")
        count = F.length(d) + F.length(_only(head, "0-9"))
        return F.when(count.between(10, 15), F.concat(head, _let(permuted(d, key, "phone"), lambda n: _refilled(s, n, "0-9"))))

    return _let(F.substr(m, F.length(head) + 1), body)


def _email(m: Column, key: str) -> Column:
    at = F.instr(m, "@")
    local = F.lower(F.substr(m, F.lit(1), at - 1))
    return F.concat(permuted(local, key, "email"), F.substr(m, at))


def _secret(m: Column, key: str) -> Column:
    head = F.regexp_extract(m, r"^(?:AKIA|[a-z_]+ ?[=:] ?\"?)", 0)
    tail = F.substr(m, F.length(head) + 1)
    return F.concat(head, F.when(tail.rlike("^[0-9a-f]+$"), permuted(tail, key, "hex")).otherwise(permuted(tail, key, "secret")))


MAKERS = {"email": _email, "secret": _secret, "iban": _iban, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}


def pseudonym(m: Column, key: str) -> Column:
    """``struct(kind, value)`` of a found span; kind is null and value the span if it isn't valid."""

    def tagged(kind: str):
        return lambda v: F.when(v.isNotNull(), F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    found = F.coalesce(*[F.when(m.rlike(f"^(?:{SPANS[k]})$"), _let(f(m, key), tagged(k))) for k, f in MAKERS.items()])
    return F.coalesce(found, F.struct(F.lit(None).cast("string").alias("kind"), m.alias("value")))


def _run_within(m: Column) -> Column:
    """``struct(size, start)``, start from 0, of the longest run of whole groups within a span that is a card or IBAN."""
    groups = F.split(m, "[ -]")
    start = lambda i: F.aggregate(F.slice(groups, F.lit(1), i), F.lit(0), lambda a, g: a + F.length(g) + 1)
    runs = F.flatten(F.transform(F.sequence(F.lit(0), F.size(groups) - 1), lambda i: F.transform(F.sequence(i, F.size(groups) - 1), lambda j: F.struct((start(j + 1) - 1 - start(i)).alias("size"), start(i).alias("start")))))

    def valid(run: Column) -> Column:
        def card(d: Column) -> Column:
            return F.length(d).between(13, 19) & (_luhn(d, 1) == 0)

        def iban(v: Column) -> Column:
            return F.length(v).between(15, 34) & (_mod97(F.concat(F.substr(v, F.lit(5)), F.substr(v, F.lit(1), F.lit(4)))) == 1)

        text = F.substr(m, run["start"] + 1, run["size"])
        return F.when(text.rlike(f"^(?:{SPANS['card']})$"), _let(_only(text, "0-9"), card)).when(text.rlike(f"^(?:{SPANS['iban']})$"), _let(_only(text, "A-Z0-9"), iban)).otherwise(False)

    best = lambda found: F.array_max(F.transform(found, lambda r: F.struct(r["size"].alias("size"), (-r["start"]).alias("back"))))
    return _let(best(F.filter(runs, valid)), lambda b: F.when(b.isNotNull(), F.struct(b["size"].alias("size"), (-b["back"]).alias("start"))))


def _pieces(text: Column) -> Column:
    """The text cut around card numbers and IBANs that lie within longer spans."""

    def cut(m: Column) -> Column:
        part = lambda r: F.when(r.isNotNull() & (r["size"] < F.length(m)), F.array(F.substr(m, F.lit(1), r["start"]), F.substr(m, r["start"] + 1, r["size"]), F.substr(m, r["start"] + r["size"] + 1)))
        grouped = m.rlike(f"^(?:{SPANS['card']}|{SPANS['iban']})$") & m.rlike("[ -]")
        return F.coalesce(F.when(grouped, _let(_run_within(m), part)), F.array(m))

    gaps, spans = F.split(text, PATTERN, -1), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    parts = F.zip_with(gaps, F.transform(spans, cut), lambda gap, c: F.struct(gap.alias("gap"), F.coalesce(c, F.array(F.lit(""))).alias("c")))
    join = lambda a, x: F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.concat(F.element_at(a, -1), x["gap"], F.element_at(x["c"], 1))), F.slice(x["c"], F.lit(2), F.size(x["c"])))
    return F.aggregate(parts, F.array(F.lit("")), join)


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, text, n_values, kinds)``: the text with pseudonyms, how many were put in, and their sorted kinds."""
    first = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    grouped = F.col("text").rlike(f"(?:{SPANS['card']})|(?:{SPANS['iban']})")
    first = first.withColumn("_pieces", F.when(grouped, _pieces(F.col("text"))).otherwise(F.array("text")))

    def renewed(piece: Column) -> Column:
        new = lambda values: F.struct(values.alias("new"), F.array_join(F.flatten(F.zip_with(F.split(piece, PATTERN, -1), values["value"], lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "").alias("text"))
        return _let(F.transform(F.regexp_extract_all(piece, F.lit(PATTERN), F.lit(0)), lambda m: pseudonym(m, key)), new)

    first = first.withColumn("_done", F.when(F.col("text").rlike("[0-9@]|password|token|secret|api_key"), F.transform("_pieces", renewed)))
    joined = F.array_join(F.col("_done.text"), "")
    kinds = F.filter(F.flatten(F.col("_done.new"))["kind"], lambda k: k.isNotNull())
    hit = F.col("_done").isNotNull()
    count = F.coalesce(F.size(kinds), F.lit(0))
    return first.select("id", F.when(hit, joined).otherwise(F.col("text")).alias("text"), F.when(hit, count).otherwise(0).cast("long").alias("n_values"), F.when(hit, F.array_join(F.array_sort(F.array_distinct(kinds)), ",")).otherwise("").alias("kinds"))
