"""Names, tokens and string similarity."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

#: Letters that Unicode decomposition leaves, and their Latin forms.
SPECIAL = {"ß": "ss", "æ": "ae", "Æ": "AE", "ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "þ": "th", "Þ": "TH", "œ": "oe", "Œ": "OE", "ı": "i", "ð": "d", "Ð": "D", "&": " and ", "@": " at ", "’": "'", "‘": "'", "–": "-", "—": "-"}
#: Romanisation of Cyrillic and Greek.
CYRILLIC = "а a б b в v г g д d е e ё e ж zh з z и i й y к k л l м m н n о o п p р r с s т t у u ф f х kh ц ts ч ch ш sh щ shch ъ - ы y ь - э e ю yu я ya і i ї yi є ye ґ g"
GREEK = "α a β v γ g δ d ε e ζ z η i θ th ι i κ k λ l μ m ν n ξ x ο o π p ρ r σ s ς s τ t υ y φ f χ ch ψ ps ω o"
#: Legal forms at the end of organisation names with their variants.
LEGAL = {
    "inc": ["inc", "incorporated"], "corp": ["corp", "corporation"], "co": ["co", "company", "cie", "compagnie"],
    "llc": ["llc", "l l c"], "ltd": ["ltd", "limited"], "plc": ["plc", "public limited company"], "lp": ["lp", "l p"],
    "llp": ["llp", "l l p"], "lllp": ["lllp"], "pllc": ["pllc"], "pc": ["pc", "professional corporation"],
    "gmbh": ["gmbh", "gesellschaft mit beschrankter haftung"], "ag": ["ag", "aktiengesellschaft"], "kg": ["kg"],
    "kgaa": ["kgaa"], "se": ["se", "societas europaea"], "sa": ["sa", "s a", "sociedad anonima", "societe anonyme"],
    "nv": ["nv", "n v", "naamloze vennootschap"], "bv": ["bv", "b v", "besloten vennootschap"],
    "spa": ["spa", "s p a", "societa per azioni"], "srl": ["srl", "s r l"], "sarl": ["sarl", "s a r l"], "sas": ["sas"],
    "ab": ["ab", "aktiebolag"], "as": ["as", "a s", "asa"], "oy": ["oy", "oyj"], "kk": ["kk", "kabushiki kaisha"],
    "pte": ["pte"], "pty": ["pty", "proprietary"], "bhd": ["bhd", "berhad", "sdn bhd"], "ulc": ["ulc"],
    "sl": ["sl", "s l"], "sab de cv": ["sab de cv", "s a b de c v"], "sa de cv": ["sa de cv", "s a de c v"],
    "ooo": ["ooo"], "pjsc": ["pjsc"], "ojsc": ["ojsc"], "jsc": ["jsc"], "tbk": ["tbk"],
    "holdings": ["holdings", "holding"], "group": ["group"], "trust": ["trust"],
}
DESCRIPTORS = ("holdings", "group", "trust")
STOP_WORDS = ("the", "of", "and")
#: Honorifics and suffixes of personal names.
HONORIFICS = ("mr", "mrs", "ms", "miss", "dr", "prof", "hon", "sen", "rep", "gov", "sir", "dame", "rev", "judge")
SUFFIXES = ("jr", "sr", "ii", "iii", "iv", "v", "md", "phd", "esq")
#: Address words and their short forms.
STREET = {
    "street": "st", "avenue": "ave", "boulevard": "blvd", "road": "rd", "drive": "dr", "lane": "ln", "court": "ct",
    "place": "pl", "square": "sq", "suite": "ste", "floor": "fl", "building": "bldg", "highway": "hwy", "parkway": "pkwy",
    "north": "n", "south": "s", "east": "e", "west": "w", "northeast": "ne", "northwest": "nw", "southeast": "se",
    "southwest": "sw", "apartment": "apt", "room": "rm", "terrace": "ter", "circle": "cir", "center": "ctr", "centre": "ctr",
}
#: Digits of Soundex.
SOUND = {"1": "bfpv", "2": "cgjkqsxz", "3": "dt", "4": "l", "5": "mn", "6": "r"}


def _pairs(listed: str) -> dict[str, str]:
    words = listed.split()
    return {a: "" if b == "-" else b for a, b in zip(words[::2], words[1::2])}


def _latin() -> dict[int, str]:
    cyrillic, greek = _pairs(CYRILLIC), _pairs(GREEK)
    upper = {k.upper(): v.upper() for k, v in cyrillic.items()} | {k.upper(): v for k, v in greek.items()}
    return str.maketrans(upper | cyrillic | greek | SPECIAL)


@F.pandas_udf(T.StringType())
def _folded(text: pd.Series) -> pd.Series:
    import unicodedata

    table = _latin()
    fold = lambda t: unicodedata.normalize("NFKD", t.translate(table)).encode("ascii", "ignore").decode("ascii")
    return text.map(lambda t: None if t is None else t if t.isascii() and "&" not in t and "@" not in t else fold(t))


def transliterate(text: Column) -> Column:
    """Text in ASCII: special letters, Cyrillic and Greek written in Latin, accents removed, the rest dropped."""
    return _folded(text)


def tokens(text: Column) -> Column:
    """Lower-case words of letters and digits; apostrophes vanish, initials joined by dots come apart. ASCII is expected."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), r"(?<=\b[a-z])\.(?=[a-z]\b)", " "), "['`]", "")
    return F.filter(F.split(F.regexp_replace(plain, "[^a-z0-9]+", " "), " "), lambda t: t != "")


def _forms() -> list[str]:
    return sorted((v for variants in LEGAL.values() for v in variants), key=lambda v: (-len(v.split()), v))


def organization(name: Column) -> Column:
    """A name's words without stop words and without legal forms at its end."""
    return organization_parts(name)["normalized"]


def organization_parts(name: Column) -> Column:
    """``struct(normalized, legal_forms, descriptors)``; a form that is the whole name stays."""
    words = F.array_join(tokens(name), " ")
    tail = F.regexp_extract(words, "(?<=[a-z0-9])((?: (?:" + "|".join(_forms()) + "))+)$", 1)

    def split_off(x: Column) -> Column:
        core = F.split(F.substr(x["words"], F.lit(1), F.length(x["words"]) - F.length(x["tail"])), " ")
        kept = F.filter(core, lambda t: ~t.isin(*STOP_WORDS))
        legal = F.regexp_extract_all(x["tail"], F.lit(" (" + "|".join(_forms()) + ")(?= |$)"), F.lit(1))
        named = F.transform(legal, _canonical)
        return F.struct(
            F.array_join(F.when(F.size(kept) > 0, kept).otherwise(core), " ").alias("normalized"),
            F.filter(named, lambda f: ~f.isin(*DESCRIPTORS)).alias("legal_forms"),
            F.filter(named, lambda f: f.isin(*DESCRIPTORS)).alias("descriptors"),
        )

    return F.element_at(F.transform(F.array(F.struct(words.alias("words"), tail.alias("tail"))), split_off), 1)


def _canonical(form: Column) -> Column:
    pairs = [(F.lit(v), F.lit(k)) for k, variants in LEGAL.items() for v in variants]
    return F.element_at(F.create_map(*[x for p in pairs for x in p]), form)


def person(name: Column) -> Column:
    """``struct(normalized, given, family, initials)``: "Last, First" is turned round unless what follows the comma is only
    suffixes; honorifics go, suffixes go from names of more than two words."""
    after = F.regexp_extract(name, r"^[^,]*,([^,]*)$", 1)
    only_suffixes = (F.size(tokens(after)) > 0) & F.forall(tokens(after), lambda t: t.isin(*SUFFIXES))
    turned = F.when(only_suffixes, F.regexp_replace(name, ",", " ")).otherwise(F.regexp_replace(name, r"^([^,]*),([^,]*)$", "$2 $1"))

    def parts(all_words: Column) -> Column:
        core = F.filter(all_words, lambda t: ~t.isin(*HONORIFICS) & ~(t.isin(*SUFFIXES) & (F.size(all_words) > 2)))
        return F.element_at(F.transform(F.array(core), fields), 1)

    def fields(core: Column) -> Column:
        first = F.transform(F.slice(core, 1, F.greatest(F.size(core) - 1, F.lit(0))), lambda t: F.substring(t, 1, 1))
        edge = lambda i: F.when(F.size(core) > 0, F.element_at(core, i)).otherwise("")
        return F.struct(F.array_join(core, " ").alias("normalized"), edge(1).alias("given"), edge(-1).alias("family"), F.array_join(first, "").alias("initials"))

    return F.element_at(F.transform(F.array(tokens(turned)), parts), 1)


def address(text: Column) -> Column:
    """``struct(line, postal5)``: street words shortened; the last word of five or nine digits gives the postal code."""
    short = F.create_map(*[F.lit(x) for pair in STREET.items() for x in pair])

    def parts(words: Column) -> Column:
        codes = F.filter(words, lambda t: t.rlike("^[0-9]{5}([0-9]{4})?$"))
        return F.struct(F.array_join(words, " ").alias("line"), F.when(F.size(codes) > 0, F.substring(F.element_at(codes, -1), 1, 5)).alias("postal5"))

    return F.element_at(F.transform(F.array(F.transform(tokens(text), lambda t: F.coalesce(F.try_element_at(short, t), t))), parts), 1)


def normal_name(name: Column, kind: str = "organization") -> Column:
    """The normal form of a name by kind: person, individual, or else an organisation."""
    return person(name)["normalized"] if kind in ("person", "individual") else organization(name)


def soundex(token: Column) -> Column:
    """American Soundex: h and w don't part equal sounds, vowels do; empty without a letter."""
    letters = F.regexp_replace(F.lower(token), "[^a-z]", "")
    digit = "".join(next((d for d, group in SOUND.items() if c in group), "9" if c in "hw" else "0") for c in "abcdefghijklmnopqrstuvwxyz")
    coded = F.translate(letters, "abcdefghijklmnopqrstuvwxyz", digit)
    # the first letter's own sound leads; 9 (h, w) vanishes, then runs of a digit are one, then vowels vanish
    runs = F.regexp_replace(F.regexp_replace(coded, "(?<=.)9", ""), r"([1-6])\1+", "$1")
    rest = F.regexp_replace(F.substr(runs, F.lit(2)), "[09]", "")
    return F.when(letters == "", "").otherwise(F.rpad(F.concat(F.upper(F.substring(letters, 1, 1)), rest), 4, "0"))


def norm(text: Column) -> Column:
    """A label for matching: lower case without accents, anything but letters, digits and _ a single blank."""
    plain = F.regexp_replace(F.translate(F.lower(text), ACCENTED, PLAIN), "[^\\p{L}\\p{N}_]+", " ")
    return F.trim(plain)


#: Latin letters with an accent and without.
ACCENTED, PLAIN = "àáâãäåāăąçćĉċčďèéêëēĕėęěĝğġģĥìíîïĩīĭįĵķĺļľñńņňòóôõöōŏőŕŗřśŝşšţťùúûüũūŭůűųŵýÿŷźżž", "aaaaaaaaacccccdeeeeeeeeegggghiiiiiiiijklllnnnnoooooooorrrssssttuuuuuuuuuuwyyyzzz"


def county_name_key(name: Column) -> Column:
    """Label of a county whether its kind stands in brackets or not."""
    return norm(F.regexp_replace(name, r"\(([^)]*)\)", " $1 "))


def looks_like_id(text: Column) -> Column:
    return F.trim(text).rlike(r"^[A-Za-z][A-Za-z0-9_.\-]*:\S+$")


def is_slug(text: Column) -> Column:
    return text.rlike(r"^[a-z][a-z0-9_\-]{0,95}$")


def is_hash(text: Column) -> Column:
    return text.rlike("^[a-f0-9]{64}$")


def matches_tokens(label: Column, query: list[str]) -> Column:
    """A label holds all query tokens, the last one as a beginning."""
    words = F.split(norm(label), " ")
    out = F.lit(True)
    for q in query[:-1]:
        out = out & F.array_contains(words, q)
    return out & F.exists(words, lambda w: w.startswith(query[-1])) if query else out


def token_jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(0.0)


def jaro(a: str, b: str) -> float:
    """Jaro similarity of two strings."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    taken, left = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                left.append(c)
                break
    if not left:
        return 0.0
    right = [c for c, t in zip(b, taken) if t]
    moved = sum(x != y for x, y in zip(left, right)) / 2
    m = len(left)
    return (m / len(a) + m / len(b) + (m - moved) / m) / 3


@F.pandas_udf(T.DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    """Jaro with a bonus of 0.1 for each of up to four equal first characters."""

    def one(x: str | None, y: str | None) -> float | None:
        if x is None or y is None:
            return None
        j = jaro(x, y)
        same = 0
        while same < min(4, len(x), len(y)) and x[same] == y[same]:
            same += 1
        return j + same * 0.1 * (1 - j) if j > 0.7 else j

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="float64")


#: Kinds of measures as printed and in ids.
BILL_TYPES = {"HR": "hr", "S": "s", "HRES": "hres", "SRES": "sres", "HJRES": "hjres", "SJRES": "sjres", "HCONRES": "hconres", "SCONRES": "sconres"}
CITATION = r"(?i)(?<![A-Za-z0-9.])(H\.?\s?CON\.?\s?RES|S\.?\s?CON\.?\s?RES|H\.?\s?J\.?\s?RES|S\.?\s?J\.?\s?RES|H\.?\s?RES|S\.?\s?RES|H\.?\s?R|S)(?:\.\s?|\s)?([0-9]{1,5})(?![0-9-])"
STATED = r"(?i)^(?:[^;]{0,40}?(?:P\.?\s?L\.?|Public\s+Law)\s*([0-9]{3})-[0-9]+|[^;]{0,25}?\b(1[0-9][0-9])(?:th|st|nd|rd)\s+Congress)"


def bill_id(congress: Column, kind: Column, number: Column) -> Column:
    return F.concat(F.lit("congress:bill:"), congress.cast("string"), F.lit("-"), kind, F.lit("-"), number.cast("string"))


def _bill_kind(printed: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in BILL_TYPES.items() for x in pair]), printed)


def voteview_bill(congress: Column, printed: Column) -> Column:
    """The id of a measure printed like HR2 or SJRES7; NULL otherwise."""
    kind, number = (F.regexp_extract(F.upper(F.trim(printed)), "^([A-Z]+)([0-9]+)$", i) for i in (1, 2))
    return F.when(number != "", bill_id(congress, _bill_kind(kind), F.try_to_number(number, F.lit("9999999999"))))


def bill_parts(identifier: Column) -> Column:
    """``struct(congress, kind, number)`` of a bill id."""
    parts = F.split(F.element_at(F.split(identifier, ":"), -1), "-")
    return F.struct(F.get(parts, F.lit(0)).cast("int").alias("congress"), F.get(parts, F.lit(1)).alias("kind"), F.get(parts, F.lit(2)).cast("int").alias("number"))


def citations(text: Column, congress: Column | None = None) -> Column:
    """Measures cited in free text, in order of first mention: their ids if the Congress is given, else kind and number.

    A Congress named closely after a citation, by ordinal or public law, takes the place of the given one.
    """
    found = F.regexp_extract_all(text, F.lit(CITATION), F.lit(0))

    def one(place: Column) -> Column:
        whole = F.get(found, place)
        kind = F.upper(F.regexp_replace(F.regexp_extract(whole, CITATION, 1), r"[.\s]", ""))
        number = F.regexp_extract(whole, CITATION, 2).cast("int")
        if congress is None:
            return F.when((number > 0) & (number < 20_000), F.concat(kind, number.cast("string")))
        rest = F.get(F.split(text, CITATION, -1), place + 1)
        said = F.coalesce(F.nullif(F.regexp_extract(rest, STATED, 1), F.lit("")), F.nullif(F.regexp_extract(rest, STATED, 2), F.lit("")))
        return F.when((number > 0) & (number < 20_000), bill_id(F.coalesce(said.cast("int"), congress.cast("int")), _bill_kind(kind), number))

    ids = F.when(F.size(found) > 0, F.transform(F.sequence(F.lit(0), F.size(found) - 1), one)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.filter(ids, lambda x: x.isNotNull()))


def holding_parts(record_id: Column) -> Column:
    """The last four parts of a record id."""
    return F.slice(F.split(record_id, ":"), -4, 4)


def canonical_json(value: Column) -> Column:
    """JSON of a map or struct with its keys in order and without blanks."""
    return F.to_json(F.parse_json(F.to_json(value)))


def digest(value: Column) -> Column:
    """SHA-256 of the canonical JSON."""
    return F.sha2(canonical_json(value), 256)


def dig(json: Column, *path: str | int) -> Column:
    """The value at a path of keys and places within JSON text; NULL if the path breaks off."""
    return F.get_json_object(json, "$" + "".join(f"[{p}]" if isinstance(p, int) else f"['{p}']" for p in path))
