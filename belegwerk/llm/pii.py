"""Personal data replaced by format-preserving pseudonyms, by SQL expressions alone.

Numbers and dates that pass their own validation are permuted under a key inside their format
by a Feistel network: two halves of mixed radix, each in turn shifted by a keyed digest of the
other, modulo its range. That is a bijection on the valid values of the format, so equal values
get equal pseudonyms in every document, and different ones different. A card number keeps its
length and gets a right check digit; a date stays a date, an address an address. E-mail
addresses and secrets, which have no numeric range, get keyed digests of the same shape.

Each row is rewritten by itself: texts are split at candidates, the candidates mapped, and both
zipped together again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 8
#: Days from 0001-01-01 to 9999-12-31, and those of them that are permuted among themselves as
#: recent: 319 * 229 from 1900-01-01 on, to 2100-01-02. The others number 27961 * 128.
EPOCH, RECENT, DAYS = "0001-01-01", 693595, 3652059
RECENT_HALVES, OTHER_HALVES = (319, 229), (27961, 128)
#: The setting that holds the key where the caller gives none.
KEY_SETTING = "spark.belegwerk.pseudonym.key"
#: A published key, for the queries over invented tables, where a session sets none.
TABLE_KEY = "invented tables need no secret"

#: One pattern per kind. None can start inside a run that it could have started before, so the
#: search is linear in the text.
_NAMED = r"(?i:\b(?:api[_-]?key|token|secret|password)\s*+[=:]\s*+)"
SECRET = _NAMED + r"""(?:"[^"\n]++"|'[^'\n]++'|(?=[^\s"',;]*[0-9])(?=[^\s"',;]*[A-Za-z])[A-Za-z0-9_.+/=~-]{8,}+)"""
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IPV4 = r"(?<![\w.])[0-9]{1,3}+(?:\.[0-9]{1,3}+){3}(?![\w]|\.[0-9])"
DATE = r"(?<![\w.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![\w-])"
#: With a country code, or as in North America.
PHONE = r"(?<![\w+])\+[0-9]{1,3} ?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ -][0-9]{3}[ -][0-9]{4}(?![0-9])"
LOCAL = r"(?<![\w.+-])(?:\([0-9]{3}\) ?|[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}(?![\w-]|\.[0-9])"
SSN = r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"
IBAN = r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?+(?!\w)"
#: A run of whole digit groups, of which cards are found later; no group starts another kind.
_GROUP = r"[0-9]++(?!\w|-(?![0-9]))"
CARD = rf"(?<![\w.+-])(?=[0-9](?:[ -]?[0-9]){{12}}){_GROUP}(?:[ -](?!{EMAIL}|{IPV4}|{DATE}|{LOCAL}|{SSN}){_GROUP})*+"
#: The usual groupings of a card number; they win over chance ones.
SHAPED = "^(?:[0-9]+|[0-9]{4}([ -])[0-9]{4}\\1[0-9]{4}\\1[0-9]{1,7}|[0-9]{4}([ -])[0-9]{6}\\2[0-9]{4,5})$"
CANDIDATE = "|".join((SECRET, EMAIL, IPV4, DATE, PHONE, LOCAL, SSN, IBAN, CARD))


def _turned(halves: Column, left: Column, right: Column, key: str, tweak: str, shown) -> Column:
    """The rounds on the halves (a, b), 0 <= a < left and 0 <= b < right."""

    def turn(acc: Column, i: Column) -> Column:
        even = i % 2 == 0
        seen = F.when(even, acc["b"]).otherwise(acc["a"])
        digest = F.sha2(F.concat_ws(":", F.lit(key), F.lit(tweak), i.cast("string"), seen.cast("string")), 256)
        shift = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
        return F.struct(
            F.when(even, (acc["a"] + shift % left) % left).otherwise(acc["a"]).alias("a"),
            F.when(even, acc["b"]).otherwise((acc["b"] + shift % right) % right).alias("b"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), halves, turn, shown)


def feistel(value: Column, left: Column, right: Column, key: str, tweak: str) -> Column:
    """A keyed permutation of 0 <= value < left * right, for columns of positive longs."""
    halves = F.struct(_div(value, right).alias("a"), (value % right).alias("b"))
    return _turned(halves, left, right, key, tweak, lambda acc: acc["a"] * right + acc["b"])


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _ten(n: Column) -> Column:
    return F.pow(F.lit(10.0), n).cast("long")


def _luhn_sum(digits: Column) -> Column:
    """The Luhn sum with the rightmost digit counted once."""
    back = F.split(F.reverse(digits), "")
    placed = F.filter(F.zip_with(back, F.sequence(F.lit(0), F.size(back) - 1), lambda c, i: F.struct(c.alias("c"), i.alias("i"))), lambda x: x["c"] != "")
    return F.aggregate(
        placed,
        F.lit(0),
        lambda s, x: s + F.when(x["i"] % 2 == 0, x["c"].cast("int")).otherwise(2 * x["c"].cast("int") - F.when(x["c"].cast("int") > 4, 9).otherwise(0)),
    )


def _filled(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced, in order, by ``digits``."""
    return F.array_join(
        F.transform(
            F.sequence(F.lit(1), F.length(shape)),
            lambda i: F.when(
                F.substr(shape, i, F.lit(1)).rlike("[0-9]"), F.substr(digits, F.length(_digits(F.substr(shape, F.lit(1), i))), F.lit(1))
            ).otherwise(F.substr(shape, i, F.lit(1))),
        ),
        "",
    )


def _permuted_digits(digits: Column, key: str, tweak: str) -> Column:
    """Digit strings of 2 to 36 places onto strings of the same length."""
    n = F.length(digits)
    high = F.floor(n / 2).cast("int")
    halves = F.struct(F.substr(digits, F.lit(1), high).cast("long").alias("a"), F.substr(digits, high + 1).cast("long").alias("b"))
    padded = lambda acc: F.concat(F.lpad(acc["a"].cast("string"), high, "0"), F.lpad(acc["b"].cast("string"), n - high, "0"))
    return _turned(halves, _ten(high), _ten(n - high), key, tweak, padded)


def _card(x: Column, key: str) -> Column:
    def of(d: Column) -> Column:
        body = _permuted_digits(F.substr(d, F.lit(1), F.length(d) - 1), key, "card")
        check = (10 - _luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10
        return _filled(x, F.concat(body, check.cast("string")))

    return _let(_digits(x), of)


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _phone(x: Column, key: str) -> Column:
    """The country code stays, so a number stays one of its country."""
    head = F.regexp_extract(x, r"^(?:\+[0-9]{1,3})?", 0)
    rest = F.substr(x, F.length(head) + 1)
    return F.concat(head, _filled(rest, _permuted_digits(_digits(rest), key, "phone")))


def _ip(x: Column, key: str) -> Column:
    parts = F.split(x, r"\.")
    value = F.aggregate(parts, F.lit(0).cast("long"), lambda s, p: s * 256 + p.cast("long"))
    half = F.lit(65536).cast("long")
    return _let(
        feistel(value, half, half, key, "ip"),
        lambda v: F.concat_ws(".", *[F.shiftrightunsigned(v, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)]),
    )


def _ssn(x: Column, key: str) -> Column:
    """Area 001 to 899 but 666, group 01 to 99, serial 0001 to 9999, counted without the gaps."""
    area, group, serial = (F.substr(x, F.lit(a), F.lit(n)).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    index = F.when(area > 666, area - 2).otherwise(area - 1)
    rest = F.lit(99 * 9999).cast("long")
    value = index * rest + (group - 1) * 9999 + (serial - 1)

    def show(v: Column) -> Column:
        i = _div(v, rest)
        a = F.when(i >= 665, i + 2).otherwise(i + 1)
        return F.concat_ws(
            "-",
            F.lpad(a.cast("string"), 3, "0"),
            F.lpad((_div(v % rest, F.lit(9999).cast("long")) + 1).cast("string"), 2, "0"),
            F.lpad((v % 9999 + 1).cast("string"), 4, "0"),
        )

    return _let(feistel(value, F.lit(898).cast("long"), rest, key, "ssn"), show)


def _day(x: Column) -> Column:
    iso = F.when(x.contains("-"), x).otherwise(
        F.when(x.contains("/"), F.concat_ws("-", F.substr(x, F.lit(7), F.lit(4)), F.substr(x, F.lit(1), F.lit(2)), F.substr(x, F.lit(4), F.lit(2)))).otherwise(
            F.concat_ws("-", F.substr(x, F.lit(7), F.lit(4)), F.substr(x, F.lit(4), F.lit(2)), F.substr(x, F.lit(1), F.lit(2)))
        )
    )
    return F.datediff(F.try_to_date(iso, "yyyy-MM-dd"), F.lit(EPOCH).cast("date"))


def _date(x: Column, key: str) -> Column:
    """Recent days stay recent ones, and all others are permuted among themselves."""
    day, size = _day(x).cast("long"), RECENT_HALVES[0] * RECENT_HALVES[1]
    half = lambda n: F.lit(n).cast("long")
    recent = feistel(day - RECENT, *map(half, RECENT_HALVES), key, "date") + RECENT
    other = feistel(F.when(day < RECENT, day).otherwise(day - size), *map(half, OTHER_HALVES), key, "other date")
    new = F.when(_is_recent(day), recent).otherwise(_let(other, lambda v: F.when(v < RECENT, v).otherwise(v + size)))
    day = F.date_add(F.lit(EPOCH).cast("date"), new.cast("int"))
    shape = F.when(x.contains("-"), F.date_format(day, "yyyy-MM-dd")).otherwise(
        F.when(x.contains("/"), F.date_format(day, "MM/dd/yyyy")).otherwise(F.date_format(day, "dd.MM.yyyy"))
    )
    return shape


def _is_recent(day: Column) -> Column:
    return day.between(RECENT, RECENT + RECENT_HALVES[0] * RECENT_HALVES[1] - 1)


def _rest97(x: Column) -> Column:
    """What is left of a digit string of any length modulo 97."""
    return F.aggregate(F.filter(F.split(x, ""), lambda c: c != ""), F.lit(0), lambda s, c: (s * 10 + c.cast("int")) % 97)


def _iban_digits(x: Column) -> Column:
    """An account number without blanks, its first four places moved to the end, letters as 10 to 35."""
    plain = F.replace(x, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))
    return F.array_join(F.transform(F.split(turned, ""), lambda c: F.when(c.rlike("[A-Z]"), (F.ascii(c) - 55).cast("string")).otherwise(c)), "")


def _iban(x: Column, key: str) -> Column:
    """Country and letters stay, the digits after the check digits are permuted, and these made anew."""

    def checked(body: Column) -> Column:
        blank = F.concat(F.substr(body, F.lit(1), F.lit(2)), F.lit("00"), F.substr(body, F.lit(5)))
        check = F.lpad((98 - _rest97(_iban_digits(blank))).cast("string"), 2, "0")
        return F.concat(F.substr(body, F.lit(1), F.lit(2)), check, F.substr(body, F.lit(5)))

    tail = F.substr(x, F.lit(5))
    digits = _digits(tail)
    new = F.when(F.length(digits) >= 2, _filled(tail, _permuted_digits(digits, key, "iban"))).otherwise(tail)
    return _let(F.concat(F.substr(x, F.lit(1), F.lit(4)), new), checked)


def _email(x: Column, key: str) -> Column:
    """A keyed digest in the reserved domain; letter case does not tell addresses apart."""
    return F.concat(F.lit("person-"), F.substring(F.sha2(F.concat_ws(":", F.lit(key), F.lit("email"), F.lower(x)), 256), 1, 16), F.lit("@redacted.invalid"))


def _secret(x: Column, key: str) -> Column:
    """The value becomes as many hexadecimal digits of keyed digests; its name and quotes stay."""
    head = F.regexp_extract(x, _NAMED + "[\"']?", 0)
    quote = F.when(F.substr(x, F.length(x)).isin('"', "'"), F.substr(x, F.length(x))).otherwise("")
    value = F.substr(x, F.length(head) + 1, F.length(x) - F.length(head) - F.length(quote))

    def digits(v: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor(F.length(v) / 64).cast("int"))
        stream = F.array_join(F.transform(blocks, lambda i: F.sha2(F.concat_ws(":", F.lit(key), F.lit("secret"), i.cast("string"), v), 256)), "")
        return F.substr(stream, F.lit(1), F.length(v))

    return F.concat(head, _let(value, digits), quote)


def _is_card(x: Column) -> Column:
    return _let(_digits(x), lambda d: F.length(d).between(13, 19) & d.rlike("[1-9]") & (F.when(F.length(d).between(13, 19), _luhn_sum(d)).otherwise(1) % 10 == 0))


def _pieces(run: Column) -> Column:
    """A run of digit groups cut into structs (x, kind): cards, and what stands between them.

    Every grouping of whole groups with 13 to 19 digits is tried. From the left the longest valid
    one is taken, a usual shape before any other, and no other that overlaps a later usual one.
    """
    units = F.regexp_extract_all(run, F.lit("[0-9]+|[ -]"), F.lit(0))
    joined = lambda u, i, n: F.array_join(F.slice(u, i, n), "")

    def best(u: Column, i: Column) -> Column:
        sizes = F.filter(F.transform(F.sequence(F.lit(0), F.lit(18)), lambda m: 2 * m + 1), lambda n: (i + n - 1 <= F.size(u)) & joined(u, i, F.least(n, F.lit(1))).rlike("[0-9]"))
        valid = F.filter(F.filter(sizes, lambda n: F.length(_digits(joined(u, i, n))).between(13, 19)), lambda n: _is_card(joined(u, i, n)))
        ranked = F.transform(valid, lambda n: F.struct(joined(u, i, n).rlike(SHAPED).alias("s"), n.alias("n")))
        return F.coalesce(F.array_max(ranked), F.struct(F.lit(False).alias("s"), F.lit(0).alias("n")))

    def walked(u: Column, cards: Column) -> Column:
        none = F.array().cast("array<struct<x:string,kind:string>>")

        def step(acc: Column, i: Column) -> Column:
            c = F.element_at(cards, i)
            blocked = ~c["s"] & F.exists(F.slice(cards, i + 1, F.greatest(c["n"] - 1, F.lit(0))), lambda later: later["s"])
            taken = F.when((c["n"] > 0) & ~blocked, c["n"]).otherwise(0)
            kind = F.when(taken > 0, F.lit("card"))
            more = F.array_append(acc["p"], F.struct(joined(u, i, F.greatest(taken, F.lit(1))).alias("x"), kind.alias("kind")))
            return F.when(i < acc["to"], acc).otherwise(F.struct(more.alias("p"), (i + F.greatest(taken, F.lit(1))).alias("to")))

        return F.aggregate(F.sequence(F.lit(1), F.size(u)), F.struct(none.alias("p"), F.lit(1).alias("to")), step, lambda acc: acc["p"])

    return _let(units, lambda u: _let(F.transform(F.sequence(F.lit(1), F.size(u)), lambda i: best(u, i)), lambda cards: walked(u, cards)))


_IS_LOCAL = r"^(?:\([0-9]{3}\) ?|[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}$"
_IS_DATE = "^(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}([/.])[0-9]{2}\\1[0-9]{4})$"


def kind_of(x: Column) -> Column:
    """The kind of a candidate that is valid as one; null for any other, and for digit runs."""
    octets = F.transform(F.split(x, r"\."), lambda p: p.cast("int"))
    area, group, serial = (F.substr(x, F.lit(a), F.lit(n)) for a, n in ((1, 3), (5, 2), (8, 4)))
    return (
        F.when(x.rlike("^" + _NAMED), F.lit("secret"))
        .when(x.contains("@"), "email")
        .when(x.startswith("+") | x.rlike(_IS_LOCAL), "phone")
        .when(x.rlike(r"^[0-9]+(\.[0-9]+){3}$"), F.when(~F.exists(octets, lambda o: o > 255), F.lit("ip")))
        .when(x.rlike(_IS_DATE), F.when(_day(x).between(0, DAYS - 1), F.lit("date")))
        .when(
            x.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"),
            F.when(~area.isin("000", "666") & (area < "900") & (group != "00") & (serial != "0000"), F.lit("ssn")),
        )
        .when(x.rlike("^[A-Z]{2}[0-9]{2}"), F.when(F.length(F.replace(x, F.lit(" "), F.lit(""))).between(15, 34) & (_rest97(_iban_digits(x)) == 1), F.lit("iban")))
    )


def _found(x: Column) -> Column:
    """The pieces of a candidate: itself, or those of a digit run. What only looked like an account
    number may end in one."""
    other = x.rlike(f"^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$|[^0-9 -]|^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$|{_IS_LOCAL}")
    whole = F.array(F.struct(x.alias("x"), kind_of(x).alias("kind")))
    tail = F.regexp_extract(x, "(?: [0-9]+)+$", 0)
    begun = F.array(F.struct(F.substr(x, F.lit(1), F.length(x) - F.length(tail)).alias("x"), F.lit(None).cast("string").alias("kind")))
    missed = x.rlike("^[A-Z]{2}[0-9]{2}") & x.rlike("(?: [0-9]+)+$") & kind_of(x).isNull()
    return F.when(missed, F.concat(begun, _pieces(tail))).when(other, whole).otherwise(_pieces(x))


def pseudonym(x: Column, kind: Column, key: str) -> Column:
    return (
        F.when(kind == "secret", _secret(x, key))
        .when(kind == "email", _email(x, key))
        .when(kind == "phone", _phone(x, key))
        .when(kind == "ip", _ip(x, key))
        .when(kind == "date", _date(x, key))
        .when(kind == "ssn", _ssn(x, key))
        .when(kind == "iban", _iban(x, key))
        .when(kind == "card", _card(x, key))
        .otherwise(x)
    )


def key_of(spark: SparkSession) -> str:
    """The key of the session's setting."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        raise ValueError(f"give a key, or set {KEY_SETTING}: whoever knows it can undo the pseudonyms")
    return key


def pseudonymised(docs: DataFrame, key: str | None = None) -> DataFrame:
    """``docs(text, ...)`` -> the same columns with ``text`` rewritten, and ``_kinds``, the kinds
    found in order of place.

    Kinds: secret, email, phone, ip, date, ssn, iban, card. A card may stand next to other numbers:
    all groupings of its digit run are tried. Secrets are quoted values of any length after a name
    such as ``password``, or unquoted ones of 8 characters and more that hold a letter and a digit.
    All days of the calendar from year 1 to 9999 are dates. Leading zeros do not tell the octets of
    addresses apart. A candidate that fails its kind's validation (check digit, octets, calendar,
    area) stays as it is. Where two kinds could start at one place, the first in the order above is
    taken. Null texts stay null and find nothing; repeated rows are rewritten alike. A column named
    ``_kinds`` is replaced; all others, whatever their names, stay. An empty table gives an empty
    result. ``key`` is by default that of the setting KEY_SETTING; without either nothing is done.
    """
    key = key or key_of(docs.sparkSession)
    text = F.col("text").cast("string")
    spare = "_found"
    while spare in docs.columns:
        spare += "_"
    # most texts hold no candidate: they skip both searches
    some = text.rlike("[0-9@\"'=:]")
    out = docs.withColumn(
        spare,
        F.when(some, F.transform(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), _found)).otherwise(F.array().cast("array<array<struct<x:string,kind:string>>>")),
    )
    found = F.exists(spare, lambda pieces: F.exists(pieces, lambda f: f["kind"].isNotNull()))
    gaps = F.split(text, CANDIDATE, -1)
    put = F.transform(spare, lambda pieces: F.array_join(F.transform(pieces, lambda f: pseudonym(f["x"], f["kind"], key)), ""))
    whole = F.array_join(F.zip_with(gaps, put, lambda g, p: F.concat(g, F.coalesce(p, F.lit("")))), "")
    out = out.withColumn("text", F.when(found, whole).otherwise(text))
    kinds = F.transform(F.filter(F.flatten(spare), lambda f: f["kind"].isNotNull()), lambda f: f["kind"])
    return out.withColumn("_kinds", F.coalesce(kinds, F.array().cast("array<string>"))).drop(spare)
