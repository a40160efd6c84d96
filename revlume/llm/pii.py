"""Format-preserving pseudonyms of personal data, by keyed Feistel permutations.

Found and validated values are replaced by others of the same format: payment
cards (13 to 19 digits with a right check digit, which the pseudonym has too),
account numbers (IBAN, with right check digits), phone numbers (international;
national ones of ten digits with parentheses, hyphens or dots), social security
numbers, IPv4 addresses, IPv6 addresses in small letters, dates from 1900 to
2099 (``2001-02-03``, ``02/03/2001`` as month/day, as day/month where the first
number is above 12, ``03.02.2001`` as day.month), e-mail addresses (the local
part), secrets after ``password=``, ``token =`` and the like (hexadecimal ones,
and others that hold a letter and a digit) and keys with known beginnings. A
value's pseudonym depends on the key and the value alone, so equal values stay
linked across documents, and the map is one to one within a format, so different
values stay apart. Where a pseudonym would leave its format's values (a day above
12, a secret that is not hexadecimal), it is permuted again until it is one of
them. Numbers that fail validation are left alone.

The key comes to the tasks as a row, so that no plan, user interface or event
log shows it.

Everything is a Spark expression: the text is split at the matches, the matches
are permuted in a higher-order function, and both are joined again.

Nulls and edges: a null text stays null and an empty one empty; a text without
a match is returned as it is; all other columns pass unchanged, whatever their
names; rows are independent, so copies give copies.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .native import hex_number, let
from .storage import free_name

ROUNDS = 10
#: Turns until a pseudonym is one of its format's values.
WALK = 100

# fixed values: the formats
_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})*\.[A-Za-z]{2,24}"
_PHONE = r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){1,3}(?![0-9])"
_SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
_CARD = r"(?<![0-9])(?:[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}|[0-9]{13,19})(?![0-9])"
_IPV4 = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
_DATE = r"(?<![0-9])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9])"
_NAMED = r"(?i:password|passwd|token|secret|api_?key)\s{0,3}[=:]\s{0,3}[\"']?"
_SECRET = _NAMED + r"[0-9a-f]{12,128}(?![0-9A-Za-z])"
_OTHER_SECRET = _NAMED + r"(?=[A-Za-z_+/.~-]*[0-9])(?=[0-9_+/.~-]*[A-Za-z])[A-Za-z0-9_+/.~-]{8,128}(?![0-9A-Za-z])"
_KNOWN_KEY = r"(?<![0-9A-Za-z])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|sk-[0-9A-Za-z]{20,64})(?![0-9A-Za-z])"
_NATIONAL = r"(?<![0-9+(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9]|[.-][0-9])"
_IBAN = r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:[0-9A-Z]{11,30}|(?: [0-9A-Z]{4}){2,7}(?: [0-9A-Z]{1,3})?)(?![0-9A-Za-z])"
_IPV6 = r"(?<![0-9A-Za-z:.])(?:(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}|(?:[0-9a-f]{1,4}:){1,6}(?::[0-9a-f]{1,4}){1,6})(?![0-9A-Za-z:])"
PATTERN = "|".join((_SECRET, _OTHER_SECRET, _KNOWN_KEY, _EMAIL, _IBAN, _PHONE, _NATIONAL, _SSN, _DATE, _IPV4, _IPV6, _CARD))
#: What any match holds; texts without it skip the search.
_HINT = r"[0-9@]"

_HEX = "0123456789abcdef"
_FIRST_DAY, _DAYS = "1900-01-01", (17, 4297)  # 17 * 4297 days to the end of 2099
_SSN_HIGH, _SSN_LOW = 898 * 99, 9999


def _chars(value: Column) -> Column:
    return F.regexp_extract_all(value, F.lit("(?s)."), F.lit(0))


def _digest(key: Column, kind: str, i: Column, value: Column) -> Column:
    return F.sha2(F.concat_ws("|", key, F.lit(kind), i.cast("string"), value.cast("string")), 512)


def _turn(c: Column, by: Column, hexadecimal: bool) -> Column:
    """A character moved on within its own alphabet; others stay."""
    if hexadecimal:
        at = F.instr(F.lit(_HEX), c)
        return F.when(at > 0, F.substring(F.lit(_HEX), 1 + (at - 1 + by) % 16, F.lit(1))).otherwise(c)
    o = F.ascii(c)
    turned = lambda first, n: F.char(F.lit(first) + (o - first + by) % n)
    return F.when(o.between(48, 57), turned(48, 10)).when(o.between(97, 122), turned(97, 26)).when(o.between(65, 90), turned(65, 26)).otherwise(c)


def permute_text(value: Column, key: Column, kind: str, hexadecimal: bool = False) -> Column:
    """Feistel over the two halves of a string; each character stays in its alphabet (digits, lower, upper, hex)."""
    middle = F.floor(F.length(value) / 2).cast("int")
    start = F.struct(F.substring(value, F.lit(1), middle).alias("a"), F.substring(value, middle + 1, F.length(value)).alias("b"))

    def turn(state: Column, i: Column) -> Column:
        new = let(
            _digest(key, kind, i, state["b"]),
            lambda h: F.array_join(F.transform(_chars(state["a"]), lambda c, k: _turn(c, F.conv(F.substring(h, 1 + 2 * (k % 64), F.lit(2)), 16, 10).cast("int"), hexadecimal)), ""),
        )
        return F.struct(state["b"].alias("a"), new.alias("b"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda s: F.concat(s["a"], s["b"]))


def until(value: Column, change: Callable[[Column], Column], wanted: Callable[[Column], Column]) -> Column:
    """``change`` again and again until the result is wanted: still one to one among the wanted values. A format keeps at
    least a third of its values, so WALK turns are enough for all but a share of 2e-18, which would stay as they are after them."""
    first = F.struct(change(value).alias("v"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), first, lambda s, _: F.when(wanted(s["v"]), s).otherwise(F.struct(change(s["v"]).alias("v"))), lambda s: s["v"])


def permute_number(high: Column, low: Column, moduli: tuple[int, int], key: Column, kind: str) -> Column:
    """Feistel over a pair of residues, as struct<h, l>; any two moduli will do."""
    start = F.struct(high.cast("long").alias("h"), low.cast("long").alias("l"))

    def turn(state: Column, i: Column) -> Column:
        new_h = (state["h"] + hex_number(_digest(key, kind, i, state["l"]))) % moduli[0]
        new_l = (state["l"] + hex_number(_digest(key, kind, i, state["h"]))) % moduli[1]
        return F.when(i % 2 == 0, F.struct(new_h.alias("h"), state["l"].alias("l"))).otherwise(F.struct(state["h"].alias("h"), new_l.alias("l")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(2 * ROUNDS)), start, turn)


def _luhn_sum(digits: Column, doubled: int) -> Column:
    """The checksum of digits; doubled: parity, counted from the right, of the places that count twice."""

    def one(c: Column, i: Column) -> Column:
        d = c.cast("int")
        twice = (F.length(digits) - 1 - i) % 2 == doubled
        return F.when(twice, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.transform(_chars(digits), one), F.lit(0), lambda s, x: s + x)


def _card(value: Column, key: Column) -> Column:
    plain = F.translate(value, " -", "")

    def new(d: Column) -> Column:
        inner = permute_text(F.substring(d, F.lit(2), F.length(d) - 2), key, "card")
        body = F.concat(F.substring(d, 1, 1), inner)
        checked = let(body, lambda b: F.concat(b, ((10 - _luhn_sum(b, 0) % 10) % 10).cast("string")))
        parted = F.length(value) > F.length(d)
        separator = F.substring(value, 5, 1)
        blocks = let(checked, lambda c: F.concat(F.substring(c, 1, 4), separator, F.substring(c, 5, 4), separator, F.substring(c, 9, 4), separator, F.substring(c, 13, 4)))
        return F.when(_luhn_sum(d, 1) % 10 != 0, value).when(parted, blocks).otherwise(checked)

    return let(plain, new)


def _phone(value: Column, key: Column) -> Column:
    """The country code and the punctuation stay; the other digits are permuted together."""
    head = F.regexp_extract(value, r"^\+[0-9]{1,3}[ .(-]*", 0)
    head = F.when(F.length(head) == F.length(F.regexp_extract(value, r"^\+[0-9]+", 0)), F.substring(value, 1, 2)).otherwise(head)
    rest = F.substring(value, F.length(head) + 1, F.length(value))
    digits = F.regexp_replace(rest, "[^0-9]", "")

    def spread(new: Column) -> Column:
        def walk(state: Column, c: Column) -> Column:
            digit = c.between("0", "9")
            return F.struct(
                F.concat(state["out"], F.when(digit, F.substring(new, state["at"], F.lit(1))).otherwise(c)).alias("out"),
                F.when(digit, state["at"] + 1).otherwise(state["at"]).alias("at"),
            )

        return F.aggregate(_chars(rest), F.struct(head.alias("out"), F.lit(1).alias("at")), walk, lambda s: s["out"])

    enough = F.length(F.regexp_replace(value, "[^0-9]", "")).between(8, 15)
    return F.when(enough, let(permute_text(digits, key, "phone"), spread)).otherwise(value)


def _national(value: Column, key: Column) -> Column:
    """All ten digits are permuted; the punctuation stays."""
    digits = permute_text(F.regexp_replace(value, "[^0-9]", ""), key, "national")
    cut = lambda d, a, n: F.substring(d, a, n)
    first = F.regexp_extract(value, r"^\(?[0-9]{3}([^0-9]+)", 1)
    return let(digits, lambda d: F.concat(F.when(value.startswith("("), "(").otherwise(""), cut(d, 1, 3), first, cut(d, 4, 3), F.substring(value, F.length(value) - 4, F.lit(1)), cut(d, 7, 4)))


def _iban_rest(text: Column) -> Column:
    """The number that a text of digits and capitals stands for (A is 10), modulo 97."""
    def add(n: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), (n * 10 + c.cast("long")) % 97).otherwise((n * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(_chars(text), F.lit(0).cast("long"), add)


def _iban(value: Column, key: Column) -> Column:
    def new(plain: Column) -> Column:
        country, own = F.substring(plain, 1, 2), F.substring(plain, F.lit(5), F.length(plain) - 4)
        body = permute_text(own, key, "iban")
        checked = let(body, lambda b: F.concat(country, F.lpad((98 - _iban_rest(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0"), b))
        spaced = F.when(F.contains(value, F.lit(" ")), let(checked, lambda c: F.trim(F.regexp_replace(c, "(.{4})", "$1 ")))).otherwise(checked)
        valid = F.length(plain).between(15, 34) & (_iban_rest(F.concat(own, F.substring(plain, 1, 4))) == 1)
        return F.when(valid, spaced).otherwise(value)

    return let(F.translate(value, " ", ""), new)


def _ipv6(value: Column, key: Column) -> Column:
    """The hexadecimal digits are permuted, each group keeps its length."""
    return permute_text(value, key, "ipv6", hexadecimal=True)


def _ssn(value: Column, key: Column) -> Column:
    area, group, serial = (F.substring(value, a, n).cast("int") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    place = F.when(area > 666, area - 2).otherwise(area - 1)

    def text(s: Column) -> Column:
        at = F.floor(s["h"] / 99)
        back = F.when(at >= 665, at + 2).otherwise(at + 1)
        return F.format_string("%03d-%02d-%04d", back.cast("int"), (s["h"] % 99 + 1).cast("int"), (s["l"] + 1).cast("int"))

    return F.when(valid, let(permute_number(place * 99 + group - 1, serial - 1, (_SSN_HIGH, _SSN_LOW), key, "ssn"), text)).otherwise(value)


def _ipv4(value: Column, key: Column) -> Column:
    parts = F.transform(F.split(value, r"\."), lambda x: x.cast("int"))

    def new(p: Column) -> Column:
        text = lambda s: F.concat_ws(".", *(x.cast("long").cast("string") for x in (F.floor(s["h"] / 256), s["h"] % 256, F.floor(s["l"] / 256), s["l"] % 256)))
        permuted = let(permute_number(p[0] * 256 + p[1], p[2] * 256 + p[3], (65536, 65536), key, "ipv4"), text)
        return F.when(F.forall(p, lambda x: x < 256), permuted).otherwise(value)

    return let(parts, new)


def _date(value: Column, key: Column) -> Column:
    def moved(day: Column) -> Column:
        n = F.datediff(day, F.lit(_FIRST_DAY))
        return let(permute_number(F.floor(n / _DAYS[1]), n % _DAYS[1], _DAYS, key, "date"), lambda s: F.date_add(F.lit(_FIRST_DAY).cast("date"), (s["h"] * _DAYS[1] + s["l"]).cast("int")))

    def in_format(pattern: str, day: Column, change: Callable[[Column], Column] = moved) -> Column:
        return F.when(day.between("1900-01-01", "2099-12-31"), F.date_format(change(day), pattern)).otherwise(value)

    def parsed(year: int, month: int, day: int) -> Column:
        iso = F.concat_ws("-", F.substring(value, year, 4), F.substring(value, month, 2), F.substring(value, day, 2))
        return F.try_to_date(iso, "yyyy-MM-dd")

    # read as month/day, such a date would be none: its days stay above 12
    day_first = in_format("dd/MM/yyyy", parsed(7, 4, 1), lambda day: until(day, moved, lambda x: F.dayofmonth(x) > 12))
    return (
        F.when(F.substring(value, 5, 1) == "-", in_format("yyyy-MM-dd", parsed(1, 6, 9)))
        .when((F.substring(value, 3, 1) == "/") & (F.substring(value, 1, 2) > "12"), day_first)
        .when(F.substring(value, 3, 1) == "/", in_format("MM/dd/yyyy", parsed(7, 1, 4)))
        .otherwise(in_format("dd.MM.yyyy", parsed(7, 4, 1)))
    )


def _email(value: Column, key: Column) -> Column:
    local = F.substring_index(value, "@", 1)
    return F.concat(permute_text(local, key, "email"), F.substring(value, F.length(local) + 1, F.length(value)))


def _secret(value: Column, key: Column) -> Column:
    own = F.regexp_extract(value, "[0-9a-f]{12,128}$", 0)
    return F.concat(F.substring(value, F.lit(1), F.length(value) - F.length(own)), permute_text(own, key, "secret", hexadecimal=True))


def _other_secret(value: Column, key: Column) -> Column:
    own = F.regexp_extract(value, "[A-Za-z0-9_+/.~-]{8,128}$", 0)
    plain = lambda v: ~v.rlike("^[0-9a-f]{12,128}$")
    return F.concat(F.substring(value, F.lit(1), F.length(value) - F.length(own)), until(own, lambda v: permute_text(v, key, "other"), plain))


def _known_key(value: Column, key: Column) -> Column:
    head = F.regexp_extract(value, "^(?:AKIA|gh[pousr]_|sk-)", 0)
    return F.concat(head, permute_text(F.substring(value, F.length(head) + 1, F.length(value)), key, "key"))


def pseudonym(value: Column, key: Column) -> Column:
    """The pseudonym of one match."""
    # order matters where formats share a beginning; a full match tells them apart
    kinds: list[tuple[str, Callable[[Column, Column], Column]]] = [
        (_SECRET, _secret), (_OTHER_SECRET, _other_secret), (_KNOWN_KEY, _known_key), (r"[^@]+@[^@]+", _email), (r"[A-Z]{2}[0-9]{2}[0-9A-Z ]+", _iban), (r"\+.*", _phone), (_NATIONAL, _national), (r"[0-9]{3}-[0-9]{2}-[0-9]{4}", _ssn),
        (r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}", _date), (r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", _ipv4), (r"[0-9a-f:]+:[0-9a-f:]+", _ipv6), (r"[0-9 -]{13,19}", _card),
    ]
    out = None
    for pattern, change in kinds:
        is_kind = value.rlike(f"^(?:{pattern})$")
        out = F.when(is_kind, change(value, key)) if out is None else out.when(is_kind, change(value, key))
    return out.otherwise(value)


def pseudonymize_text(text: Column, key: Column) -> Column:
    pieces, found = F.split(text, PATTERN), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    joined = F.array_join(F.zip_with(pieces, F.transform(found, lambda v: pseudonym(v, key)), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return F.when(text.rlike(_HINT), joined).otherwise(text)


def pseudonymize(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with pseudonyms in ``text``; all columns and rows are kept."""
    if not key:
        raise ValueError("pseudonyms need a key")
    name = free_name(docs, "pseudonym_key")
    keys = docs.sparkSession.createDataFrame([(key,)], f"{name} string")  # one row
    return docs.join(F.broadcast(keys)).withColumn("text", pseudonymize_text(F.col("text"), F.col(name))).select(*docs.columns)
