"""Format-preserving pseudonyms for personal data, in DataFrame functions alone.

Candidates are found with one regular expression, validated (Luhn check for card numbers, the mod-97 check for
IBANs, calendar for dates, ranges for addresses and social security numbers) and replaced by a keyed
permutation within their format: an alternating Feistel network over Z_a x Z_b, whose round function is SHA-256
of key, kind, round and the other half. Card numbers stay Luhn-valid card numbers of the same length and
spacing, dates stay dates in the order they were written in (those from 1900 to 2099 stay in these years, others
stay others, between the years 1 and 9999), addresses stay addresses, IBANs keep their country and have digits and
letters where they had them. As it is a permutation under one key, equal values have equal pseudonyms in all
documents and different values different ones. The local parts of mail addresses and hexadecimal secrets aren't
numbers; they become keyed digests of fitting form. Who has the key can turn pseudonyms back: callers give it.

Whatever fails validation is left as it is. The operator is one pass without a shuffle. No repetition in the
expression is unbounded over groups, so no text, however long, exhausts a stack.

Cases: null texts stay null with 0 found; empty texts stay empty; repeated rows get equal results; a table without
rows gives a table without rows; other columns pass through whatever their names. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inquest.llm.common import free_name

ROUNDS = 8
_EMAIL = r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,125}\.[A-Za-z]{2,24}"  # a name has at most 127 labels
_SECRET = r"(?<![0-9A-Za-z])[0-9a-fA-F]{32,64}(?![0-9A-Za-z])"
_IP = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])"
_ISO = r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])"
_DAY = r"(?<![0-9/.])[0-9]{1,2}([/.])[0-9]{1,2}\g[0-9]{4}(?![0-9/])"
#: Lengths of IBANs by country; the word after a number of known length is no part of it.
_IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ CY DO GT HU LB PL",
    29: "BR PS QA", 30: "JO KW", 31: "MT",
}
_IBAN_KNOWN = "|".join(f"(?:{'|'.join(c.split())})[0-9]{{2}}(?: ?[0-9A-Z]{{4}}){{{n // 4 - 1}}}" + (f" ?[0-9A-Z]{{{n % 4}}}" if n % 4 else "") + "(?![0-9A-Za-z])" for n, c in _IBAN_LENGTHS.items())
_IBAN = rf"(?<![0-9A-Za-z])(?:{_IBAN_KNOWN}|[A-Z]{{2}}[0-9]{{2}}(?: ?[0-9A-Z]{{4}}){{2,7}}(?: ?[0-9A-Z]{{1,3}})?(?![0-9A-Za-z]))"
_SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
_CARD = r"(?<![0-9A-Za-z])[0-9]{4}([ -])[0-9]{4}\g[0-9]{4}\g[0-9]{4}(?![0-9A-Za-z])|(?<![0-9A-Za-z])3[47][0-9]{2}([ -])[0-9]{6}\g[0-9]{5}(?![0-9A-Za-z])|(?<![0-9A-Za-z])[0-9]{13,19}(?![0-9A-Za-z])"
_PHONE = r"(?<![0-9+])\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,3}(?![0-9])|(?<![0-9])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])|(?<![0-9.-])[0-9]{3}([.-])[0-9]{3}\g[0-9]{4}(?![0-9])"
KINDS = ("email", "secret", "ip", "date", "iban", "ssn", "card", "phone")


def _pattern() -> str:
    parts, group = [], 0
    for p in (_EMAIL, _SECRET, _IP, _ISO, _DAY, _IBAN, _SSN, _CARD, _PHONE):
        # \g stands for the group that opened last
        at = 0
        while at < len(p):
            if p.startswith("([", at) and p[at - 1 : at] != "\\":
                group += 1
            if p.startswith(r"\g", at):
                p = f"{p[:at]}(?:\\{group}){p[at + 2 :]}"
            at += 1
        parts.append(p)
    return "|".join(parts)


PATTERN = _pattern()


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate value once and use it."""
    return F.get(F.transform(F.array(value), use), 0)


def _luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _number(c: Column) -> Column:
    return c.cast("bigint")


def feistel(key: str, kind: str, left: Column, right: Column, size_left: Column, size_right: Column) -> Column:
    """A keyed permutation of Z_size_left x Z_size_right: struct(a, b)."""

    def mixed(other: Column, turn: Column, size: Column) -> Column:
        digest = F.sha2(F.concat(F.lit(f"{key}|{kind}|"), turn.cast("string"), F.lit("|"), other.cast("string")).cast("binary"), 256)
        return F.pmod(_number(F.conv(F.substring(digest, 1, 15), 16, 10)), size)

    def step(s: Column, turn: Column) -> Column:
        odd = F.struct(F.pmod(s["a"] + mixed(s["b"], turn, size_left), size_left).alias("a"), s["b"].alias("b"))
        even = F.struct(s["a"].alias("a"), F.pmod(s["b"] + mixed(s["a"], turn, size_right), size_right).alias("b"))
        return F.when(turn % 2 == 1, odd).otherwise(even)

    start = F.struct(_number(left).alias("a"), _number(right).alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)


def _ten(n: Column) -> Column:
    return _number(F.rpad(F.lit("1"), n + 1, "0"))


def permuted_digits(key: str, kind: str, digits: Column) -> Column:
    """A permutation of the strings of two to eighteen digits, length by length."""

    def cut(d: Column) -> Column:
        k = F.floor(F.length(d) / 2).cast("int")
        rest = F.length(d) - k
        done = feistel(key, kind, F.left(d, k), F.right(d, rest), _ten(k), _ten(rest))
        return _let(done, lambda s: F.concat(F.lpad(s["a"].cast("string"), k, "0"), F.lpad(s["b"].cast("string"), rest, "0")))

    return _let(digits, cut)


def permuted_code(key: str, kind: str, code: Column) -> Column:
    """A permutation of the strings of 2 to 32 digits and capitals that leaves digits and capitals where they are."""

    def moved(half: Column, other: Column, turn: Column) -> Column:
        digest = F.sha2(F.concat(F.lit(f"{key}|{kind}|"), turn.cast("string"), F.lit("|"), other).cast("binary"), 256)

        def shifted(g: Column) -> Column:
            def char(c: Column, i: Column) -> Column:
                by = _number(F.conv(F.substr(g, i * 4 + 1, F.lit(4)), 16, 10))
                number = F.char(48 + (F.ascii(c) - 48 + by) % 10)
                return F.when(c.rlike("^[0-9]$"), number).otherwise(F.char(65 + (F.ascii(c) - 65 + by) % 26))

            return F.array_join(F.transform(F.split(half, "(?!^)(?!$)"), char), "")

        return _let(digest, shifted)

    def step(s: Column, turn: Column) -> Column:
        odd = F.struct(moved(s["a"], s["b"], turn).alias("a"), s["b"].alias("b"))
        return F.when(turn % 2 == 1, odd).otherwise(F.struct(s["a"].alias("a"), moved(s["b"], s["a"], turn).alias("b")))

    k = F.floor(F.length(code) / 2).cast("int")
    start = F.struct(F.left(code, k).alias("a"), F.right(code, F.length(code) - k).alias("b"))
    return _let(F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step), lambda s: F.concat(s["a"], s["b"]))


def _refilled(shape: Column, digits: Column, filled: str = "^[0-9]$") -> Column:
    """shape with its digits, or what else is filled, replaced one after another."""

    def step(s: Column, c: Column) -> Column:
        digit = c.rlike(filled)
        return F.struct(F.concat(s["o"], F.when(digit, F.substr(digits, s["p"], F.lit(1))).otherwise(c)).alias("o"), (s["p"] + digit.cast("int")).alias("p"))

    start = F.struct(F.lit("").alias("o"), F.lit(1).alias("p"))
    return F.aggregate(F.split(shape, "(?!^)(?!$)"), start, step)["o"]


def _iban_rest(code: Column) -> Column:
    """The number that an IBAN stands for, modulo 97."""
    turned = F.concat(F.substr(code, F.lit(5)), F.left(code, F.lit(4)))

    def step(r: Column, c: Column) -> Column:
        letter = F.ascii(c) - 55
        return F.when(c.rlike("^[0-9]$"), (r * 10 + F.ascii(c) - 48) % 97).otherwise((r * 100 + letter) % 97)

    return F.aggregate(F.split(turned, "(?!^)(?!$)"), F.lit(0), step)


def _date_parts(m: Column) -> Column:
    """struct(y, m, d, form): form 0 is year first, 1 month first, 2 day first."""
    n = lambda k: F.get(F.split(m, "[-/.]"), k).cast("int")
    iso = m.rlike("^[0-9]{4}-")
    form = F.when(iso, 0).when(m.contains(".") | (n(0) > 12), 2).otherwise(1)
    day = F.when(iso, n(2)).when(form == 2, n(0)).otherwise(n(1))
    month = F.when(iso, n(1)).when(form == 2, n(1)).otherwise(n(0))
    return F.struct(F.when(iso, n(0)).otherwise(n(2)).alias("y"), month.alias("m"), day.alias("d"), form.alias("form"))


def _valid_date(p: Column) -> Column:
    leap = ((p["y"] % 4 == 0) & (p["y"] % 100 != 0)) | (p["y"] % 400 == 0)
    most = F.when(p["m"].isin(4, 6, 9, 11), 30).when(p["m"] == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
    return (p["y"] >= 1) & p["m"].between(1, 12) & (p["d"] >= 1) & (p["d"] <= most)


def permuted_day(key: str, day: Column) -> Column:
    """A permutation of the 17 * 4,297 days from 1900 to 2099, and one of the 170 * 21,053 other days of four-digit years."""
    at = lambda text: F.lit(text).cast("date")
    first, century, after, before = at("0001-01-01"), at("1900-01-01"), at("2100-01-01"), 693_595  # days before 1900
    near = feistel(key, "date", F.floor(F.datediff(day, century) / 4297), F.datediff(day, century) % 4297, F.lit(17), F.lit(4297))
    number = F.when(day < century, F.datediff(day, first)).otherwise(F.datediff(day, after) + before)
    far = _let(number, lambda n: feistel(key, "far date", F.floor(n / 21053), n % 21053, F.lit(170), F.lit(21053)))
    there = lambda s: (s["a"] * 21053 + s["b"]).cast("int")
    far = _let(far, lambda s: F.when(there(s) < before, F.date_add(first, there(s))).otherwise(F.date_add(after, there(s) - before)))
    return F.when((day >= century) & (day < after), _let(near, lambda s: F.date_add(century, (s["a"] * 4297 + s["b"]).cast("int")))).otherwise(far)


def kind_of(m: Column) -> Column:
    """Which kind a match is; null if it fails validation."""
    octets = F.forall(F.split(m, "[.]"), lambda x: x.cast("int") <= 255)
    digits = _digits(m)
    ssn = ~m.rlike("^(000|666|9)") & ~m.rlike("-00-") & ~m.rlike("-0000$")
    return (
        F.when(m.contains("@"), "email")
        .when(m.rlike("^[0-9a-fA-F]{32,64}$"), F.when(m.rlike("[a-fA-F]") & m.rlike("[0-9]"), "secret"))
        .when(m.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), F.when(octets, "ip"))
        .when(m.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$|^[0-9]{1,2}[/.][0-9]{1,2}[/.][0-9]{4}$"), F.when(_let(_date_parts(m), _valid_date), "date"))
        .when(m.rlike("^[A-Z]"), F.when(_iban_rest(F.replace(m, F.lit(" "), F.lit(""))) == 1, "iban"))
        .when(m.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), F.when(ssn, "ssn"))
        .when(m.rlike("^[0-9]{13,19}$|^[0-9]{4}([ -])[0-9]{4}\\1[0-9]{4}\\1[0-9]{4}$|^3[47][0-9]{2}([ -])[0-9]{6}\\2[0-9]{5}$"), F.when(_luhn(digits), "card"))
        .otherwise("phone")
    )


def pseudonym(key: str, m: Column, kind: Column) -> Column:
    """The pseudonym of a match; the match itself where kind is null."""
    digest = lambda what: F.sha2(F.concat(F.lit(f"{key}|{what}|"), F.lower(m)).cast("binary"), 256)
    email = F.concat(F.lit("u"), F.left(digest("email"), F.lit(16)), F.substr(m, F.instr(m, "@")))
    secret = F.left(digest("secret"), F.length(m))
    octet = lambda k: _number(F.get(F.split(m, "[.]"), k))
    ip = _let(
        feistel(key, "ip", octet(0) * 256 + octet(1), octet(2) * 256 + octet(3), F.lit(65536), F.lit(65536)),
        lambda s: F.concat_ws(".", F.floor(s["a"] / 256).cast("string"), (s["a"] % 256).cast("string"), F.floor(s["b"] / 256).cast("string"), (s["b"] % 256).cast("string")),
    )

    def date(p: Column) -> Column:
        moved = _let(F.make_date(p["y"], p["m"], p["d"]), lambda day: permuted_day(key, day))
        dot = F.regexp_extract(m, "[-/.]", 0)
        part = lambda d, *fields: F.concat(*(x for f in fields for x in (dot, F.date_format(d, f)))).substr(2, 10)
        turned = lambda d: F.when(p["form"] == 0, part(d, "yyyy", "MM", "dd")).when(p["form"] == 1, part(d, "MM", "dd", "yyyy")).otherwise(part(d, "dd", "MM", "yyyy"))
        return _let(moved, turned)

    def iban(code: Column) -> Column:
        land = F.left(code, F.lit(2))
        check = lambda b: F.lpad((98 - _iban_rest(F.concat(land, F.lit("00"), b))).cast("string"), 2, "0")
        return _let(permuted_code(key, "iban", F.substr(code, F.lit(5))), lambda b: _refilled(m, F.concat(land, check(b), b), "^[0-9A-Z]$"))

    ssn = _let(
        feistel(key, "ssn", _ssn_area(F.left(m, F.lit(3)).cast("int")), (F.substring(m, 5, 2).cast("int") - 1) * 9999 + F.right(m, F.lit(4)).cast("int") - 1, F.lit(898), F.lit(99 * 9999)),
        lambda s: F.concat_ws("-", F.lpad((s["a"] + 1 + (s["a"] >= 665).cast("int")).cast("string"), 3, "0"), F.lpad((F.floor(s["b"] / 9999) + 1).cast("string"), 2, "0"), F.lpad((s["b"] % 9999 + 1).cast("string"), 4, "0")),
    )

    def card(d: Column) -> Column:
        body = permuted_digits(key, "card", F.left(d, F.length(d) - 1))
        check = lambda b: F.concat(b, F.get(F.filter(F.array(*(F.lit(str(i)) for i in range(10))), lambda c: _luhn(F.concat(b, c))), 0))
        return _refilled(m, _let(body, check))

    def phone(d: Column) -> Column:
        own = F.least(F.length(d), F.lit(10))
        return _refilled(m, F.concat(F.left(d, F.length(d) - own), permuted_digits(key, "phone", F.right(d, own))))

    return (
        F.when(kind.isNull(), m)
        .when(kind == "email", email)
        .when(kind == "secret", secret)
        .when(kind == "ip", ip)
        .when(kind == "date", _let(_date_parts(m), date))
        .when(kind == "iban", _let(F.replace(m, F.lit(" "), F.lit("")), iban))
        .when(kind == "ssn", ssn)
        .when(kind == "card", _let(_digits(m), card))
        .otherwise(_let(_digits(m), phone))
    )


def _ssn_area(area: Column) -> Column:
    """Areas 001 to 899 without 666, from 0."""
    return area - 1 - (area > 666).cast("int")


def pseudonymised(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """docs with the text rewritten and ``pii``: a map from kind to how many were replaced."""
    t = F.col(f"`{text}`")
    found, pii = free_name(docs, "__found", "pii")
    some = t.rlike("[0-9@]")
    matches = F.when(some, F.transform(F.regexp_extract_all(t, F.lit(PATTERN), F.lit(0)), lambda m: F.struct(m.alias("m"), kind_of(m).alias("k"))))
    marked = docs.withColumn(found, F.filter(matches, lambda x: F.lit(True)))
    names = F.concat(F.transform(F.col(found), lambda x: pseudonym(key, x["m"], x["k"])), F.array(F.lit("")))
    whole = F.array_join(F.zip_with(F.split(t, PATTERN, -1), names, lambda gap, name: F.concat(gap, name)), "")
    fresh = F.when(F.size(F.coalesce(F.col(found), F.array())) > 0, whole).otherwise(t)
    n = lambda kind: F.coalesce(F.size(F.filter(F.col(found), lambda x: x["k"] == kind)), F.lit(0))
    counts = F.create_map(*(c for kind in KINDS for c in (F.lit(kind), n(kind))))
    return marked.select(*(fresh.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns), counts.alias(pii))


def report(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, the number replaced of each kind, n_replaced, and the text with pseudonyms."""
    out = pseudonymised(docs.select("doc_id", "text"), key)
    counts = [F.col("pii")[kind].alias(f"n_{kind}") for kind in KINDS]
    total = sum((F.col("pii")[kind] for kind in KINDS), F.lit(0))
    return out.select("doc_id", *counts, total.alias("n_replaced"), "text")
