"""Operator 10: format-preserving Feistel pseudonyms for personal data (native).

Numbers and dates are found by pattern, validated (Luhn, octet ranges, calendar, SSN ranges) and replaced by a keyed
permutation of themselves inside their own format: a card number stays a valid card number of the same length and
grouping, a date stays a date of the same notation. Equal values get equal pseudonyms in every document, different
values of one format different ones, and nobody without the key can go back.

Two networks do the work, both over SHA-256 round functions:

* ``feistel_pair``: a pair of mixed-radix integers (a < A, b < B), a permutation of exactly A * B values; dates are ranked
  among the strings of their notation (separator, width of day and month; slashes read either way) and walk on from days that a
  year doesn't have, so every notation is permuted one to one;
* ``feistel_text``: the characters of a string, every one shifted inside its own alphabet (digits, lower, upper or
  hexadecimal); other characters stay, so separators and shape are kept.

Digit strings that fail their validation are no personal data and stay as they are.
Rows: null text stays null, empty text empty, texts without a match are returned unchanged; every row and every other
column is kept as it is. Very long texts are processed whole. An empty table gives an empty result.
"""

from __future__ import annotations

import calendar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revidence.functions.columns import computed
from revidence.llm.common import bound

ROUNDS = 8
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_HEX = ("0123456789abcdef", "ABCDEF")

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: kind -> pattern of candidates; the order is that of precedence where two could start at one place.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._+-])[A-Za-z0-9._+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "iso_date": r"(?<![\d-])\d{4}-\d{2}-\d{2}(?![\d-])",
    "date": r"(?<![\d./])\d{1,2}(?:/\d{1,2}/|\.\d{1,2}\.)\d{4}(?!\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "phone": r"(?:(?<![\w+])\+?1[ .-]?|(?<![\w+]))\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?!\d)|(?<![\d-])\d{3}-\d{3}-\d{4}(?![\d-])|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\d)",
    "card": r"(?<!\d)(?:\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{4}[ -]\d{6}[ -]\d{5})(?!\d)",
    "secret": r"(?<=(?:[Tt]oken|TOKEN|[Ss]ecret|SECRET|[Pp]assword|PASSWORD|[Kk]ey|KEY) {0,2}[=:] {0,2}[\"']?)[0-9a-fA-F]{16,128}(?![0-9a-zA-Z])",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Dates are permuted inside windows of YEARS years counted from YEAR0, from FIRST_YEAR to LAST_YEAR.
YEARS, YEAR0, FIRST_YEAR, LAST_YEAR = 200, 1900, 100, 9899
#: Steps of a date's walk at most; a step lands on a day its year doesn't have in under 1 of 100 cases.
WALK = 32


def _prf(key: str, tweak: str | Column, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), *[p.cast("string") for p in parts]), 256)


def _number(hexed: Column) -> Column:
    return F.conv(hexed, 16, 10).cast("bigint")


def feistel_pair(a: Column, A: int, b: Column, B: int | Column, *, key: str, tweak: str | Column) -> Column:
    """struct(a, b): keyed permutation of the pairs with 0 <= a < A and 0 <= b < B."""
    start = F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b"))

    def step(s: Column, i: Column) -> Column:
        add = _number(F.substring(_prf(key, tweak, i, F.when(i % 2 == 0, s.b).otherwise(s.a)), 1, 14))
        return bound(add, lambda x: F.struct(F.when(i % 2 == 0, F.pmod(s.a + x, F.lit(A))).otherwise(s.a).alias("a"),
                                             F.when(i % 2 == 0, s.b).otherwise(F.pmod(s.b + x, F.lit(B))).alias("b")))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def _shift(c: Column, by: Column, alphabets: tuple[str, ...]) -> Column:
    out = c
    for a in reversed(alphabets):
        at = F.position(c, F.lit(a))
        out = F.when(at > 0, F.substring(F.lit(a), (F.pmod(at - 1 + by, F.lit(len(a))) + 1).cast("int"), F.lit(1))).otherwise(out)
    return out


def feistel_text(s: Column, *, key: str, tweak: str, alphabets: tuple[str, ...] = (_DIGITS, _LOWER, _UPPER)) -> Column:
    """Keyed permutation of the strings of one shape: characters move inside their alphabet, others stay."""
    def shifted(half: Column, stream: Column) -> Column:
        n = F.length(half)
        by = lambda j: _number(F.substring(stream, ((j - 1) % 16 * 4 + 1).cast("int"), F.lit(4)))
        return F.when(n == 0, half).otherwise(F.array_join(F.transform(
            F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda j: _shift(F.substring(half, j, F.lit(1)), by(j), alphabets)), ""))

    def step(t: Column, i: Column) -> Column:
        h = F.floor(F.length(t) / 2).cast("int")
        left, right = F.substring(t, F.lit(1), h), F.substring(t, h + 1, F.length(t))
        even = i % 2 == 0
        stream = _prf(key, tweak, F.length(t), i, F.when(even, right).otherwise(left))
        return bound(stream, lambda x: F.when(even, F.concat(shifted(left, x), right)).otherwise(F.concat(left, shifted(right, x))))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), s, step)


def luhn_sum(digits: Column, *, doubled_first: bool) -> Column:
    """Luhn sum from the right; the rightmost digit is doubled when the check digit is still missing."""
    n = F.length(digits)

    def add(acc: Column, j: Column) -> Column:
        d = F.substring(digits, n - j + 1, F.lit(1)).cast("int")
        twice = (j % 2 == 1) if doubled_first else (j % 2 == 0)
        return acc + F.when(twice, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)
    return F.when(n == 0, F.lit(0)).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), add))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, r"[^0-9]", "")


def card(m: Column, key: str) -> Column:
    """Null unless the digits pass Luhn; the first digit stays, the check digit is made anew."""
    def made(t: Column) -> Column:
        head = F.concat(F.substring(m, 1, 1), t)
        return F.concat(head, F.pmod(10 - luhn_sum(_digits(head), doubled_first=True) % 10, F.lit(10)).cast("string"))
    inner = feistel_text(F.substring(m, F.lit(2), F.length(m) - 2), key=key, tweak="card")
    return F.when(luhn_sum(_digits(m), doubled_first=False) % 10 == 0, bound(inner, made))


def phone(m: Column, key: str) -> Column:
    """Null unless there are 8 to 15 digits; the country prefix stays."""
    prefix = F.regexp_extract(m, r"^(\+?1[ .-]?(?=\()|\+\d{1,3})", 1)
    n = F.length(_digits(m))
    return F.when((n >= 8) & (n <= 15), F.concat(prefix, feistel_text(F.substring(m, F.length(prefix) + 1, F.length(m)), key=key, tweak="phone")))


def ip(m: Column, key: str) -> Column:
    o = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))
    out = bound(o, lambda o: feistel_pair(o[0] * 256 + o[1], 1 << 16, o[2] * 256 + o[3], 1 << 16, key=key, tweak="ip"))
    return bound(out, lambda s: F.concat_ws(".", F.shiftright(s.a, 8).cast("string"), (s.a % 256).cast("string"), F.shiftright(s.b, 8).cast("string"), (s.b % 256).cast("string")))


def ssn(m: Column, key: str) -> Column:
    """Null unless area, group and serial are ones that are given out."""
    part = lambda i, n: F.substring(m, i, n).cast("int")
    area, group, serial = part(1, 3), part(5, 2), part(8, 4)
    ok = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    index = area - F.when(area > 666, 2).otherwise(1)
    out = feistel_pair(index * 99 + group - 1, 898 * 99, serial - 1, 9999, key=key, tweak="ssn")

    def text(s: Column) -> Column:
        i = F.floor(s.a / 99)
        return F.format_string("%03d-%02d-%04d", (i + F.when(i >= 665, 2).otherwise(1)).cast("int"), (s.a % 99 + 1).cast("int"), (s.b + 1).cast("int"))
    return F.when(ok, bound(out, text))


def days(slash: bool, first: int, second: int) -> tuple[list[int], int]:
    """Codes 100 * a + b of the days that a notation of ``first`` and ``second`` digits can write, those of leap years alone last, and
    how many every year has. a is the day and b the month; with slashes also the other way round."""
    def of(year: int) -> set[int]:
        pairs = {(d, m) for m in range(1, 13) for d in range(1, calendar.monthrange(year, m)[1] + 1)}
        pairs |= {(m, d) for d, m in pairs} if slash else set()
        return {100 * a + b for a, b in pairs if a < 10 ** first and b < 10 ** second}
    common, leap = of(2001), of(2004)
    return sorted(common) + sorted(leap - common), len(common)


def date(m: Column, key: str) -> Column:
    """Null unless a date of the calendar in years FIRST_YEAR to LAST_YEAR; else another date of the same notation."""
    iso = F.instr(m, "-") > 0
    part = F.split(m, r"[-/.]")
    a, b, year = F.when(iso, part[2]).otherwise(part[0]), part[1], F.when(iso, part[0]).otherwise(part[2]).cast("int")
    mark = F.when(iso, "-").when(F.instr(m, "/") > 0, "/").otherwise(".")
    codes, every = F.lit(None).cast("array<int>"), F.lit(None).cast("int")
    for slash in (True, False):
        for first in (1, 2):
            for second in (1, 2):
                known, n = days(slash, first, second)
                here = ((mark == "/") == slash) & (F.length(a) == first) & (F.length(b) == second)
                codes, every = F.when(here, F.lit(known)).otherwise(codes), F.when(here, F.lit(n)).otherwise(every)

    def moved(t: Column) -> Column:
        there = lambda s: (s.b < t.every) | F.when(((t.year0 + s.a) % 100 == 0), (t.year0 + s.a) % 400 == 0).otherwise((t.year0 + s.a) % 4 == 0)
        start = F.struct((t.year - t.year0).cast("bigint").alias("a"), t.rank.alias("b"))

        def walk(s: Column, i: Column) -> Column:
            step = feistel_pair(s.a, YEARS, s.b, F.size(t.codes), key=key, tweak=F.concat(F.lit("date"), t.shape))
            return F.when((i == 0) | ~there(s), step).otherwise(s)

        def text(s: Column) -> Column:
            code, y = F.element_at(t.codes, (s.b + 1).cast("int")), F.lpad((t.year0 + s.a).cast("string"), 4, "0")
            x = F.lpad(F.floor(code / 100).cast("string"), F.length(t.a), F.lit("0"))
            z = F.lpad((code % 100).cast("string"), F.length(t.b), F.lit("0"))
            return F.when(t.mark == "-", F.concat_ws("-", y, z, x)).otherwise(F.concat(x, t.mark, z, t.mark, y))
        new = F.aggregate(F.sequence(F.lit(0), F.lit(WALK - 1)), start, walk)
        return F.when((t.rank >= 0) & t.year.between(FIRST_YEAR, LAST_YEAR) & there(start), bound(new, text))
    parsed = F.struct(a.alias("a"), b.alias("b"), year.alias("year"), (F.floor((year - YEAR0) / YEARS) * YEARS + YEAR0).alias("year0"), mark.alias("mark"),
                      F.concat(mark, F.length(a).cast("string"), F.length(b).cast("string")).alias("shape"), codes.alias("codes"), every.alias("every"))
    ranked = bound(parsed, lambda t: F.struct(*[t[c].alias(c) for c in ("a", "b", "year", "year0", "mark", "shape", "codes", "every")],
                                              (F.array_position(t.codes, t.a.cast("int") * 100 + t.b.cast("int")) - 1).alias("rank")))
    return bound(ranked, moved)


def email(m: Column, key: str) -> Column:
    """The mailbox is permuted, the domain stays."""
    return F.concat(feistel_text(F.substring_index(m, "@", 1), key=key, tweak="email"), F.lit("@"), F.substring_index(m, "@", -1))


def pseudonym(m: Column, key: str) -> Column:
    """struct(kind, value): the pseudonym of one match; kind null and the match itself if it fails its validation."""
    is_ = lambda kind: m.rlike(rf"^(?:{PATTERNS[kind]})$")
    found = [("email", F.instr(m, "@") > 0, email(m, key)), ("date", is_("iso_date") | is_("date"), date(m, key)),
             ("ssn", is_("ssn"), ssn(m, key)), ("ip", is_("ip"), ip(m, key)), ("card", is_("card"), card(m, key)), ("phone", is_("phone"), phone(m, key)),
             ("secret", F.lit(True), feistel_text(m, key=key, tweak="secret", alphabets=_HEX))]
    out = F.struct(F.lit(None).cast("string").alias("kind"), m.alias("value"))

    def named(kind: str, value: Column) -> Column:
        return bound(value, lambda v: F.struct(F.when(v.isNotNull(), F.lit(kind)).alias("kind"), F.coalesce(v, m).alias("value")))
    for kind, test, value in reversed(found):
        out = F.when(test, named(kind, value)).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, *, key: str, text: str = "text") -> DataFrame:
    """``docs`` with the personal data of column ``text`` replaced; added column ``pii_kinds``: array of the kinds replaced, in order."""
    t = F.col(text)
    hits = F.when(t.rlike(r"[0-9@]"), F.regexp_extract_all(t, F.lit(ANY), F.lit(0)))
    rows = computed(docs, __hits=hits)
    rows = computed(rows, __found=F.when(F.size("__hits") > 0, F.transform("__hits", lambda m: pseudonym(m, key))))
    parts = F.zip_with(F.split(t, ANY, -1), F.col("__found"), lambda gap, f: F.concat(gap, F.coalesce(f.value, F.lit(""))))
    new = F.when(F.col("__found").isNull(), t).otherwise(F.array_join(parts, ""))
    kinds = F.coalesce(F.filter(F.transform("__found", lambda f: f.kind), lambda k: k.isNotNull()), F.array().cast("array<string>"))
    return rows.select(*[new.alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns], kinds.alias("pii_kinds"))
