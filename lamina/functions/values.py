"""Element commands over the values of one scope visit.

Every function takes a Column of ARRAY<STRING>, the values in document order, and gives a
Column. Values that aren't integers drop out of numeric commands; a command without a
value gives NULL, unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
FULL_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def present(a: Column) -> Column:
    """Values that aren't empty."""
    return F.filter(a, lambda x: x.isNotNull() & (x != ""))


def ints(a: Column) -> Column:
    """Values that are whole integers, optional sign and digits only, as BIGINT."""
    return F.filter(F.transform(a, as_int), lambda x: x.isNotNull())


def as_int(x: Column) -> Column:
    return F.when(x.rlike("^[+-]?[0-9]+$"), x.try_cast("bigint"))


def each(a: Column, f) -> Column:
    return F.transform(present(a), f)


def _some(a: Column, value: Column) -> Column:
    return F.when(F.size(a) > 0, value)


# -- whole values -----------------------------------------------------------------------


def element(a: Column, sep: str = "\t") -> Column:
    p = present(a)
    return _some(p, F.array_join(p, sep))


def first(a: Column) -> Column:
    return F.try_element_at(present(a), F.lit(1))


def last(a: Column) -> Column:
    return F.try_element_at(present(a), F.lit(-1))


def backward(a: Column) -> Column:
    return F.reverse(present(a))


def encode(a: Column) -> Column:
    def one(x: Column) -> Column:
        for plain, coded in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&#39;"), ('"', "&#34;")):
            x = F.replace(x, F.lit(plain), F.lit(coded))
        return x

    return each(a, one)


def decode(a: Column) -> Column:
    """Base64 values decoded; those that can't be are dropped."""
    out = F.transform(present(a), lambda x: F.try_to_binary(x, F.lit("base64")).cast("string"))
    return F.filter(out, lambda x: x.isNotNull())


def upper(a: Column) -> Column:
    return each(a, F.upper)


def lower(a: Column) -> Column:
    return each(a, F.lower)


def chain(a: Column) -> Column:
    return each(a, lambda x: F.replace(x, F.lit(" "), F.lit("_")))


def title(a: Column) -> Column:
    """Title case; a word begins after any character that isn't a letter or digit, an
    apostrophe aside."""

    def one(x: Column) -> Column:
        parts = F.regexp_extract_all(F.lower(x), F.lit(r"([\p{L}\p{Nd}']+|[^\p{L}\p{Nd}']+)"), F.lit(1))
        return F.array_join(F.transform(parts, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w)))), "")

    return each(a, one)


def mirror(a: Column) -> Column:
    return each(a, F.reverse)


def alnum(a: Column) -> Column:
    return present(F.transform(a, lambda x: F.trim(F.regexp_replace(x, "[^A-Za-z0-9]+", " "))))


def order(a: Column) -> Column:
    """Words sorted: commas and semicolons go, hyphens are spaces; a single word stays."""

    def one(x: Column) -> Column:
        plain = F.lower(F.regexp_replace(x, "[,;]", ""))
        words = F.array_join(F.array_sort(F.filter(F.split(F.translate(plain, "-", " "), " "), lambda w: w != "")), " ")
        return F.regexp_replace(F.when(plain.rlike("[ -]"), words).otherwise(plain), "[.?:]+$", "")

    return each(a, one)


def year(a: Column) -> Column:
    """First run of just four digits, in the first value that has one."""
    found = F.transform(a, lambda x: F.try_element_at(F.filter(F.regexp_extract_all(x, F.lit("([0-9]+)"), F.lit(1)), lambda d: F.length(d) == 4), F.lit(1)))
    return F.try_element_at(F.filter(found, lambda x: x.isNotNull()), F.lit(1))


def _month(w: Column) -> Column:
    names = [x for i, (s, f) in enumerate(zip(MONTHS, FULL_MONTHS, strict=True), 1) for n in dict.fromkeys((s, f)) for x in (F.lit(n), F.lit(i))]
    return F.try_element_at(F.create_map(*names), F.lower(w))


def month(a: Column) -> Column:
    """1 to 12: the first run of letters that names a month, in the first value that has one."""
    found = F.transform(a, lambda x: F.try_element_at(F.filter(F.transform(F.regexp_extract_all(x, F.lit(r"(\p{L}+)"), F.lit(1)), _month), lambda m: m.isNotNull()), F.lit(1)))
    return F.try_element_at(F.filter(found, lambda x: x.isNotNull()), F.lit(1))


def date(y: Column, m: Column, d: Column, sep: str = "/") -> Column:
    """YYYY, YYYY/MM or YYYY/MM/DD from parts, months by number or name."""
    number = F.coalesce(as_int(m).cast("string"), _month(m).cast("string"))
    two = lambda x: F.lpad(x, 2, "0")
    return F.when(y.rlike("^[0-9]{4}$"), F.concat_ws(sep, y, two(number), F.when(number.isNotNull(), two(as_int(d).cast("string")))))


def page(a: Column) -> Column:
    return present(F.transform(a, lambda x: F.regexp_extract(x, r"([\p{L}\p{Nd}]+)", 1)))


def auth(a: Column) -> Column:
    """'Smith-Jones,J.-P.' to 'Smith-Jones JP'."""

    def one(x: Column) -> Column:
        name, initials = F.regexp_extract(x, "^([^,]*)", 1), F.regexp_extract(x, ",(.*)$", 1)
        return F.trim(F.concat(name, F.lit(" "), F.regexp_replace(initials, "[^A-Za-z]", "")))

    return each(a, one)


def initials(a: Column) -> Column:
    def one(x: Column) -> Column:
        parts = F.filter(F.split(x, "[ .-]+"), lambda p: p != "")
        return F.when(x.rlike("^[A-Z]{2}$"), x).otherwise(F.upper(F.array_join(F.transform(parts, lambda p: F.substring(p, 1, 1)), "")))

    return each(a, one)


def journal(a: Column) -> Column:
    """Journal titles without periods and surplus spaces."""
    return each(a, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"[.,:;]", " "), " +", " ")))


def mapped(a: Column, table: dict[str, str], default: str | None = None) -> Column:
    """Values by exact key; others take the default, or drop."""
    lookup = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    out = F.transform(present(a), lambda x: F.coalesce(F.try_element_at(lookup, x), F.lit(default)))
    return F.filter(out, lambda x: x.isNotNull())


def trim(a: Column) -> Column:
    """Outer white space and one leading zero go; '0' is left of nothing."""

    def one(x: Column) -> Column:
        y = F.regexp_replace(F.regexp_replace(x, r"^\s+|\s+$", ""), "^0", "")
        return F.when(y == "", F.lit("0")).otherwise(y)

    return each(a, one)


def doi(a: Column) -> Column:
    def one(x: Column) -> Column:
        bare = F.regexp_replace(F.trim(x), r"^(https?://)?(dx\.)?(doi\.org/)?(doi:)? */?", "")
        return F.concat(F.lit("https://doi.org/"), F.replace(F.replace(F.url_encode(bare), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~")))

    return each(a, one)


def replace(a: Column, pattern: str, by: str) -> Column:
    return each(a, lambda x: F.regexp_replace(x, pattern, by))


def accented(a: Column) -> Column:
    return F.filter(present(a), lambda x: x.rlike(r"[^\x00-\x7F]"))


def invisible(a: Column) -> Column:
    """Labels of values with combining accents or invisible characters."""
    label = lambda x: F.when(x.rlike(r"\p{Mn}"), "combining").when(x.rlike(r"[­​-‏⁠﻿]"), "invisible")
    return F.filter(F.transform(present(a), label), lambda x: x.isNotNull())


def scan(a: Column) -> Column:
    return present(F.transform(a, lambda x: F.regexp_extract(x, "([ßβ])", 1)))


# -- numbers ----------------------------------------------------------------------------


def num(a: Column) -> Column:
    return F.size(a)


def inc(a: Column) -> Column:
    return F.transform(ints(a), lambda x: x + 1)


def dec(a: Column) -> Column:
    return F.transform(ints(a), lambda x: x - 1)


#: Which convention a known coordinate field has: first position 0 or 1.
COORDINATES = {"ChrStart": 0, "ChrStop": 0, "SPDI_pos": 0, "INSDInterval_from": 1, "INSDInterval_to": 1, "Hsp_hit-from": 1, "Hsp_hit-to": 1}
STOPS = {"ChrStop", "INSDInterval_to", "Hsp_hit-to"}


def based(a: Column, field: str, to: str) -> Column:
    """Coordinates of a known field as 'zero', 'one' or 'ucsc' (half-open) positions;
    decided when the plan is made."""
    now = COORDINATES[field]
    want = {"zero": 0, "one": 1, "ucsc": 1 if field in STOPS else 0}[to]
    return F.transform(ints(a), lambda x: x + (want - now))


def length(a: Column) -> Column:
    """Bytes of all values."""
    p = present(a)
    return _some(p, F.aggregate(F.transform(p, lambda x: F.octet_length(x).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x))


def total(a: Column) -> Column:
    i = ints(a)
    return _some(i, F.aggregate(i, F.lit(0).cast("long"), lambda s, x: s + x))


def running(a: Column) -> Column:
    i = ints(a)
    step = lambda s, x: F.concat(s, F.array(F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(0).cast("long")) + x))
    return F.aggregate(i, F.array().cast("array<bigint>"), step)


def least(a: Column) -> Column:
    return F.array_min(ints(a))


def greatest(a: Column) -> Column:
    return F.array_max(ints(a))


def _two(a: Column, f) -> Column:
    i = ints(a)
    return F.when(F.size(i) == 2, f(F.try_element_at(i, F.lit(1)), F.try_element_at(i, F.lit(2))))


def sub(a: Column) -> Column:
    return _two(a, lambda x, y: x - y)


def mul(a: Column) -> Column:
    return _two(a, lambda x, y: x * y)


def div(a: Column) -> Column:
    """Quotient truncated toward zero; nothing for a zero divisor."""
    return _two(a, lambda x, y: F.when(y != 0, F.call_function("div", x, F.when(y != 0, y))))


def mod(a: Column) -> Column:
    return _two(a, lambda x, y: F.when(y != 0, x % F.when(y != 0, y)))


def avg(a: Column) -> Column:
    """Mean, truncated toward zero."""
    i = ints(a)
    return _some(i, (F.aggregate(i, F.lit(0).cast("long"), lambda s, x: s + x) / F.size(i)).cast("long"))


def dev(a: Column) -> Column:
    """Sample standard deviation of two or more values, truncated."""
    i = ints(a)
    n = F.size(i).cast("long")
    add = lambda f: F.aggregate(i, F.lit(0).cast("long"), lambda s, x: s + f(x))
    # from exact sums, so that whole results aren't lost to rounding
    square = (n * add(lambda x: x * x) - add(lambda x: x) * add(lambda x: x)) / F.nullif(n * (n - 1), F.lit(0))
    return F.when(n > 1, F.sqrt(square).cast("long"))


def med(a: Column) -> Column:
    """Element n/2 of the sorted values: the upper median."""
    i = F.array_sort(ints(a))
    return F.try_element_at(i, (F.floor(F.size(i) / 2) + 1).cast("int"))


def logarithm(a: Column, base: str) -> Column:
    """Truncated logarithms of positive values; base '2', 'e' or '10'."""
    f = {"2": F.log2, "e": F.ln, "10": F.log10}[base]
    return F.transform(F.filter(ints(a), lambda x: x > 0), lambda x: f(x).cast("long"))


def _signed(a: Column, f) -> Column:
    return F.transform(ints(a), lambda x: F.concat(F.when(x < 0, "-").otherwise(""), f(F.abs(x))))


def binary(a: Column) -> Column:
    return _signed(a, F.bin)


def octal(a: Column) -> Column:
    return _signed(a, lambda x: F.conv(x.cast("string"), 10, 8))


def hexadecimal(a: Column) -> Column:
    return _signed(a, F.hex)


def bits(a: Column) -> Column:
    return F.transform(ints(a), lambda x: F.bit_count(x))


def pad(a: Column) -> Column:
    return each(a, lambda x: F.when(x.rlike("^[0-9]+$") & (F.length(x) < 8), F.lpad(x, 8, "0")).otherwise(x))


# -- ranges -----------------------------------------------------------------------------


def slice_range(x: Column, low: Column, high: Column) -> Column:
    """Characters low to high, from 1, both included; NULL unless all lie inside. A
    negative bound counts from the right end."""
    low, high = low.cast("int"), high.cast("int")
    n = F.length(x)
    hi = F.when(high < 0, n + high).otherwise(high)
    lo = F.when(low < 0, n + low + 1).otherwise(low)
    return F.when((lo >= 1) & (hi >= lo) & (hi <= n), x.substr(lo, hi - lo + 1))


def between(x: Column, after: str | None = None, before: str | None = None) -> Column:
    """Text after the first `after` and before the next `before`, in either case; NULL if
    one that is given is missing."""
    if after:
        at = F.locate(after.upper(), F.upper(x))
        x = F.when(at > 0, x.substr(at + len(after), F.length(x)))
    if before:
        at = F.locate(before.upper(), F.upper(x))
        x = F.when(at > 0, x.substr(F.lit(1), at - 1))
    return x


# -- conditions -------------------------------------------------------------------------


def any_value(a: Column, test) -> Column:
    return F.coalesce(F.exists(a, test), F.lit(False))


def equals(a: Column, c: str) -> Column:
    return any_value(a, lambda v: F.upper(v) == c.upper())


def contains(a: Column, c: str) -> Column:
    return any_value(a, lambda v: F.upper(v).contains(c.upper()))


def includes(a: Column, c: str) -> Column:
    """A whole word or words, bounded by spaces."""
    return any_value(a, lambda v: F.concat(F.lit(" "), F.upper(v), F.lit(" ")).contains(f" {c.upper()} "))


def is_within(a: Column, c: str) -> Column:
    return any_value(a, lambda v: F.lit(c.upper()).contains(F.upper(v)))


def starts_with(a: Column, c: str) -> Column:
    return any_value(a, lambda v: F.upper(v).startswith(c.upper()))


def ends_with(a: Column, c: str) -> Column:
    return any_value(a, lambda v: F.upper(v).endswith(c.upper()))


def is_not(a: Column, c: str) -> Column:
    """Some value differs."""
    return any_value(a, lambda v: F.upper(v) != c.upper())


def is_before(a: Column, c: str) -> Column:
    return any_value(a, lambda v: F.upper(v) < c.upper())


def is_after(a: Column, c: str) -> Column:
    return any_value(a, lambda v: F.upper(v) > c.upper())


def matches(a: Column, c: str) -> Column:
    plain = lambda x: F.upper(F.regexp_replace(F.regexp_replace(x, "[,;]", ""), "[.?:]+$", ""))
    return any_value(a, lambda v: plain(v) == plain(F.lit(c)))


def resembles(a: Column, c: str) -> Column:
    return any_value(order(a), lambda v: v == F.element_at(order(F.array(F.lit(c))), 1))


def is_equal_to(a: Column, b: Column) -> Column:
    """Some value equals the last value of another element, case aside."""
    other = last(b)
    return other.isNotNull() & any_value(a, lambda v: F.upper(v) == F.upper(other))


def differs_from(a: Column, b: Column) -> Column:
    """Some value isn't the last value of another element, case aside."""
    other = last(b)
    return other.isNotNull() & any_value(a, lambda v: F.upper(v) != F.upper(other))


def compare(a: Column, op: str, right: Column) -> Column:
    """gt ge lt le eq ne between integers; false where either side isn't one."""
    test = {"gt": lambda v, r: v > r, "ge": lambda v, r: v >= r, "lt": lambda v, r: v < r, "le": lambda v, r: v <= r, "eq": lambda v, r: v == r, "ne": lambda v, r: v != r}[op]
    r = as_int(right.cast("string"))
    return F.coalesce(F.exists(ints(a), lambda v: test(v, r)), F.lit(False))


def threshold(first: Column, also: list[Column] = (), either: list[Column] = ()) -> Column:
    """-if first -and each of also -or each of either: as many hits as there are tests
    joined by and, wherever they fall."""
    hits = sum((F.coalesce(c, F.lit(False)).cast("int") for c in (first, *also, *either)), F.lit(0))
    return hits >= 1 + len(also)


def unless(*tests: Column) -> Column:
    """Rejects if any test holds."""
    out = F.lit(True)
    for t in tests:
        out = out & ~F.coalesce(t, F.lit(False))
    return out


def matrix(a: Column) -> Column:
    """All ordered pairs of values at different places."""
    p = present(a)
    pair = F.transform(p, lambda x, i: F.transform(F.filter(F.transform(p, lambda y, j: F.struct(j.alias("j"), y.alias("y"))), lambda s: s["j"] != i), lambda s: F.struct(x.alias("left"), s["y"].alias("right"))))
    return F.flatten(pair)
