"""XPath values as typed Spark columns: conversions, comparisons, arithmetic and the string functions.

A value is a column with a kind known when the query is compiled, so that most
conversions cost nothing at run time. Columns are never null. Two profiles: in
``compat``, strings are measured in bytes, arithmetic on non-numbers counts as 0
and comparisons see the first node only; in ``xpath1`` lengths are code points.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as a number: decimal digits with optional sign, fraction and exponent, or a named infinity or NaN; no spaces.
_NUMERIC = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)$|^[+-]?[nN][aA][nN]$"
#: Or hexadecimal digits with a binary exponent.
_HEX = r"^[+-]?0[xX](?=\.?[0-9a-fA-F])([0-9a-fA-F]*)\.?([0-9a-fA-F]*)[pP]([+-]?\d{1,5})$"
#: Hexadecimal digits that a long holds; of longer mantissas the rest only moves the exponent.
_HEX_DIGITS = 15
_WHITE = "[\\t-\\r \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+"


@dataclass(frozen=True)
class Value:
    """``kind`` is str, num, bool or nodes. Of nodes, ``column`` is the first one's string; ``exists`` whether there is one."""

    kind: str
    column: Column
    exists: Column | None = None


def parse_number(s: Column) -> Column:
    """The number that ``s`` spells, or null."""
    plain = F.regexp_replace(F.lower(s), "^([+-]?)inf$", "$1infinity")
    plain = F.when(plain.rlike("nan$"), F.lit("NaN")).otherwise(plain)
    plain = F.when(plain.rlike("infinity$"), F.regexp_replace(plain, "infinity", "Infinity")).otherwise(plain)
    return F.when(s.rlike(_NUMERIC), plain.try_cast("double")).when(s.rlike(_HEX), _parse_hex(s))


def _parse_hex(s: Column) -> Column:
    whole, fraction = F.regexp_extract(s, _HEX, 1), F.regexp_extract(s, _HEX, 2)
    digits = F.regexp_replace(F.concat(whole, fraction), "^0+", "")
    cut = F.greatest(F.length(digits) - _HEX_DIGITS, F.lit(0))
    mantissa = F.coalesce(F.conv(F.substring(digits, 1, _HEX_DIGITS), 16, 10).try_cast("double"), F.lit(0.0))
    power = F.regexp_extract(s, _HEX, 3).cast("int") + 4 * (cut - F.length(fraction))
    return F.when(s.startswith("-"), -1.0).otherwise(1.0) * mantissa * F.pow(F.lit(2.0), power)


def spells_number(text: str) -> bool:
    """Whether a constant counts as a number."""
    return re.search(_NUMERIC, text) is not None or re.search(_HEX, text) is not None


def format_number(x: Column) -> Column:
    """A number without exponent and without a trailing ``.0``."""
    whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
    fixed = F.regexp_replace(x.try_cast("decimal(38,12)").cast("string"), r"\.?0+$", "")
    plain = (F.abs(x) >= 1e-3) & (F.abs(x) < 1e7)
    text = F.when(F.isnan(x), "NaN").when(F.abs(x) == float("inf"), F.when(x > 0, "+Inf").otherwise("-Inf"))
    return text.when(whole, x.try_cast("long").cast("string")).when(plain, x.cast("string")).otherwise(F.coalesce(fixed, x.cast("string")))


def as_string(v: Value) -> Column:
    if v.kind == "num":
        return format_number(v.column)
    return F.when(v.column, "true").otherwise("false") if v.kind == "bool" else v.column


def as_number(v: Value) -> Column:
    """The number, or null if the value spells none."""
    if v.kind == "num":
        return v.column
    return v.column.cast("double") if v.kind == "bool" else parse_number(v.column)


def as_boolean(v: Value) -> Column:
    if v.kind == "bool":
        return v.column
    if v.kind == "nodes":
        return v.exists
    if v.kind == "num":
        return (v.column != 0) & ~F.isnan(v.column)
    return ~v.column.isin("", "false") & F.coalesce(parse_number(v.column) != 0, F.lit(True))


def compare(op: str, a: Value, b: Value) -> Column:
    """Numeric if both sides spell numbers; else equality of strings, and no order. NaN equals nothing."""
    x, y = as_number(a), as_number(b)
    both = x.isNotNull() & y.isNotNull()
    if op in ("=", "!="):
        numeric = (x == y) & ~F.isnan(x) & ~F.isnan(y)
        texts = as_string(a) == as_string(b)
        if a.kind == "num" and b.kind == "num":
            same = numeric
        else:
            same = F.when(both, numeric).otherwise(texts)
        return same if op == "=" else ~same
    order = {"<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[op]
    return F.coalesce(order & ~F.isnan(x) & ~F.isnan(y), F.lit(False))


def arithmetic(op: str, a: Value, b: Value) -> Column:
    """Operands that spell no number, and division by zero, count as 0; ``mod`` takes whole parts and the dividend's sign."""
    x, y = (F.coalesce(as_number(v), F.lit(0.0)) for v in (a, b))
    if op == "+":
        return x + y
    if op == "-":
        return x - y
    if op == "*":
        return x * y
    if op == "div":
        return F.when(y != 0, F.try_divide(x, y)).otherwise(F.lit(0.0))
    n, m = F.coalesce(x.try_cast("long"), F.lit(0)), F.coalesce(y.try_cast("long"), F.lit(0))
    return F.when(m != 0, F.try_mod(n, m).cast("double")).otherwise(F.lit(0.0))


def normalize_space(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, _WHITE, " "))


def substring(s: Column, start: Column, length: Column | None, profile: str) -> Column:
    """From ``start`` (1 is the first, less counts as 1, fractions are dropped), ``length`` bytes or characters at most."""
    first = F.greatest(F.coalesce(start.try_cast("int"), F.lit(1)), F.lit(1))
    size = F.lit(2**31 - 1) if length is None else F.greatest(F.coalesce(length.try_cast("int"), F.lit(0)), F.lit(0))
    if profile == "xpath1":
        return F.substring(s, first, size)
    # a cut inside a character leaves a replacement character, never broken text
    return F.make_valid_utf8(F.substring(s.cast("binary"), first, size).cast("string"))


def string_length(s: Column, profile: str) -> Column:
    return (F.length(s) if profile == "xpath1" else F.octet_length(s)).cast("double")


def substring_before(s: Column, sep: Column) -> Column:
    at = F.position(sep, s)
    return F.when(at > 0, F.substring(s, F.lit(1), at - 1)).otherwise(F.lit(""))


def substring_after(s: Column, sep: Column) -> Column:
    at = F.position(sep, s)
    return F.when(at > 0, F.substring(s, at + F.length(sep), F.length(s))).otherwise(F.lit(""))


def concat(parts: list[Column]) -> Column:
    return reduce(F.concat, parts) if parts else F.lit("")


def unescape_entities(s: Column) -> Column:
    """The predefined entities decoded, each once; for use after a query, never before matching."""
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("nbsp", "\u00a0"), ("amp", "&")):
        s = F.replace(s, F.lit(f"&{name};"), F.lit(char))
    return s
