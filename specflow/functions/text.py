"""Text helpers that follow Unicode whitespace and never truncate on padding."""

from __future__ import annotations

import re
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: every character that counts as white space (Unicode separators and ASCII controls).
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def trim(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


# Anything outside printable ASCII: a cheap test that no odd white space can pass.
ODD_SPACE = "[^ -~]"


def has_odd_space(c: Column) -> Column:
    return c.rlike(ODD_SPACE)


def trim_known(c: Column, odd: Column) -> Column:
    """``trim`` for a piece of a line already searched for odd white space: the plain trim is far cheaper."""
    return F.when(odd, trim(c)).otherwise(F.trim(c))


def trim_leading(c: Column) -> Column:
    return F.ltrim(c, F.lit(WHITESPACE))


def trim_trailing(c: Column) -> Column:
    return F.rtrim(c, F.lit(WHITESPACE))


def is_blank(c: Column) -> Column:
    """True for null, empty or white-space-only text; never null."""
    return F.coalesce(trim(c) == "", F.lit(True))


def pad_left(c: Column, width: int, char: str = "0") -> Column:
    return F.when(F.length(c) < width, F.lpad(c, width, char)).otherwise(c)


def pad_right(c: Column, width: int, char: str = " ") -> Column:
    return F.when(F.length(c) < width, F.rpad(c, width, char)).otherwise(c)


def full_match(c: Column, pattern: str) -> Column:
    return c.rlike(rf"\A(?:{pattern})\z")


# Fixed value: plain or exponent decimal notation.
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def is_number(c: Column) -> Column:
    return c.rlike(NUMBER)


def _digits(c: Column) -> tuple[Column, Column, Column]:
    """(negative, point, digits) of a number's text: the value is 0.digits times ten to the point.

    Digits have no zeros at either end and are empty for zero.
    """
    whole = F.regexp_extract(c, r"^[+-]?(\d*)", 1)
    both = F.concat(whole, F.regexp_extract(c, r"\.(\d*)", 1))
    power = F.coalesce(F.regexp_extract(c, r"[eE]([+-]?\d+)$", 1).try_cast("bigint"), F.lit(0))
    short = F.ltrim(both, F.lit("0"))
    return F.startswith(c, F.lit("-")), F.length(whole) + power + F.length(short) - F.length(both), F.rtrim(short, F.lit("0"))


def _order(c: Column, bound: str) -> Column:
    """-1, 0 or 1 as the number in the text is below, at or above the bound, whatever its length."""
    sign, figures, exponent = Decimal(bound).as_tuple()
    whole = "".join(map(str, figures)).lstrip("0")
    own, point = whole.rstrip("0"), len(whole) + exponent
    side = 0 if not own else -1 if sign else 1
    minus, at, digits = _digits(c)
    here = F.when(digits == "", 0).when(minus, -1).otherwise(1)
    size = F.when(at != point, F.signum(at - F.lit(point))).when(digits < own, -1).when(digits > own, 1).otherwise(0)
    return F.when(here != side, F.signum(here - F.lit(side))).otherwise(here * size)


# Numbers of this shape fit a decimal without loss.
SHORT = r"^[+-]?\d{1,27}(\.\d{1,10})?$"


def compare_number(c: Column, op: str, bound: str) -> Column:
    """Exact comparison of a number's text with a bound; null when the text is no number.

    Short plain numbers compare as decimals, all others by their digits.
    """
    ops = {
        "<": lambda a, b: a < b,
        "<=": lambda a, b: a <= b,
        ">": lambda a, b: a > b,
        ">=": lambda a, b: a >= b,
    }
    verdict = ops[op](_order(c, bound), F.lit(0))
    if re.match(SHORT, bound):
        near = ops[op](c.try_cast("decimal(38,10)"), F.lit(bound).cast("decimal(38,10)"))
        return F.when(c.rlike(SHORT), near).when(is_number(c), verdict)
    return F.when(is_number(c), verdict)


# Fixed value: notation that already is canonical.
CANONICAL = r"^-?(0|[1-9]\d*)(\.\d+)?$"

#: exponents beyond this stay as they are; written out they would fill pages
LARGEST_EXPONENT = 400


def is_canonical(c: Column) -> Column:
    return c.rlike(CANONICAL)


def decimal_text(c: Column) -> Column:
    """Plain decimal notation: no plus sign, no extra leading zeros, source scale kept.

    Exponents are written out by moving the point, without zeros at the end of the fraction.
    """
    plain = F.regexp_replace(c, r"^\+", "")
    plain = F.regexp_replace(plain, r"^(-?)0+(?=\d)", "$1")
    plain = F.regexp_replace(plain, r"^(-?)\.", "$10.")
    plain = F.regexp_replace(plain, r"\.$", "")
    minus, point, digits = _digits(c)
    point = point.cast("int")
    size = F.length(digits)
    moved = (
        F.when(digits == "", "0")
        .when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
        .when(point >= size, F.concat(digits, F.repeat(F.lit("0"), point - size)))
        .otherwise(F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, size)))
    )
    moved = F.concat(F.when(minus & (digits != ""), "-").otherwise(""), moved)
    far = F.abs(F.coalesce(F.regexp_extract(c, r"[eE]([+-]?\d+)$", 1).try_cast("bigint"), F.lit(1 << 40))) > LARGEST_EXPONENT
    return F.when(is_canonical(c), c).when(c.rlike("[eE]"), F.when(far, c).otherwise(moved)).otherwise(plain)
