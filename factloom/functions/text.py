"""String, date and number expressions with null-on-failure rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

_DIGITS = r"\d+(_\d+)*"
_FLOAT = rf"(?i)^[+-]?(({_DIGITS}\.?|({_DIGITS})?\.{_DIGITS})(e[+-]?{_DIGITS})?|inf|infinity|nan)$"
_INT = rf"^[+-]?{_DIGITS}$"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once.

    A lambda repeats every expression that its body mentions for each element;
    a value bound as a lambda variable is computed only when it is bound.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _ends_blank(c: Column) -> Column:
    """The first or last character is white space, or there is none."""
    white = F.lit(WHITE_SPACE)
    return white.contains(F.left(c, F.lit(1))) | white.contains(F.right(c, F.lit(1)))


def strip(c: Column) -> Column:
    """Drop white space of every kind at both ends; ``trim`` knows only the blank.

    Trimming by a set of characters is slow, so it is left to texts that need it.
    """
    return F.when(_ends_blank(c), F.btrim(c, F.lit(WHITE_SPACE))).otherwise(c)


def is_blank(c: Column) -> Column:
    return strip(c) == ""


def present(c: Column) -> Column:
    """Neither null nor empty."""
    return c.isNotNull() & (c != "")


def fill(template: str, **parts: Column) -> Column:
    """``concat`` of the literal pieces of a template and the named columns."""
    pieces, rest = [], template
    while rest:
        head, brace, tail = rest.partition("{")
        if head:
            pieces.append(F.lit(head))
        if not brace:
            break
        name, _, rest = tail.partition("}")
        pieces.append(parts[name])
    return F.concat(*pieces)


def parse_date(c: Column, pattern: str = "yyyy-M-d") -> Column:
    return F.try_to_date(c, pattern)


def parse_two_formats(c: Column) -> Column:
    return F.coalesce(parse_date(c), parse_date(c, "M/d/yyyy"))


def _without_digits(c: Column) -> Column:
    return F.translate(c, "0123456789", "")


def float_or_null(c: Column) -> Column:
    """A decimal number as text to double.

    The cast alone would also take a trailing d or f and hexadecimal digits,
    and would refuse underscores; a cast that fails is slow besides. Digits
    with a sign and a point go to the cast, anything else is tested against
    the full pattern first.
    """
    s = strip(c)
    odd = F.when(s.rlike(_FLOAT), F.replace(s, F.lit("_"), F.lit("")).try_cast("double"))
    plain = _without_digits(c).isin("", ".", "-", "-.", "+", "+.") & (c != "")
    return F.when(plain, c.try_cast("double")).otherwise(odd)


def int_or_null(c: Column) -> Column:
    """A whole number as text to bigint, with the same care."""
    s = strip(c)
    odd = F.when(s.rlike(_INT), F.replace(s, F.lit("_"), F.lit("")).try_cast("bigint"))
    plain = _without_digits(c).isin("", "-", "+") & (c != "")
    return F.when(plain, c.try_cast("bigint")).when(c.contains("_") | _ends_blank(c), odd)


def zero_fill(c: Column, width: int = 10) -> Column:
    """Pad with zeros on the left; longer values stay whole (``lpad`` alone cuts them)."""
    return F.when(F.length(c) >= width, c).otherwise(F.lpad(c, width, "0"))


def without_dashes(c: Column) -> Column:
    return F.replace(c, F.lit("-"), F.lit(""))


def url_segment(c: Column, index: int) -> Column:
    return F.try_element_at(F.split(c, "/"), F.lit(index))


def normalise_name(c: Column) -> Column:
    return F.regexp_replace(c, r"[^A-Za-z0-9_-]", "_")


def slug(c: Column) -> Column:
    squeezed = F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "_")
    return F.btrim(squeezed, F.lit("_"))


def truncate(c: Column, size: int) -> Column:
    return F.when(F.length(c) > size, F.concat(F.left(c, F.lit(size)), F.lit("..."))).otherwise(c)


def float_text(c: Column) -> Column:
    """A double the way Python prints it: 1234567.0, 1e+16, 1e-05."""
    java = c.cast("string")
    size = F.abs(c)
    plain = F.regexp_replace(
        java.try_cast("decimal(38,20)").cast("string"),
        r"(\.\d+?)0+$",
        "$1",
    )
    mantissa = F.regexp_replace(F.substring_index(java, "E", 1), r"\.0$", "")
    exponent = F.substring_index(java, "E", -1).try_cast("int")
    scientific = F.concat(
        mantissa,
        F.lit("e"),
        F.when(exponent < 0, F.lit("-")).otherwise(F.lit("+")),
        F.lpad(F.abs(exponent).cast("string"), 2, "0"),
    )
    return (
        F.when(F.isnan(c), F.lit("nan"))
        .when(size == float("inf"), F.when(c > 0, F.lit("inf")).otherwise(F.lit("-inf")))
        .when(size == 0, java)
        .when((size >= 1e16) | (size < 1e-4), scientific)
        .otherwise(plain)
    )


def two_decimals(c: Column) -> Column:
    """A double with two decimals, rounded from its exact binary value, halves to even.

    Only a value whose shortest form ends in a 5 in the third place can differ
    from rounding the shortest form. There the exact distance of the product
    with 1000 from the next whole number tells the side; the error that the
    product made is split off without loss.
    """
    split = F.lit(134217729.0)
    thousand = F.lit(1000.0)
    product = c * thousand
    high = c * split - (c * split - c)
    low = c - high
    error = (high * thousand - product) + low * thousand
    nearest = F.rint(product)
    whole = nearest.cast("decimal(38,0)")
    off = (product - nearest) + error
    near = F.abs(product - nearest) <= F.abs(product) * F.lit(1e-15)
    is_half = near & (F.abs(whole % 10) == 5)
    floor = F.floor(whole / 10).cast("decimal(38,0)")
    up = (off > 0) | ((off == 0) & (floor % 2 != 0))
    exact = ((floor + F.when(up, F.lit(1)).otherwise(F.lit(0))) / 100).cast("decimal(38,2)")
    return F.when(is_half, exact.cast("string")).otherwise(F.format_string("%.2f", c))
