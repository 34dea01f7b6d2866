"""Expression semantics of the script language as Columns.

Equality is null-safe and never coerces; ordering and arithmetic read null and bad numbers as 0; plus joins
text where either side is text; modulo takes the divisor's sign; truth is by emptiness.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def truthy(c: Column, kind: str) -> Column:
    """Truth of a value of the kind text, number, boolean or container; null is false."""
    test = {"text": F.length(c) > 0, "number": c != 0, "boolean": c, "container": F.size(c) > 0}[kind]
    return F.coalesce(test, F.lit(False))


def both(left: Column, right: Column, kind: str) -> Column:
    """The operand that decides ``left && right``."""
    return F.when(truthy(left, kind), right).otherwise(left)


def either(left: Column, right: Column, kind: str) -> Column:
    """The operand that decides ``left || right``."""
    return F.when(truthy(left, kind), left).otherwise(right)


def same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


def number(c: Column) -> Column:
    """The number that ordering and arithmetic see: null and text that isn't a number are 0."""
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def less(left: Column, right: Column) -> Column:
    return number(left) < number(right)


def joined(left: Column, right: Column) -> Column:
    """``+`` where a side is text: null joins as nothing."""
    return F.concat(F.coalesce(left.cast("string"), F.lit("")), F.coalesce(right.cast("string"), F.lit("")))


def plus(left: Column, right: Column) -> Column:
    return number(left) + number(right)


def divided(left: Column, right: Column) -> Column:
    """``/``: a zero divisor raises, as ANSI division does."""
    return number(left) / number(right)


def modulo(left: Column, right: Column) -> Column:
    """``%``: the result has the divisor's sign; a zero divisor raises."""
    a, b = number(left), number(right)
    return a - b * F.floor(a / b)


def assigned(target: Column, operator: str, value: Column) -> Column:
    """The target after ``target operator value``; division and modulo by zero give 0."""
    a, b = number(target), number(value)
    if operator == "=":
        return value
    return {
        "+=": a + b,
        "-=": a - b,
        "*=": a * b,
        "/=": F.when(b == 0, F.lit(0.0)).otherwise(F.try_divide(a, b)),
        "%=": F.when(b == 0, F.lit(0.0)).otherwise(a - b * F.floor(F.try_divide(a, b))),
    }[operator]


def to_number(c: Column) -> Column:
    """Text without ``.`` must be an integer and other text a decimal, with an exponent if there is one; everything else is 0."""
    t = F.regexp_replace(c, r"^\s+|\s+$", "")
    return F.when(t.rlike(r"^[+-]?(\d+|(\d*\.\d+|\d+\.)([eE][+-]?\d+)?)$"), t.try_cast("double")).otherwise(F.lit(0.0))


def to_text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def trimmed(c: Column) -> Column:
    """Without white space at both ends; null becomes empty."""
    return F.coalesce(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), F.lit(""))


def suffix(c: Column, delimiter: str) -> Column:
    return F.substring_index(c, delimiter, -1)


def prefix(c: Column, delimiter: str) -> Column:
    return F.substring_index(c, delimiter, 1)


def count_of(c: Column, kind: str) -> Column:
    """``count``: null is 0, a container its size, any other value 1."""
    return F.coalesce(F.size(c), F.lit(0)) if kind == "container" else F.when(c.isNull(), 0).otherwise(1)


def printed(c: Column) -> Column:
    """A number as the exporter prints it: four decimals without trailing zeros or point."""
    return F.regexp_replace(F.format_string("%.4f", c), r"\.?0+$", "")


def exported(c: Column, kind: str) -> Column:
    """A value as the exporter writes it: null is empty, booleans are words, times have seconds."""
    value = {
        "text": c,
        "boolean": F.when(c, "true").otherwise("false"),
        "time": F.date_format(c, "yyyy-MM-dd HH:mm:ss"),
        "decimal": printed(c),
        "integer": c.cast("string"),
    }[kind]
    return F.when(c.isNull(), "").otherwise(value)
