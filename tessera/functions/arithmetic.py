"""Scalar arithmetic on whole numbers, and dates as day numbers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.schema import ref

Operand = str | int | float


def operand(x: Operand) -> Column:
    """A column by its name, or a number."""
    return ref(x) if isinstance(x, str) else F.lit(x)


def product(operands: Sequence[Operand], floats: bool = False) -> Column:
    """All operands multiplied; whole numbers are widened to 64 bits first, so that overflow raises instead of wrapping."""
    kind = "double" if floats else "long"
    return reduce(lambda a, b: a * b, [operand(x).cast(kind) for x in operands])


def quotient(operands: Sequence[Operand], floats: bool = False, on_zero: str = "raise", whole: bool = False) -> Column:
    """Left to right; the result is truncated towards zero unless ``floats``. A zero divisor raises, or gives null where
    ``on_zero`` is "null". ``whole``: all operands are whole numbers; they are divided as such, exactly at 64 bits."""
    if on_zero not in ("raise", "null"):
        raise ValueError("on_zero is 'raise' or 'null'")
    exact = whole and not floats
    first, *rest = [operand(x).cast("long" if exact else "double") for x in operands]
    if on_zero == "null":
        rest = [F.nullif(x, F.lit(0)) for x in rest]
    else:
        rest = [F.when(x == 0, F.raise_error(F.lit("division by zero")).cast(kind)).otherwise(x) for x, kind in ((x, "long" if exact else "double") for x in rest)]
    out = reduce(whole_quotient if exact else lambda a, b: a / b, [first, *rest])
    return out if floats else out.cast("long")


def whole_quotient(a: Column, b: Column) -> Column:
    """a / b of two longs, truncated towards zero; -2^63 / -1, which no long holds, raises in ANSI mode."""
    return F.call_function("div", a, b)


def day_number(date: Column, fmt: str = "MM/dd/yy") -> Column:
    """Days since 1970-01-01 of a date written as text; two-digit years are of 2000 to 2099."""
    return F.datediff(F.to_date(date, fmt), F.lit("1970-01-01").cast("date"))


def is_code(code: Column, prefix: str) -> Column:
    """1 where a diagnosis code starts with the prefix, else 2."""
    return F.when(code.startswith(prefix), 1).otherwise(2)


def mentions(name: Column, word: str) -> Column:
    """1 where a name contains the word in any case, else 2."""
    return F.when(F.lower(name).contains(word.lower()), 1).otherwise(2)
