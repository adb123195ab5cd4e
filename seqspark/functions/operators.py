"""The functor vocabulary as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BINARY = {
    "less": lambda a, b: a < b,
    "less_equal": lambda a, b: a <= b,
    "greater": lambda a, b: a > b,
    "greater_equal": lambda a, b: a >= b,
    "equal_to": lambda a, b: a == b,
    "not_equal_to": lambda a, b: a != b,
    "plus": lambda a, b: a + b,
    "minus": lambda a, b: a - b,
    "multiplies": lambda a, b: a * b,
    "maximum": F.greatest,
    "minimum": F.least,
}


def identity(x: Column) -> Column:
    return x


def negated(equal):
    """The inequality of an equality."""
    return lambda a, b: ~equal(a, b)


def wrapped(x: Column, bits: int) -> Column:
    """A number modulo 2**bits, as unsigned arithmetic of that width gives it."""
    return F.pmod(x, F.lit(1 << bits).cast("decimal(20,0)" if bits >= 63 else "long"))
