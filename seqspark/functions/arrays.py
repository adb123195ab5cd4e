"""Folds, scans and searches on array columns, and bit codecs of sort keys."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Binary = Callable[[Column, Column], Column]


def array_reduce(values: Column, op: Binary, prefix: Column | None = None) -> Column:
    """op over the array, after ``prefix`` if given; null for an empty array without prefix."""
    step = lambda acc, x: op(acc, x)  # noqa: E731  a built-in function's signature is not accepted
    if prefix is not None:
        return F.aggregate(values, prefix, step)
    return F.when(F.size(values) > 0, F.aggregate(F.slice(values, F.lit(2), F.size(values)), F.get(values, F.lit(0)), step))


def array_scan(values: Column, op: Binary, zero: Column, exclusive: bool = False) -> Column:
    """Running op from ``zero``; exclusive begins with it and leaves out the last."""
    step = lambda acc, x: F.concat(acc, F.array(op(F.element_at(acc, -1), x)))
    whole = F.aggregate(values, F.array(zero), step)
    return F.slice(whole, 1, F.size(values)) if exclusive else F.slice(whole, F.lit(2), F.size(values))


def array_lower_bound(values: Column, x: Column) -> Column:
    return F.size(F.filter(values, lambda v: v < x))


def array_upper_bound(values: Column, x: Column) -> Column:
    return F.size(F.filter(values, lambda v: v <= x))


def encode_key(key: Column, bits: int, descending: bool = False) -> Column:
    """A signed key as a number that compares like the key when its bits are read unsigned."""
    flipped = key.cast("long") + F.lit(1 << (bits - 1)) if bits < 64 else key.cast("long").bitwiseXOR(F.lit(-(1 << 63)).cast("long"))
    return _flip(flipped, bits) if descending else flipped


def decode_key(code: Column, bits: int, descending: bool = False) -> Column:
    plain = _flip(code, bits) if descending else code
    return plain - F.lit(1 << (bits - 1)) if bits < 64 else plain.bitwiseXOR(F.lit(-(1 << 63)).cast("long"))


def _flip(code: Column, bits: int) -> Column:
    """All bits of the code turned over."""
    return F.bitwise_not(code).bitwiseAND(F.lit((1 << bits) - 1).cast("long")) if bits < 64 else F.bitwise_not(code)


#: Code of infinity; greater ones are NaN.
INFINITY = 0x7FF0 << 48


@F.pandas_udf(T.LongType())
def _double_bits(key: pd.Series) -> pd.Series:
    x = key.to_numpy(np.float64)
    return pd.Series(_turned(np.where(np.isnan(x), np.nan, x).view(np.int64)))


@F.pandas_udf(T.DoubleType())
def _bits_double(code: pd.Series) -> pd.Series:
    return pd.Series(_turned(code.to_numpy(np.int64)).view(np.float64))


def _turned(bits: np.ndarray) -> np.ndarray:
    """Negative numbers with all bits but the sign turned over."""
    return bits ^ ((bits >> 63) & np.int64((1 << 63) - 1))


def encode_double(key: str | Column) -> Column:
    """A double as a signed number that compares like it; NaN last, -0.0 just before 0.0, null stays."""
    key = F.col(key) if isinstance(key, str) else key
    return F.when(key.isNotNull(), _double_bits(F.coalesce(key, F.lit(0.0))))


def decode_double(code: str | Column) -> Column:
    code = F.col(code) if isinstance(code, str) else code
    return F.when(code > INFINITY, F.lit(float("nan"))).when(code.isNotNull(), _bits_double(F.coalesce(code, F.lit(0).cast("long"))))


def extract_digit(code: Column, start: int, radix_bits: int) -> Column:
    return F.shiftrightunsigned(code, start).bitwiseAND(F.lit((1 << radix_bits) - 1))


def get_bit(x: Column, i: int) -> Column:
    return F.getbit(x, F.lit(i))
