"""Adjacent differences and discontinuity flags."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import Sequence, following, position, previous

Binary = Callable[[Column, Column], Column]


def adjacent_difference(seq: Sequence, value: str, op: Binary = lambda a, b: a - b, out: str = "y") -> DataFrame:
    """op(x[i], x[i-1]); the first element stays."""
    df = previous(seq, {"_near": F.col(value)})
    return df.withColumn(out, F.when(F.col("_first"), F.col(value)).otherwise(op(F.col(value), F.col("_near")))).drop("_first", "_near")


def adjacent_difference_right(seq: Sequence, value: str, op: Binary = lambda a, b: a - b, out: str = "y") -> DataFrame:
    """op(x[i], x[i+1]); the last element stays."""
    df = following(seq, {"_near": F.col(value)})
    return df.withColumn(out, F.when(F.col("_last"), F.col(value)).otherwise(op(F.col(value), F.col("_near")))).drop("_last", "_near")


def flag_heads(seq: Sequence, value: str, differs: Binary = lambda a, b: ~a.eqNullSafe(b), out: str = "head", outside: Column | None = None) -> DataFrame:
    """differs(before, x) of each element; the first is flagged, or compared with ``outside``."""
    df = previous(seq, {"_near": F.col(value)})
    edge = F.lit(True) if outside is None else differs(outside, F.col(value))
    return df.withColumn(out, F.when(F.col("_first"), edge).otherwise(differs(F.col("_near"), F.col(value)))).drop("_first", "_near")


def flag_heads_indexed(seq: Sequence, value: str, differs: Callable[[Column, Column, Column], Column], out: str = "head") -> DataFrame:
    """differs(before, x, position of x) of each element; the first is flagged."""
    df = previous(seq.with_df(position(seq, "_index")), {"_near": F.col(value)})
    return df.withColumn(out, F.col("_first") | differs(F.col("_near"), F.col(value), F.col("_index"))).drop("_first", "_near", "_index")


def flag_tails(seq: Sequence, value: str, differs: Binary = lambda a, b: ~a.eqNullSafe(b), out: str = "tail", outside: Column | None = None) -> DataFrame:
    """differs(x, after) of each element; the last is flagged, or compared with ``outside``."""
    df = following(seq, {"_near": F.col(value)})
    edge = F.lit(True) if outside is None else differs(F.col(value), outside)
    return df.withColumn(out, F.when(F.col("_last"), edge).otherwise(differs(F.col(value), F.col("_near")))).drop("_last", "_near")


def flag_heads_and_tails(seq: Sequence, value: str, differs: Binary = lambda a, b: ~a.eqNullSafe(b)) -> DataFrame:
    return flag_tails(seq.with_df(flag_heads(seq, value, differs)), value, differs)
