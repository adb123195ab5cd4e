"""Stable sorts, bitwise sorts, sorts inside segments, and selection.

A sort is the position in the new order; write it with ``repartitionByRange`` on ``pos`` if files shall be ordered.
"""

from __future__ import annotations

from functools import reduce as fold

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..core import CHUNK, Sequence, position
from .scans import in_segments

#: Rows that one task may take.
TAKEN = 100_000
INTEGERS = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}


def merge_sort(seq: Sequence, *keys: str, out: str = "pos") -> DataFrame:
    """Position in the stable sort by ``keys`` ('-name': descending); values come along as columns."""
    return position(Sequence(seq.df, (*keys, *seq.order), seq.chunks), out)


def radix_key(df: DataFrame, key: str, begin_bit: int = 0, end_bit: int | None = None) -> Column:
    """The bits [begin_bit, end_bit) of an integer key, in the order of a bitwise sort."""
    kind = type(df.schema[key].dataType)
    if kind not in INTEGERS:
        if begin_bit or end_bit is not None:
            raise ValueError("a window of bits needs an integer key")
        return F.col(key)
    width = INTEGERS[kind]
    end_bit = width if end_bit is None else end_bit
    if not 0 <= begin_bit <= end_bit <= width:
        raise ValueError(f"bits [{begin_bit}, {end_bit}) are not in a key of {width} bits")
    if (begin_bit, end_bit) == (0, width):
        return F.col(key)
    sign = F.lit(-(1 << (width - 1))).cast(df.schema[key].dataType)  # negative keys come first
    bits = F.shiftrightunsigned(F.col(key).bitwiseXOR(sign).cast("long"), begin_bit)
    return bits.bitwiseAND(F.lit((1 << (end_bit - begin_bit)) - 1).cast("long")) if end_bit - begin_bit < 63 else bits


def radix_sort(seq: Sequence, key: str, begin_bit: int = 0, end_bit: int | None = None, descending: bool = False, out: str = "pos") -> DataFrame:
    """Stable bitwise sort on a window of the key's bits."""
    df = seq.df.withColumn("_k", radix_key(seq.df, key, begin_bit, end_bit))
    return position(Sequence(df, ("-_k" if descending else "_k", *seq.order), seq.chunks), out).drop("_k")


def radix_sort_decomposed(seq: Sequence, members: list[Column], descending: bool = False, out: str = "pos") -> DataFrame:
    """Stable sort of a composite key by its members, the first the most significant."""
    names = [f"_k{i}" for i in range(len(members))]
    df = fold(lambda d, nm: d.withColumn(*nm), zip(names, members), seq.df)
    return position(Sequence(df, (*[("-" if descending else "") + n for n in names], *seq.order), seq.chunks), out).drop(*names)


def segmented_sort(seq: Sequence, segments: DataFrame, segment: str, key: str, descending: bool = False, out: str = "rank", begin: str = "begin", end: str = "end") -> DataFrame:
    """Rank of each row inside each segment [begin, end), stable."""
    rows = in_segments(seq, segments, begin, end)
    order = F.desc(key) if descending else F.asc(key)
    return rows.withColumn(out, F.row_number().over(Window.partitionBy(segment).orderBy(order, "pos")).cast("long") - 1)


def _at_most(df: DataFrame, n: int, what: str) -> None:
    size = df.count()
    if n >= size and size:
        raise ValueError(f"{what} {n} is not below the number of rows, {size}")


def nth_element(seq: Sequence, key: str, n: int, out: str = "side") -> DataFrame:
    """-1, 0 or 1: before, at or after the n-th (from 0) in the stable sort by ``key``."""
    _at_most(seq.df, n, "nth")
    names = [key, *[c for c in seq.names if c != key]]
    ordered = Sequence(seq.df, (key, *[c for c in seq.order if c.removeprefix("-") != key]), seq.chunks)
    before = Window.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)  # a row a chunk
    sizes = ordered.chunked.groupBy(CHUNK).agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    at = sizes.where((F.col("_before") <= n) & (F.col("_before") + F.col("_n") > n)).first()  # only that chunk is sorted
    chunk = ordered.chunked.where(F.col(CHUNK) == (at[CHUNK] if at else 0)).withColumn("_rn", F.row_number().over(ordered.window()))
    pivot = chunk.where(F.col("_rn") == n + 1 - (at["_before"] if at else 0)).select(*[F.col(c).alias(f"_p{i}") for i, c in enumerate(names)])
    df = seq.df.join(F.broadcast(pivot))  # one row
    less, same = F.lit(False), F.lit(True)
    for i, c in enumerate(names):
        down = f"-{c}" in ordered.order
        lower = F.col(c) > F.col(f"_p{i}") if down else F.col(c) < F.col(f"_p{i}")
        less, same = less | (same & lower), same & F.col(c).eqNullSafe(F.col(f"_p{i}"))
    return df.withColumn(out, F.when(less, -1).when(same, 0).otherwise(1)).drop(*[f"_p{i}" for i in range(len(names))])


def partial_sort(seq: Sequence, key: str, middle: int, out: str = "pos") -> DataFrame:
    """Positions of the ``middle`` first of the stable sort; null for the rest, whose order is free."""
    _at_most(seq.df, middle, "middle")
    first = partial_sort_copy(seq, key, middle - 1, out).select(*seq.names, out)
    return seq.df.join(F.broadcast(first) if middle <= TAKEN else first, seq.names, "left")


def partial_sort_copy(seq: Sequence, key: str, middle: int, out: str = "pos") -> DataFrame:
    """The ``middle`` + 1 least rows with their positions; few are taken from each task, many are found by chunks."""
    if middle > TAKEN:
        ordered = Sequence(seq.df, (key, *[c for c in seq.order if c.removeprefix("-") != key]), seq.chunks)
        return position(ordered, out).where(F.col(out) <= middle)
    order = [F.col(key), *seq.by()]
    return seq.df.orderBy(*order).limit(middle + 1).withColumn(out, F.row_number().over(Window.orderBy(*order)).cast("long") - 1)


def radix_rank(tiled: DataFrame, key: str, begin_bit: int, end_bit: int, descending: bool = False, out: str = "rank") -> DataFrame:
    """Rank of each row in its tile by one digit of the key, stable by lane."""
    digit = radix_key(tiled, key, begin_bit, end_bit)
    return tiled.withColumn(out, F.row_number().over(Window.partitionBy("tile").orderBy(digit.desc() if descending else digit, "lane")) - 1)
