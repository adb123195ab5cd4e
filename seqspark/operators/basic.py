"""Map, filter, stable partitions and removal of adjacent repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import Running, Sequence, heads, scan_many


def transform(df: DataFrame, f, *inputs: str, out: str = "y") -> DataFrame:
    """``out`` = f of one or two columns; stays inside whole-stage codegen."""
    return df.withColumn(out, f(*[F.col(c) for c in inputs]))


def select(df: DataFrame, keep: str | Column) -> DataFrame:
    """Rows whose flag or predicate holds; null counts as false."""
    return df.where(F.coalesce(_flag(keep), F.lit(False)))


def _flag(flag: str | Column) -> Column:
    flag = F.col(flag) if isinstance(flag, str) else flag
    return flag.cast("boolean")


def partition(seq: Sequence, keep: str | Column, out: str = "out_pos") -> DataFrame:
    """One output: selected rows in order, then rejected ones in reverse order. ``out``: new position."""
    keep = F.coalesce(_flag(keep), F.lit(False))
    df = scan_many(seq.with_df(seq.df.withColumn("_keep", keep)), {"_pos": Running(F.lit(1), "count", exclusive=True), "_before": Running(F.col("_keep").cast("long"), exclusive=True, init=0), "_n": Running(F.lit(1), "count", total=True)})
    # selected: how many were selected before; rejected: from the end, how many were rejected before
    at = F.when(F.col("_keep"), F.col("_before")).otherwise(F.col("_n") - 1 - (F.col("_pos") - F.col("_before")))
    return df.withColumn(out, at.cast("long")).drop("_pos", "_keep", "_before", "_n")


def partition_two_way(df: DataFrame, keep: str | Column, out: str = "part") -> DataFrame:
    """0 for selected rows and 1 for rejected; both keep their order. Filter on ``out`` for either."""
    return df.withColumn(out, F.when(F.coalesce(_flag(keep), F.lit(False)), 0).otherwise(1))


def partition_three_way(df: DataFrame, first: str | Column, second: str | Column, out: str = "part") -> DataFrame:
    """0 where ``first`` holds, else 1 where ``second`` holds, else 2."""
    return df.withColumn(out, F.when(F.coalesce(_flag(first), F.lit(False)), 0).when(F.coalesce(_flag(second), F.lit(False)), 1).otherwise(2))


def part_counts(parts: DataFrame, column: str = "part") -> DataFrame:
    """Rows of each part."""
    return parts.groupBy(column).agg(F.count("*").alias("n"))


def unique(seq: Sequence, *keys: str, equal=None) -> DataFrame:
    """First row of each run of consecutive equal ``keys``, other columns along."""
    return heads(seq, list(keys), equal, "_head").where("_head").drop("_head")
