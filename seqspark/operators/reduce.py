"""Folds: whole, by segment, by runs of keys; run-length coding; arg-min and arg-max."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import Sequence, islands, monoid
from .scans import in_segments


def reduce(df: DataFrame, value: str | Column, op="sum", init=None, out: str = "y") -> DataFrame:
    """One row: the fold of a column; ``init`` joins in and is the answer for no rows."""
    m = monoid(op)
    y = m.fold(F.col(value) if isinstance(value, str) else value)
    return df.agg((m.combine(F.lit(init), y) if init is not None else y).alias(out))


def segmented_reduce(seq: Sequence, segments: DataFrame, segment: str, value: str | Column, op="sum", init=None, out: str = "y", begin: str = "begin", end: str = "end") -> DataFrame:
    """(segment, out) for every segment; an empty one gives ``init``."""
    m = monoid(op)
    rows = in_segments(seq, segments, begin, end)
    folded = rows.groupBy(segment).agg(m.fold(F.col(value) if isinstance(value, str) else value).alias("_y"))
    y = m.combine(F.lit(init), F.col("_y")) if init is not None else F.col("_y")
    return segments.select(segment).join(folded, segment, "left").select(segment, y.alias(out))


def reduce_by_key(seq: Sequence, keys: list[str], aggregates: dict[str, Column], equal=None) -> DataFrame:
    """For each run of consecutive equal keys: its number, first keys, ``aggregates``, and rows."""
    df = islands(seq, keys, equal, "island", pos="_pos")
    first = [F.min_by(k, "_pos").alias(k) for k in keys]
    return df.groupBy("island").agg(*first, *[c.alias(n) for n, c in aggregates.items()], F.count("*").alias("run_length"))


def run_length_encode(seq: Sequence, *keys: str, equal=None) -> DataFrame:
    return reduce_by_key(seq, list(keys), {}, equal)


def non_trivial_runs(seq: Sequence, *keys: str, equal=None) -> DataFrame:
    """(start, run_length) of runs longer than one."""
    df = islands(seq, list(keys), equal, "island", pos="_pos")
    return df.groupBy("island").agg(F.min("_pos").alias("start"), F.count("*").alias("run_length")).where("run_length > 1").drop("island")


def run_length_decode(runs: DataFrame, length: str, out: str = "run_offset") -> DataFrame:
    """Each row repeated ``length`` times with its place in the run; no row for length 0."""
    return runs.where(F.col(length) > 0).withColumn(out, F.explode(F.sequence(F.lit(0).cast("long"), F.col(length).cast("long") - 1)))


def arg_min(df: DataFrame, key: str, value: str) -> DataFrame:
    """Key and value of the least value; ties go to the smaller key."""
    return df.agg(F.min(F.struct(F.col(value).alias("value"), F.col(key).alias("key"))).alias("m")).select("m.key", "m.value")


def arg_max(df: DataFrame, key: str, value: str) -> DataFrame:
    """Key and value of the greatest value; ties go to the smaller key."""
    return df.select(F.col(key).alias("key"), F.col(value).alias("value")).where(F.col("value").isNotNull()).orderBy(F.desc("value"), "key").limit(1)
