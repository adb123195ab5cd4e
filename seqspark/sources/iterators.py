"""Lazy sequences: constants, counters, zips, indices, reversals, masks, and a sink that keeps nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import Sequence, position


def constant(spark: SparkSession, value, n: int, out: str = "x") -> DataFrame:
    return spark.range(n).select(F.col("id").alias("pos"), F.lit(value).alias(out))


def counting(spark: SparkSession, start: int, n: int, out: str = "x") -> DataFrame:
    return spark.range(n).select(F.col("id").alias("pos"), (F.col("id") + start).alias(out))


def zipped(*sequences: Sequence) -> DataFrame:
    """Columns of all sequences side by side by position; as long as the shortest. Names must differ."""
    out = position(sequences[0])
    for s in sequences[1:]:
        out = out.join(position(s), "pos")
    return out


def arg_index(seq: Sequence, value: str, out: str = "indexed") -> DataFrame:
    """Struct (index, value) of each row."""
    return position(seq, "_pos").withColumn(out, F.struct(F.col("_pos").alias("index"), F.col(value).alias("value"))).drop("_pos")


def reversed_(seq: Sequence) -> Sequence:
    """The same rows in the opposite order."""
    return Sequence(seq.df, tuple(c[1:] if c.startswith("-") else f"-{c}" for c in seq.order), seq.chunks)


def masked_read(df: DataFrame, value: str, keep: Column, default, out: str = "y") -> DataFrame:
    """The value where ``keep`` (a predicate or flag) holds, else ``default``."""
    return df.withColumn(out, F.when(keep, F.col(value)).otherwise(F.lit(default)))


def masked_write(df: DataFrame, target: str, new: Column, keep: Column) -> DataFrame:
    """``target`` overwritten where ``keep`` holds."""
    return df.withColumn(target, F.when(keep, new).otherwise(F.col(target)))


def discard(df: DataFrame) -> None:
    """Run a plan and keep nothing."""
    df.write.format("noop").mode("overwrite").save()
