"""Search in sorted sequences, and sorted merge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import Sequence, position, scan


def _bound(hay: DataFrame, hay_key: str, needles: DataFrame, needle_key: str, needle_id: str, upper: bool, out: str, chunks: int | None) -> DataFrame:
    """Needles and haystack in one order; a running count of the haystack answers every needle."""
    first = 0 if upper else 1  # ties: the haystack before the needle for an upper bound
    h = hay.where(F.col(hay_key).isNotNull()).groupBy(F.col(hay_key).alias("_q")).agg(F.count("*").alias("_n"))  # equal keys count as one row
    both = h.select("_q", "_n", F.lit(first).alias("_t"), F.lit(None).cast(dict(needles.dtypes)[needle_id]).alias(needle_id)).unionByName(
        needles.where(F.col(needle_key).isNotNull()).select(F.col(needle_key).alias("_q"), F.lit(0).cast("long").alias("_n"), F.lit(1 - first).alias("_t"), needle_id)
    )
    counted = scan(Sequence(both, ("_q", "_t", needle_id), chunks), "_n", "sum", out)
    found = counted.where(F.col("_t") == 1 - first).select(needle_id, out)
    return needles.join(found, needle_id, "left")


def lower_bound(hay: DataFrame, hay_key: str, needles: DataFrame, needle_key: str, needle_id: str, out: str = "bound", chunks: int | None = None) -> DataFrame:
    """Needles with the number of haystack items below each; null needles get null."""
    return _bound(hay, hay_key, needles, needle_key, needle_id, False, out, chunks)


def upper_bound(hay: DataFrame, hay_key: str, needles: DataFrame, needle_key: str, needle_id: str, out: str = "bound", chunks: int | None = None) -> DataFrame:
    """Needles with the number of haystack items at or below each."""
    return _bound(hay, hay_key, needles, needle_key, needle_id, True, out, chunks)


def binary_search(hay: DataFrame, hay_key: str, needles: DataFrame, needle_key: str, out: str = "found") -> DataFrame:
    """Needles with 1 if the haystack holds an equal item, else 0."""
    keys = hay.select(F.col(hay_key).alias("_h")).where("_h IS NOT NULL").distinct()
    return needles.join(keys, F.col(needle_key) == F.col("_h"), "left").withColumn(out, F.col("_h").isNotNull().cast("int")).drop("_h")


def merge(left: Sequence, right: Sequence, key: str, out: str = "pos") -> DataFrame:
    """Both sequences, sorted by ``key``, in one; of equal keys the left's come first. ``src``: 0 left, 1 right."""
    both = left.df.withColumn("src", F.lit(0)).unionByName(right.df.withColumn("src", F.lit(1)))
    return position(Sequence(both, (key, "src", *[c for c in left.order if c.removeprefix("-") != key]), left.chunks), out)
