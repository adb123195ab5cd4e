"""Histograms with even or given bins, for one or several channels, over rows or a region of an image."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _spine(df: DataFrame, bins: int) -> DataFrame:
    return df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))


def even_bin(x: Column, levels: int, lower: float, upper: float, integral: bool = False) -> Column:
    """Bin of x among ``levels`` - 1 equal bins of [lower, upper); null outside."""
    if levels < 2:
        raise ValueError("a histogram needs two levels at least")
    bins = levels - 1
    if integral and (upper - lower) % bins:
        raise ValueError("integer bins must divide the range")
    at = F.floor((x - F.lit(lower)) * F.lit(bins) / F.lit(upper - lower)).cast("int")
    return F.when((x >= lower) & (x < upper) & ~F.isnan(x.cast("double")), F.least(at, F.lit(bins - 1)))


def range_bin(x: Column, levels: list) -> Column:
    """Bin j with levels[j] <= x < levels[j + 1], by bisection; null outside."""
    if len(levels) < 2 or sorted(levels) != list(levels):
        raise ValueError("levels must ascend, two at least")

    def place(lo: int, hi: int) -> Column:
        if hi - lo == 1:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(x < F.lit(levels[mid]), place(lo, mid)).otherwise(place(mid, hi))

    return F.when((x >= levels[0]) & (x < levels[-1]), place(0, len(levels) - 1))


def _histogram(df: DataFrame, at: Column, bins: int) -> DataFrame:
    counted = df.select(at.alias("bin")).where("bin IS NOT NULL").groupBy("bin").agg(F.count("*").alias("n"))
    return _spine(df, bins).join(counted, "bin", "left").select("bin", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def histogram_even(df: DataFrame, value: str, levels: int, lower: float, upper: float) -> DataFrame:
    """(bin, n) of every bin, empty ones too; samples outside [lower, upper) are ignored."""
    integral = isinstance(df.schema[value].dataType, T.IntegralType)
    return _histogram(df, even_bin(F.col(value), levels, lower, upper, integral), levels - 1)


def histogram_range(df: DataFrame, value: str, levels: list) -> DataFrame:
    return _histogram(df, range_bin(F.col(value), levels), len(levels) - 1)


def region(df: DataFrame, columns: int, rows: int | Column | None, column: str = "col", row: str = "row") -> DataFrame:
    """The first ``columns`` x ``rows`` samples of an image given by coordinates; None: all rows."""
    wide = df.where(F.col(column) < columns)
    return wide if rows is None else wide.where(F.col(row) < rows)


def _channels(df: DataFrame, channels: list[str], bins_of) -> DataFrame:
    each = F.array(*[bins_of(c, F.col(n)).alias("b") for c, n in enumerate(channels)])
    return df.select(F.posexplode(each).alias("channel", "bin")).where("bin IS NOT NULL").groupBy("channel", "bin").agg(F.count("*").alias("n"))


def _all_bins(df: DataFrame, counted: DataFrame, sizes: list[int]) -> DataFrame:
    spine = df.sparkSession.range(1).select(F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.sequence(F.lit(0), F.lit(n - 1)).alias("bins")) for c, n in enumerate(sizes)])).alias("s"))
    spine = spine.select("s.channel", F.explode("s.bins").alias("bin"))
    return spine.join(counted, ["channel", "bin"], "left").select("channel", "bin", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def multi_histogram_even(df: DataFrame, channels: list[str], levels: list[int], lower: list[float], upper: list[float]) -> DataFrame:
    """(channel, bin, n); ``channels``: the active ones. One pass for all."""
    counted = _channels(df, channels, lambda c, x: even_bin(x, levels[c], lower[c], upper[c]))
    return _all_bins(df, counted, [n - 1 for n in levels])


def multi_histogram_range(df: DataFrame, channels: list[str], levels: list[list]) -> DataFrame:
    counted = _channels(df, channels, lambda c, x: range_bin(x, levels[c]))
    return _all_bins(df, counted, [len(x) - 1 for x in levels])


def composite(counts: DataFrame, more: DataFrame, *keys: str) -> DataFrame:
    """Adds one histogram to another of the same bins."""
    keys = keys or ("bin",)
    return counts.unionByName(more).groupBy(*keys).agg(F.sum("n").alias("n"))
