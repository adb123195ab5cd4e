"""Operators inside fixed-size tiles: ``tile`` and ``lane`` columns as given by ``core.tiles``.

A tile is one small group, so windows by tile spread over the cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..core import monoid


def by_lane() -> WindowSpec:
    return Window.partitionBy("tile").orderBy("lane")


def reduce(tiled: DataFrame, value: str, op="sum", out: str = "y", valid: int | None = None) -> DataFrame:
    """(tile, out); ``valid``: only the first lanes count."""
    df = tiled if valid is None else tiled.where(F.col("lane") < valid)
    return df.groupBy("tile").agg(monoid(op).fold(F.col(value)).alias(out))


def scan(tiled: DataFrame, value: str, op="sum", out: str = "y", exclusive: bool = False, init=None, total: str | None = None) -> DataFrame:
    """Scan of each tile; ``init``: a value or a column with the carry; ``total``: also the tile's fold."""
    m = monoid(op)
    y = m.fold(F.col(value)).over(by_lane().rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0))
    if init is not None:
        y = m.combine(init if isinstance(init, Column) else F.lit(init), y)
    df = tiled.withColumn(out, y)
    return df.withColumn(total, m.fold(F.col(value)).over(Window.partitionBy("tile"))) if total else df


def segmented_reduce(tiled: DataFrame, flag: str, value: str, op="sum", tails: bool = False, out: str = "y") -> DataFrame:
    """Fold of each flagged segment of a tile, at its first lane. ``tails``: flags end segments."""
    seg = F.sum(F.col(flag).cast("int")).over(by_lane().rowsBetween(Window.unboundedPreceding, -1 if tails else 0))
    df = tiled.withColumn("_seg", F.coalesce(seg, F.lit(0)))
    return df.groupBy("tile", "_seg").agg(F.min("lane").alias("lane"), monoid(op).fold(F.col(value)).alias(out)).drop("_seg")


def permute(tiled: DataFrame, to_lane: Column) -> DataFrame:
    """Items moved to another lane of their tile."""
    return tiled.withColumn("lane", to_lane.cast("int"))


def blocked_to_striped(tiled: DataFrame, threads: int, items: int) -> DataFrame:
    """Item j of thread t goes from lane t * items + j to lane j * threads + t."""
    lane = F.col("lane")
    return permute(tiled, (lane % items) * threads + F.floor(lane / items))


def striped_to_blocked(tiled: DataFrame, threads: int, items: int) -> DataFrame:
    lane = F.col("lane")
    return permute(tiled, (lane % threads) * items + F.floor(lane / threads))


def blocked_to_warp_striped(tiled: DataFrame, warp: int, items: int) -> DataFrame:
    """As blocked to striped inside each warp of ``warp`` threads."""
    size, lane = warp * items, F.col("lane")
    inside = lane % size
    return permute(tiled, F.floor(lane / size) * size + (inside % items) * warp + F.floor(inside / items))


def warp_striped_to_blocked(tiled: DataFrame, warp: int, items: int) -> DataFrame:
    size, lane = warp * items, F.col("lane")
    inside = lane % size
    return permute(tiled, F.floor(lane / size) * size + (inside % warp) * items + F.floor(inside / warp))


def scatter(tiled: DataFrame, ranks: str, valid: Column | None = None) -> DataFrame:
    """Items go to the lane in ``ranks``; guarded: those with a negative rank, or not valid, go nowhere."""
    keep = F.col(ranks) >= 0 if valid is None else valid & (F.col(ranks) >= 0)
    return permute(tiled.where(keep), F.col(ranks))


def gather(tiled: DataFrame, source_lane: Column, value: str, out: str = "y") -> DataFrame:
    """The value at ``source_lane`` of the tile; a lane that is not there gives the lane's own value."""
    items = F.map_from_entries(F.collect_list(F.struct("lane", value)).over(Window.partitionBy("tile")))
    return tiled.withColumn("_items", items).withColumn("_at", source_lane.cast("int")).withColumn(out, F.coalesce(F.try_element_at("_items", F.col("_at")), F.col(value))).drop("_items", "_at")


def shuffle_offset(tiled: DataFrame, value: str, distance: int, out: str = "y") -> DataFrame:
    """Lane i gets the value of lane i - distance; where there is none it keeps its own."""
    return tiled.withColumn(out, F.coalesce(F.lag(value, distance).over(by_lane()) if distance >= 0 else F.lead(value, -distance).over(by_lane()), F.col(value)))


def shuffle_rotate(tiled: DataFrame, value: str, distance: int, size: int, out: str = "y") -> DataFrame:
    """Lane i gets the value of lane (i + distance) modulo ``size``."""
    return gather(tiled, (F.col("lane") + distance) % size, value, out)


def shuffle_up(tiled: DataFrame, value: str, out: str = "y") -> DataFrame:
    return shuffle_offset(tiled, value, 1, out)


def shuffle_down(tiled: DataFrame, value: str, out: str = "y") -> DataFrame:
    return shuffle_offset(tiled, value, -1, out)


def warp_xor(tiled: DataFrame, value: str, mask: int, out: str = "y") -> DataFrame:
    return gather(tiled, F.col("lane").bitwiseXOR(F.lit(mask)), value, out)


def read_lane(tiled: DataFrame, value: str, lane: int = 0, out: str = "y") -> DataFrame:
    """The value of one lane, in all lanes of the tile (broadcast)."""
    return tiled.withColumn(out, F.max(F.when(F.col("lane") == lane, F.col(value))).over(Window.partitionBy("tile")))


def load(tiled: DataFrame, value: str, size: int, fill) -> DataFrame:
    """All ``size`` lanes of every tile; lanes past the end hold ``fill``."""
    lanes = tiled.select("tile").distinct().withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    return lanes.join(tiled.select("tile", "lane", value), ["tile", "lane"], "left").withColumn(value, F.coalesce(value, F.lit(fill)))


def ballot(tiled: DataFrame, predicate: Column, out: str = "mask") -> DataFrame:
    """(tile, mask): bit i is lane i's predicate; up to 64 lanes."""
    bit = F.expr("shiftleft(1L, lane)")
    return tiled.groupBy("tile").agg(F.coalesce(F.bit_or(F.when(predicate, bit)), F.lit(0).cast("long")).alias(out))


def any_all(tiled: DataFrame, predicate: Column) -> DataFrame:
    """(tile, any, all)."""
    p = F.coalesce(predicate, F.lit(False))
    return tiled.groupBy("tile").agg(F.bool_or(p).alias("any"), F.bool_and(p).alias("all"))


def match_any(tiled: DataFrame, label: str, out: str = "mask") -> DataFrame:
    """Mask of the tile's lanes with an equal label; and whether the lane is elected, the least of them."""
    w = Window.partitionBy("tile", label)
    return tiled.withColumn(out, F.bit_or(F.expr("shiftleft(1L, lane)")).over(w)).withColumn("elected", F.col("lane") == F.min("lane").over(w))


def masked_bit_count(mask: Column, lane: Column) -> Column:
    """Set bits of a mask below a lane."""
    return F.bit_count(mask.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), lane.cast("int")) - 1))


def subtract_left(tiled: DataFrame, value: str, out: str = "y", valid: int | None = None, before: Column | None = None) -> DataFrame:
    """x[i] - x[i-1] inside the tile; lane 0 stays, or is compared with ``before``. Lanes from ``valid`` on stay."""
    x = F.col(value)
    first = x if before is None else x - before
    y = F.when(F.col("lane") == 0, first).otherwise(x - F.lag(value).over(by_lane()))
    return tiled.withColumn(out, y if valid is None else F.when(F.col("lane") < valid, y).otherwise(x))


def subtract_right(tiled: DataFrame, value: str, out: str = "y", valid: int | None = None, after: Column | None = None) -> DataFrame:
    """x[i] - x[i+1] inside the tile; the last (valid) lane stays, or is compared with ``after``. Lanes from ``valid`` on stay."""
    x = F.col(value)
    last = F.lead("lane").over(by_lane()).isNull()
    last = last if valid is None else last | (F.col("lane") == valid - 1)
    y = F.when(last, x if after is None else x - after).otherwise(x - F.lead(value).over(by_lane()))
    return tiled.withColumn(out, y if valid is None else F.when(F.col("lane") < valid, y).otherwise(x))


def sort(tiled: DataFrame, key: str, descending: bool = False, out: str = "rank", valid: int | None = None) -> DataFrame:
    """Stable rank in the tile; lanes from ``valid`` on are not sorted and keep their place."""
    order = [F.desc(key) if descending else F.asc(key), F.col("lane")]
    if valid is None:
        return tiled.withColumn(out, F.row_number().over(Window.partitionBy("tile").orderBy(*order)) - 1)
    late = F.col("lane") >= valid
    rank = F.row_number().over(Window.partitionBy("tile", late).orderBy(*order)) - 1
    return tiled.withColumn(out, F.when(late, F.col("lane")).otherwise(rank))
