"""Batched copies of slices between buffers, in elements or bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def batch_copy(src: DataFrame, dst: DataFrame, moves: DataFrame, value: str = "x", bucket: int = 1024) -> DataFrame:
    """``dst`` (dst_id, off, value) after all ``moves`` (src_id, src_off, dst_id, dst_off, len) from ``src`` (src_id, off, value).

    Moves meet source rows by bucket of offsets, so long slices are not exploded one by one.
    Destinations must not overlap; moves of length 0 do nothing.
    """
    some = moves.where("len > 0").withColumn("_b", F.explode(F.sequence(F.floor(F.col("src_off") / bucket), F.floor((F.col("src_off") + F.col("len") - 1) / bucket))))
    rows = src.withColumn("_b", F.floor(F.col("off") / bucket))
    moved = some.join(rows, ["src_id", "_b"]).where((F.col("off") >= F.col("src_off")) & (F.col("off") < F.col("src_off") + F.col("len")))
    moved = moved.select("dst_id", (F.col("dst_off") + F.col("off") - F.col("src_off")).alias("off"), F.struct(F.col(value).alias("v")).alias("_new"))
    kept = dst.join(moved, ["dst_id", "off"], "left")
    return kept.select(*[F.when(F.col("_new").isNotNull(), F.col("_new.v")).otherwise(F.col(value)).alias(value) if c == value else F.col(c) for c in dst.columns])


def batch_memcpy(src: DataFrame, dst: DataFrame, moves: DataFrame, data: str = "data") -> DataFrame:
    """The same on binary buffers (src_id, data) and (dst_id, data): bytes of each move replace those of its destination."""
    cut = moves.where("len > 0").join(src.withColumnRenamed(data, "_src"), "src_id").select("dst_id", "dst_off", "len", F.substring("_src", F.col("src_off").cast("int") + 1, F.col("len").cast("int")).alias("_part"))
    by = cut.groupBy("dst_id").agg(F.array_sort(F.collect_list(F.struct(F.col("dst_off").cast("int").alias("o"), F.col("len").cast("int").alias("n"), F.col("_part").alias("p")))).alias("_moves"))

    def put(acc, m):
        return F.concat(F.substring(acc, F.lit(1), m["o"]), m["p"], F.substring(acc, m["o"] + m["n"] + 1, F.octet_length(acc)))

    joined = dst.join(by, "dst_id", "left")
    return joined.withColumn(data, F.when(F.col("_moves").isNull(), F.col(data)).otherwise(F.aggregate("_moves", F.col(data), put))).drop("_moves")
