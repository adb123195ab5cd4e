"""Prefix scans: plain, by key, by segment offsets and by head flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import Running, Runs, Sequence, position, scan, scan_runs


def inclusive_scan(seq: Sequence, value: str | Column, op="sum", out: str = "y") -> DataFrame:
    return scan(seq, value, op, out)


def exclusive_scan(seq: Sequence, value: str | Column, init, op="sum", out: str = "y") -> DataFrame:
    return scan(seq, value, op, out, exclusive=True, init=init)


def _running(value: str | Column, op, exclusive: bool = False, init=None) -> Running:
    return Running(F.col(value) if isinstance(value, str) else value, op, exclusive, init)


def inclusive_scan_by_key(seq: Sequence, keys: list[str], value: str | Column, op="sum", out: str = "y", equal=None) -> DataFrame:
    """Restarts at each run of consecutive equal keys."""
    return scan_runs(seq, Runs(tuple(keys), equal), {out: _running(value, op)})


def exclusive_scan_by_key(seq: Sequence, keys: list[str], value: str | Column, init, op="sum", out: str = "y", equal=None) -> DataFrame:
    return scan_runs(seq, Runs(tuple(keys), equal), {out: _running(value, op, True, init)})


def deterministic(value: str | Column, scale: int = 10) -> Column:
    """A float as a decimal, whose sums do not depend on grouping: bit-reproducible scans and folds."""
    return (F.col(value) if isinstance(value, str) else value).cast(f"decimal(38,{scale})")


def flag_segments(seq: Sequence, flag: str, out: str = "segment") -> DataFrame:
    """0-based segment of each row; a true flag begins one, and row 0 does whatever its flag."""
    return scan_runs(seq, Runs(flag=flag), number=out)


def segmented_scan_flags(seq: Sequence, flag: str, value: str | Column, op="sum", out: str = "y", exclusive: bool = False, init=None) -> DataFrame:
    return scan_runs(seq, Runs(flag=flag), {out: _running(value, op, exclusive, init)})


def in_segments(seq: Sequence, segments: DataFrame, begin: str = "begin", end: str = "end", bucket: int = 1024) -> DataFrame:
    """Rows of each segment [begin, end) by position; segments may overlap or leave gaps.

    Positions and segments meet by equal bucket of ``bucket`` positions, so this is a hash join.
    """
    rows = position(seq, "pos").withColumn("_b", F.floor(F.col("pos") / bucket))
    some = segments.where(F.col(begin) < F.col(end))
    spread = some.withColumn("_b", F.explode(F.sequence(F.floor(F.col(begin) / bucket), F.floor((F.col(end) - 1) / bucket))))
    return spread.join(rows, "_b").where((F.col("pos") >= F.col(begin)) & (F.col("pos") < F.col(end))).drop("_b")


def segmented_scan(seq: Sequence, segments: DataFrame, segment: str, value: str | Column, op="sum", out: str = "y", exclusive: bool = False, init=None, begin: str = "begin", end: str = "end") -> DataFrame:
    """Scan inside each segment [begin, end); one row for each row of each segment."""
    rows = in_segments(seq, segments, begin, end)
    ordered = Sequence(rows, (segment, "pos"), seq.chunks)
    return scan_runs(ordered, Runs((segment,)), {out: _running(value, op, exclusive, init)})
