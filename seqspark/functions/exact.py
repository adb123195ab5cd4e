"""Sums of doubles that do not depend on grouping or order: exact integers until the end, rounded once."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HALF = 1 << 53


class Exact:
    """Doubles of one column as whole multiples of 2**low, in decimal(38, 0), and back.

    ``low`` and the range are found in one pass; values whose exact sum could need more than 125 bits raise ValueError.
    """

    def __init__(self, df: DataFrame, value: str | Column):
        self.value = F.col(value) if isinstance(value, str) else value
        size = F.abs(F.when(self.value != 0, self.value))
        r = df.agg(F.min(size).alias("low"), F.max(size).alias("high"), F.count("*").alias("n")).first()
        self.low = math.frexp(r.low)[1] - 53 if r.low else 0
        bits = (math.frexp(r.high)[1] if r.high and math.isfinite(r.high) else 0) - self.low
        if not (r.high is None or math.isfinite(r.high)) or bits > 115 or bits + max(r.n, 1).bit_length() > 125:
            raise ValueError("an exact sum of these numbers does not fit")

    def __call__(self) -> Column:
        x = self._scaled(self.value, -self.low)
        upper = F.floor(x / F.lit(float(HALF)))
        lower = (x - upper.cast("double") * F.lit(float(HALF))).cast("long")
        return (upper.cast("decimal(20,0)") * F.lit(HALF).cast("decimal(17,0)") + lower).cast("decimal(38,0)")

    def back(self, total: Column) -> Column:
        """The double nearest to a sum of such integers."""
        return self._scaled(total.cast("double"), self.low)

    @staticmethod
    def _scaled(x: Column, power: int) -> Column:
        while power:  # by powers of two that a double holds
            step = max(-1000, min(1000, power))
            x, power = x * F.lit(2.0**step), power - step
        return x
