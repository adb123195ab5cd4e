"""Maps, folds and scans with any associative operation, commutative or not, given as a vectorised Python function.

``op(a, b)`` takes two dicts of equally long NumPy arrays by column name, earlier rows in ``a``, and returns one. Rows come
to it in Arrow batches, one chunk of the order at a time; a row a chunk is carried over the edges. Values must not be null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core import CHUNK, Sequence, heads, islands

Values = dict[str, np.ndarray]
Operation = Callable[[Values, Values], Values]


def map_vectors(df: DataFrame, f: Callable[[Values], Values], schema: str) -> DataFrame:
    """``df`` with the columns of ``schema`` that an opaque function gives for a batch of rows."""
    added = T.StructType.fromDDL(schema)
    kept = [c for c in df.columns if c not in added.names]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = f({c: pdf[c].to_numpy() for c in pdf.columns})
            yield pd.concat([pdf[kept], pd.DataFrame({n: out[n] for n in added.names}, index=pdf.index)], axis=1)

    return df.mapInPandas(run, T.StructType([*df.select(*kept).schema.fields, *added.fields]))


def filter_vectors(df: DataFrame, keep: Callable[[Values], np.ndarray]) -> DataFrame:
    """Rows for which an opaque predicate holds."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[keep({c: pdf[c].to_numpy() for c in pdf.columns}).astype(bool)]

    return df.mapInPandas(run, df.schema)


def _part(values: Values, rows: slice) -> Values:
    return {c: x[rows] for c, x in values.items()}


def _joined(a: Values, b: Values) -> Values:
    return {c: np.concatenate([x, b[c]]) for c, x in a.items()}


def fold(values: Values, op: Operation, n: int) -> Values:
    """One value, from neighbours combined pairwise until one is left."""
    while n > 1:
        even = n - n % 2
        got = op(_part(values, slice(0, even, 2)), _part(values, slice(1, even, 2)))
        values = _joined(got, _part(values, slice(even, n))) if n % 2 else got
        n = (n + 1) // 2
    return values


def running(values: Values, op: Operation, n: int) -> Values:
    """All prefixes, in rounds that double how far back a value reaches."""
    step = 1
    while step < n:
        values = _joined(_part(values, slice(0, step)), op(_part(values, slice(0, n - step)), _part(values, slice(step, n))))
        step *= 2
    return values


def _carried(chunked: DataFrame, seq: Sequence, columns: list[str], op: Operation) -> DataFrame:
    """(chunk, columns): the fold of all chunks before; no row for the first."""
    schema = T.StructType([T.StructField(CHUNK, chunked.schema[CHUNK].dataType), *[chunked.schema[c] for c in columns]])
    names, ascending = seq.names, [not c.startswith("-") for c in seq.order]

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(names, ascending=ascending)
        return pd.DataFrame({CHUNK: pdf[CHUNK].iloc[:1].to_numpy()} | fold({c: pdf[c].to_numpy() for c in columns}, op, len(pdf)))

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:  # a row a chunk
        pdf = pdf.sort_values(CHUNK)
        got = running({c: pdf[c].to_numpy() for c in columns}, op, len(pdf))
        return pd.DataFrame({CHUNK: pdf[CHUNK].to_numpy()[1:]} | _part(got, slice(0, len(pdf) - 1)))

    needed = chunked.select(CHUNK, *dict.fromkeys([*seq.names, *columns]))
    return needed.groupBy(CHUNK).applyInPandas(total, schema).withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(chain, schema)


def scan(seq: Sequence, columns: list[str], op: Operation, exclusive: bool = False, init: dict | None = None) -> DataFrame:
    """The rows with ``columns`` replaced by their running fold; exclusive ones begin with ``init`` and leave out the own row."""
    if exclusive and init is None:
        raise ValueError("an exclusive scan needs a first value")
    chunked = seq.chunked
    carry = _carried(chunked, seq, columns, op)
    carry = carry.select(CHUNK, *[F.col(c).alias(f"_c{i}") for i, c in enumerate(columns)], F.lit(True).alias("_carried"))
    joined = chunked.join(F.broadcast(carry), CHUNK, "left")
    names, ascending = seq.names, [not c.startswith("-") for c in seq.order]
    schema, kept = seq.df.schema, seq.df.columns

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(names, ascending=ascending)
        n, first = len(pdf), None
        got = running({c: pdf[c].to_numpy() for c in columns}, op, n)
        if pdf["_carried"].iloc[0] is True or pdf["_carried"].iloc[0] == True:  # noqa: E712  numpy or Python
            first = {c: pdf[f"_c{i}"].to_numpy()[:1].astype(got[c].dtype) for i, c in enumerate(columns)}
        if init is not None:
            start = {c: np.array([init[c]], dtype=got[c].dtype) for c in columns}
            first = start if first is None else op(start, first)
        if first is not None:
            got = op({c: np.repeat(x, n) for c, x in first.items()}, got)
        if exclusive:
            got = _joined(first, _part(got, slice(0, n - 1)))
        return pdf[kept].assign(**got)

    return joined.groupBy(CHUNK).applyInPandas(local, schema)


def reduce(seq: Sequence, columns: list[str], op: Operation) -> DataFrame:
    """One row: the fold of all rows in order; none for no rows."""
    chunked = seq.chunked
    ascending = [not c.startswith("-") for c in seq.order]
    schema = T.StructType([T.StructField(CHUNK, chunked.schema[CHUNK].dataType), *[chunked.schema[c] for c in columns]])

    def total(by: list[str], up: list[bool]):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(by, ascending=up)
            return pd.DataFrame({CHUNK: pdf[CHUNK].iloc[:1].to_numpy()} | fold({c: pdf[c].to_numpy() for c in columns}, op, len(pdf)))

        return run

    needed = chunked.select(CHUNK, *dict.fromkeys([*seq.names, *columns]))
    totals = needed.groupBy(CHUNK).applyInPandas(total(seq.names, ascending), schema)
    return totals.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(total([CHUNK], [True]), schema).drop(CHUNK)


def segmented(op: Operation, flag: str) -> Operation:
    """``op`` that begins anew where ``flag`` (0 or 1) stands; associative where ``op`` is."""

    def both(a: Values, b: Values) -> Values:
        new = b[flag].astype(bool)
        got = op({c: x for c, x in a.items() if c != flag}, {c: x for c, x in b.items() if c != flag})
        return {c: np.where(new, b[c], x) for c, x in got.items()} | {flag: a[flag] | b[flag]}

    return both


def scan_by_key(seq: Sequence, keys: list[str], columns: list[str], op: Operation, equal=None) -> DataFrame:
    """Inclusive scan that restarts at each run of consecutive equal keys."""
    flagged = heads(seq, keys, equal, "_head").withColumn("_head", F.col("_head").cast("int"))
    return scan(seq.with_df(flagged), [*columns, "_head"], segmented(op, "_head")).drop("_head")


def reduce_by_key(seq: Sequence, keys: list[str], columns: list[str], op: Operation, equal=None) -> DataFrame:
    """(island, keys, columns): the fold of each run of consecutive equal keys."""
    numbered = seq.with_df(islands(seq, keys, equal, "island", pos="_pos"))
    folded = scan_by_key(numbered, ["island"], columns, op)
    first = [F.min_by(k, "_pos").alias(k) for k in keys]
    last = [F.max_by(c, "_pos").alias(c) for c in columns]
    return folded.groupBy("island").agg(*first, *last)
