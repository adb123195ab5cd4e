"""Exact top-k inner-product search over a bit-sliced index.

The index packs rows, ``BLOCK`` at a time, into bitmaps: one for each bit of each attribute, less the attribute's
least value in the block. A query multiplies and adds slices by bitmap arithmetic (partial products
of its bits, carry-save adders), for many queries at once, which gives the bitmaps of the sum's bits
for all rows of the block. Rows are then selected from the most significant bitmap downward: those
set above the boundary are in, and what is left undecided after the last bitmap are rows of equal
score, of which those with the smallest ids are taken. The best of each block are merged by query.

Blocks of queries meet blocks of the index by key, so no task holds all of either.

Defined results: a null vector or one with a null or non-finite component takes no part; repeated
rows of one id are candidates each, queries of one id are asked once (the least vector); vectors of different
length are compared over the shorter, and one quantised beyond ``LIMIT`` raises an error; an empty table gives no rows;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import stored

BLOCK = 8192
QUERIES = 64
QUERY_GROUP = 512
#: Greatest quantised component: products of 512 such components stay within 64 bits.
LIMIT = 1 << 27
U64 = np.uint64


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, as long; an error beyond ``LIMIT``."""
    whole = lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))
    return F.transform(vector, lambda x: F.when(F.abs(whole(x)) <= LIMIT, whole(x)).otherwise(F.raise_error(F.lit("a component is too large for 64-bit scores")).cast("long")))


def finite(vector: Column) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, bad)


def _matrix(vectors: list) -> np.ndarray:
    out = np.zeros((len(vectors), max((len(v) for v in vectors), default=0)), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def slices(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least value of each attribute, and bitmaps (attributes, bits, words) of the rest."""
    low = x.min(axis=0) if len(x) else np.zeros(x.shape[1], np.int64)
    rest = x - low
    bits = max(1, int(rest.max()).bit_length()) if rest.size else 1
    words = -(-len(x) // 64)
    out = np.zeros((x.shape[1], bits, words * 8), np.uint8)
    for b in range(bits):
        packed = np.packbits(((rest >> b) & 1).astype(np.uint8).T, axis=1, bitorder="little")
        out[:, b, : packed.shape[1]] = packed
    return low, out.view(U64)


def _add(columns: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Carry-save addition: one bitmap for each bit of the sum."""
    out, k = [], 0
    while k < len(columns):
        left = columns[k]
        while len(left) > 1:
            if k + 1 == len(columns):
                columns.append([])
            a, b = left.pop(), left.pop()
            if left:
                c = left.pop()
                half = a ^ b
                columns[k + 1].append((a & b) | (half & c))
                left.append(half ^ c)
            else:
                columns[k + 1].append(a & b)
                left.append(a ^ b)
        out.append(left[0] if left else None)
        k += 1
    return out


def sums(low: np.ndarray, bitmaps: np.ndarray, q: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Bitmaps (queries, words) of the bits of score - base, and base of each query.

    Negative factors multiply the complement of an attribute, so that all terms are added.
    """
    dims, bits = min(bitmaps.shape[0], q.shape[1]), bitmaps.shape[1]
    q = q[:, :dims]
    size, top = np.abs(q), (1 << bits) - 1
    base = q @ low[:dims] - np.where(q < 0, size, 0).sum(axis=1) * top
    ones = U64(0xFFFFFFFFFFFFFFFF)
    columns: list[list[np.ndarray]] = [[] for _ in range(bits + max(1, int(size.max() if size.size else 0).bit_length()))]
    for j in range(dims):
        flip = np.where(q[:, j] < 0, ones, U64(0))[:, None]
        signed = [bitmaps[j, b][None, :] ^ flip for b in range(bits)]
        for a in range(int(size[:, j].max()).bit_length() if len(q) else 0):
            chosen = np.where((size[:, j] >> a) & 1 == 1, ones, U64(0))[:, None]
            for b in range(bits):
                column = columns[a + b]
                column.append(signed[b] & chosen)
                if len(column) >= 3:  # full adder
                    x, y, z = column.pop(), column.pop(), column.pop()
                    half = x ^ y
                    while len(columns) <= a + b + 1:
                        columns.append([])
                    columns[a + b + 1].append((x & y) | (half & z))
                    column.append(half ^ z)
    zero = np.zeros((len(q), bitmaps.shape[2]), U64)
    return [zero if s is None else s for s in _add(columns)], base


def select(bits: list[np.ndarray], allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of the rows surely among the k greatest, and of the boundary rows, of equal sum."""
    sure, open_ = np.zeros_like(allowed), allowed.copy()
    have = np.zeros(len(allowed), np.int64)
    for s in reversed(bits):
        x = open_ & s
        n = np.bitwise_count(x).sum(axis=1, dtype=np.int64) + have
        fewer = (n <= k)[:, None]
        sure = np.where(fewer, sure | x, sure)
        open_ = np.where(fewer, open_ & ~s, x)
        have = np.where(fewer[:, 0], n, have)
        open_[have == k] = 0
    return sure, open_


def _rows(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def search(ids: np.ndarray, low: np.ndarray, bitmaps: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int) -> tuple[list, list, list]:
    """(query id, row id, score) of the k best rows of a block for each query; ``ids`` ascending."""
    out: tuple[list, list, list] = ([], [], [])
    for at in range(0, len(q), QUERIES):
        part, own = q[at : at + QUERIES], query_ids[at : at + QUERIES]
        bits, base = sums(low, bitmaps, part)
        allowed = np.zeros((len(part), bitmaps.shape[2] * 64), np.uint8)
        allowed[:, : len(ids)] = ids[None, :] != own[:, None]
        allowed = np.packbits(allowed, axis=1, bitorder="little").view(U64)
        sure, boundary = select(bits, allowed, k)
        for i in range(len(part)):
            best = _rows(sure[i])
            if len(best) < k:
                best = np.concatenate([best, _rows(boundary[i])[: k - len(best)]])
            score = np.full(len(best), base[i])
            for e, s in enumerate(bits):
                score += ((s[i, best >> 6] >> (best & 63).astype(U64)) & U64(1)).astype(np.int64) << e
            out[0].extend([own[i]] * len(best))
            out[1].extend(ids[best])
            out[2].extend(score)
    return out


INDEX = "block long, ids binary, low binary, bitmaps binary, dims int, bits int"


def build_index(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """``rows`` (vec_id, v array<long>) as bit-sliced blocks; made inside input partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 32
        held: list[tuple] = []

        def flush():
            nonlocal number
            held.sort(key=lambda r: r[0])
            x = _matrix([r[1] for r in held])
            low, bitmaps = slices(x)
            row = (number, np.array([r[0] for r in held], np.int64).tobytes(), low.tobytes(), bitmaps.tobytes(), x.shape[1], bitmaps.shape[1])
            number += 1
            held.clear()
            names = [c.split()[0] for c in INDEX.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.int32()])], names)

        for batch in batches:
            for vec_id, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.append((vec_id, v))
                if len(held) == block:
                    yield flush()
        if held:
            yield flush()

    return rows.mapInArrow(run, INDEX)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's ``k`` greatest scores."""
    part = lambda df: df.where(finite(F.col(vector_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), quantised(F.col(vector_col), scale).alias("v"))
    index = stored(build_index(part(vectors)), "slices")
    asked = part(queries).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = stored(asked, "queries")
    cells = max(1, index.count())
    groups = -(-max(1, asked.count()) // QUERY_GROUP)
    blocks = index.withColumn("cell", F.pmod(F.xxhash64("block"), F.lit(cells))).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    asks = asked.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int")).withColumn("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells - 1).cast("long"))))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found: tuple[list, list, list] = ([], [], [])
        if len(left) and len(right):
            query_ids, q = right.vec_id.to_numpy(), _matrix(list(right.v))
            for r in left.itertuples():
                ids = np.frombuffer(r.ids, np.int64)
                bitmaps = np.frombuffer(r.bitmaps, U64).reshape(r.dims, r.bits, -1)
                for have, more in zip(found, search(ids, np.frombuffer(r.low, np.int64), bitmaps, query_ids, q, k)):
                    have.extend(more)
        return pd.DataFrame({"query_id": np.array(found[0], np.int64), "vec_id": np.array(found[1], np.int64), "score": np.array(found[2], np.int64)})

    near = blocks.groupBy("cell", "part").cogroup(asks.groupBy("cell", "part")).applyInPandas(meet, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_exact_top_k(spark, sf_dir: str) -> DataFrame:
    from .tables import table

    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


ORACLE = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, e.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * e.v[i])) AS BIGINT) AS score
  FROM e q JOIN e ON q.vec_id % 50 = 0 AND q.vec_id <> e.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
