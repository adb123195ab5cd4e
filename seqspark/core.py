"""Ordered sequences over DataFrames.

A ``Sequence`` is a DataFrame with a total order. Order-dependent operators do not sort everything into one
task: the order is cut into chunks, windows run inside chunks, and what crosses a chunk's edge is carried by
a table with a row for each chunk.

Chunks follow the size of the input. Cuts are keys of the order, taken from a sample of fixed size for each chunk;
where its leading column repeats, the columns after it (of any sortable type) cut on. They are found
once for all layers that keep the order, and any cuts give the same results.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

CHUNK = "_chunk"
#: Input bytes of a chunk, the most chunks, and rows sampled for each.
CHUNK_BYTES, MAX_CHUNKS, SAMPLE = 256 << 20, 16_384, 20
#: Cuts that one expression tells apart; more are met in two steps.
FANOUT = 128


def null_safe(op: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    """``op`` that skips nulls, as SQL aggregates do."""
    return lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(op(a, b))


@dataclass(frozen=True)
class Monoid:
    """An associative operation: its aggregate and its combination of two results."""

    fold: Callable[[Column], Column]
    combine: Callable[[Column, Column], Column]


MONOIDS: dict[str, Monoid] = {
    "sum": Monoid(F.sum, null_safe(lambda a, b: a + b)),
    "count": Monoid(F.count, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "product": Monoid(F.product, null_safe(lambda a, b: a * b)),
    "min": Monoid(F.min, null_safe(F.least)),
    "max": Monoid(F.max, null_safe(F.greatest)),
    "bit_and": Monoid(F.bit_and, null_safe(lambda a, b: a.bitwiseAND(b))),
    "bit_or": Monoid(F.bit_or, null_safe(lambda a, b: a.bitwiseOR(b))),
    "bit_xor": Monoid(F.bit_xor, null_safe(lambda a, b: a.bitwiseXOR(b))),
    "bool_and": Monoid(F.bool_and, null_safe(lambda a, b: a & b)),
    "bool_or": Monoid(F.bool_or, null_safe(lambda a, b: a | b)),
}


def monoid(op: str | Monoid) -> Monoid:
    if isinstance(op, Monoid):
        return op
    if op not in MONOIDS:
        raise ValueError(f"unknown operation {op!r}; give a Monoid or one of {sorted(MONOIDS)}")
    return MONOIDS[op]


@dataclass(frozen=True)
class Sequence:
    """``order``: columns of a total order, '-name' for descending. ``chunks``: None follows the size, the shuffle partitions at least."""

    df: DataFrame
    order: tuple[str, ...]
    chunks: int | None = None
    like: Sequence | None = field(default=None, repr=False, compare=False)  # its cuts are taken

    def __post_init__(self):
        object.__setattr__(self, "order", (self.order,) if isinstance(self.order, str) else tuple(self.order))
        missing = [c for c in self.names if c not in self.df.columns]
        if missing or not self.order:
            raise ValueError(f"order columns {missing or 'none'} are not in the DataFrame")

    @property
    def names(self) -> list[str]:
        return [c.removeprefix("-") for c in self.order]

    def by(self, backwards: bool = False) -> list[Column]:
        return [F.col(c.removeprefix("-")).desc() if c.startswith("-") != backwards else F.col(c.removeprefix("-")).asc() for c in self.order]

    def with_df(self, df: DataFrame) -> Sequence:
        """Another DataFrame in the same order, cut at the same keys."""
        return replace(self, df=df, like=self.like or self)

    def check(self) -> Sequence:
        """Raise if the order has ties; costs a job."""
        if self.df.groupBy(*self.names).count().where("count > 1").limit(1).count():
            raise ValueError(f"{self.names} do not order the rows totally")
        return self

    @property
    def down(self) -> bool:
        return self.order[0].startswith("-")

    @cached_property
    def lead(self) -> list[str]:
        """The first columns of the order that go one way."""
        n = next((i for i, c in enumerate(self.order) if c.startswith("-") != self.down), len(self.order))
        return self.names[:n]

    def n_chunks(self) -> int:
        if self.chunks:
            return self.chunks
        size = int(str(self.df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        return max(int(self.df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(size // CHUNK_BYTES, MAX_CHUNKS))

    @cached_property
    def cuts(self) -> list[tuple]:
        """Ascending keys between chunks, of the leading column if it has enough values, else of all of ``lead``."""
        if self.like is not None:
            return self.like.cuts
        n = self.n_chunks()
        if n < 2:
            return []
        some = self.df.select(*self.lead).orderBy(F.rand(20240229)).limit(SAMPLE * n).orderBy(*self.lead).collect()  # SAMPLE rows a chunk
        keys = [tuple(some[i * len(some) // n]) for i in range(1, n)] if some else []
        alone = [k[:1] for k in keys if k[0] is not None]
        keys = alone if len(set(alone)) == len(keys) else keys
        return [k for i, k in enumerate(keys) if not i or k != keys[i - 1]]

    def _cut(self, key: tuple) -> Column:
        kinds = [self.df.schema[c].dataType for c in self.lead]
        values = [F.lit(v).cast(t) for v, t in zip(key, kinds)]
        return F.struct(*[v.alias(f"k{i}") for i, v in enumerate(values)]) if len(key) > 1 else values[0]

    @cached_property
    def chunked(self) -> DataFrame:
        """The rows with their chunk's number, which never decreases along the order."""
        if CHUNK in self.df.columns:
            return self.df
        if not self.cuts:
            return self.df.withColumn(CHUNK, F.lit(0))
        width = len(self.cuts[0])
        own = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(self.lead)]) if width > 1 else F.col(self.lead[0])
        step = -(-len(self.cuts) // FANOUT)
        coarse = self.cuts[step - 1 :: step]  # cut number step, 2 * step, ...

        def place(lo: int, hi: int) -> Column:
            if lo == hi:
                return F.lit(lo)
            mid = (lo + hi) // 2
            return F.when(own < self._cut(coarse[mid]), place(lo, mid)).otherwise(place(mid + 1, hi))

        at = place(0, len(coarse))
        at = F.when(own.isNull(), F.lit(0)).otherwise(at) if width == 1 else at
        df = self.df
        if step > 1:  # at most FANOUT lists of step - 1 cuts, MAX_CHUNKS in all
            spark = df.sparkSession
            lists = [F.array(*[self._cut(k) for k in self.cuts[i * step : (i + 1) * step - 1]]) for i in range(len(coarse) + 1)]
            fine = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(i).alias("_coarse"), x.alias("_fine")) for i, x in enumerate(lists) if len(self.cuts[i * step : (i + 1) * step - 1])])).alias("f")).select("f.*")
            df = df.withColumn("_coarse", at).join(F.broadcast(fine), "_coarse", "left")
            below = F.coalesce(F.size(F.filter("_fine", lambda c: own >= c)), F.lit(0))
            at = F.col("_coarse") * step + F.when(own.isNull(), 0).otherwise(F.greatest(below, F.lit(0))) if width == 1 else F.col("_coarse") * step + F.greatest(below, F.lit(0))
        return df.withColumn(CHUNK, -at if self.down else at).drop("_coarse", "_fine")

    def window(self, *keys: str) -> WindowSpec:
        return Window.partitionBy(CHUNK, *keys).orderBy(*self.by())

    def extreme(self, value: str, last: bool) -> Column:
        """Aggregate: ``value`` of the first or last row, where all of the order goes one way."""
        key = F.struct(*self.names)
        return F.max_by(value, key) if last != self.down else F.min_by(value, key)


@dataclass(frozen=True)
class Running:
    """One running fold for ``scan_many``."""

    value: Column
    op: str | Monoid = "sum"
    exclusive: bool = False
    init: object = None
    total: bool = False  # of all rows, for each row

    def before(self, x: Column) -> Column:
        """How totals of chunks combine: counts add up."""
        return F.sum(x) if self.op == "count" else monoid(self.op).fold(x)

    def result(self, carry: Column, local: Column) -> Column:
        if self.total:
            return carry
        m = monoid(self.op)
        y = m.combine(carry, local)
        return y if self.init is None else m.combine(self.init if isinstance(self.init, Column) else F.lit(self.init), y)


def scan_many(seq: Sequence, folds: dict[str, Running]) -> DataFrame:
    """Several running folds over one order, by name, in one pass."""
    values = {n: f"_x{i}" for i, n in enumerate(folds)}
    df = seq.chunked.select("*", *[folds[n].value.alias(x) for n, x in values.items()])
    totals = df.groupBy(CHUNK).agg(*[monoid(folds[n].op).fold(F.col(x)).alias(f"_t{x}") for n, x in values.items()])
    before = Window.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)  # a row a chunk
    whole = Window.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carry = totals.select(CHUNK, *[folds[n].before(F.col(f"_t{x}")).over(whole if folds[n].total else before).alias(f"_c{x}") for n, x in values.items()])
    frame = seq.window()
    local = [(F.lit(None) if folds[n].total else monoid(folds[n].op).fold(F.col(x)).over(frame.rowsBetween(Window.unboundedPreceding, -1 if folds[n].exclusive else 0))).alias(f"_l{x}") for n, x in values.items()]
    joined = df.select("*", *local).join(F.broadcast(carry), CHUNK)
    results = {n: folds[n].result(F.col(f"_c{x}"), F.col(f"_l{x}")) for n, x in values.items()}
    return joined.select(*[c for c in seq.df.columns if c not in folds], *[y.alias(n) for n, y in results.items()])


def scan(seq: Sequence, value: str | Column, op: str | Monoid = "sum", out: str = "y", exclusive: bool = False, init=None) -> DataFrame:
    """Running fold. Inclusive: x0 .. xi, with ``init`` first if given. Exclusive: ``init`` and x0 .. x(i-1)."""
    return scan_many(seq, {out: Running(F.col(value) if isinstance(value, str) else value, op, exclusive, init)})


def position(seq: Sequence, out: str = "pos") -> DataFrame:
    """0-based position of each row in the order."""
    return scan(seq, F.lit(1), "count", out, exclusive=True).withColumn(out, F.col(out).cast("long"))


def _neighbour(seq: Sequence, values: dict[str, Column], step: int, first: str) -> DataFrame:
    packed = F.struct(*[v.alias(n) for n, v in values.items()])
    df = seq.chunked.withColumn("_v", packed)
    near = F.lag if step < 0 else F.lead
    if len(seq.lead) == len(seq.order):
        edge = df.groupBy(CHUNK).agg(seq.extreme("_v", step < 0).alias("_v"))
    else:
        order = seq.by(backwards=step < 0)
        edge = df.withColumn("_rn", F.row_number().over(Window.partitionBy(CHUNK).orderBy(*order))).where("_rn = 1").select(CHUNK, "_v")
    crossing = edge.select(CHUNK, near("_v").over(Window.orderBy(CHUNK)).alias("_edge"))  # a row a chunk
    df = df.withColumn("_beside", near("_v").over(seq.window())).join(F.broadcast(crossing), CHUNK)
    df = df.withColumn("_beside", F.coalesce("_beside", "_edge")).withColumn(first, F.col("_beside").isNull())
    for n in values:
        df = df.withColumn(n, F.col("_beside")[n])
    return df.drop(CHUNK, "_v", "_beside", "_edge")


def previous(seq: Sequence, values: dict[str, Column], first: str = "_first") -> DataFrame:
    """Columns ``values`` of the row before, and whether there is none."""
    return _neighbour(seq, values, -1, first)


def following(seq: Sequence, values: dict[str, Column], last: str = "_last") -> DataFrame:
    """Columns ``values`` of the row after, and whether there is none."""
    return _neighbour(seq, values, 1, last)


@dataclass(frozen=True)
class Runs:
    """What begins a run: a change of ``keys`` (null-safe, or by ``equal`` of the columns before and now), or a true ``flag``.

    The first row of all begins a run in any case.
    """

    keys: tuple[str, ...] = ()
    equal: Callable[[dict, dict], Column] | None = None
    flag: str | Column | None = None

    def packed(self) -> Column:
        if self.flag is not None:
            flag = F.col(self.flag) if isinstance(self.flag, str) else self.flag
            return F.struct(F.coalesce(flag.cast("boolean"), F.lit(False)).alias("k0"))
        return F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(self.keys)])

    def begins(self, before: str, now: str) -> Column:
        """Whether the row packed as ``now`` begins a run after the one packed as ``before``."""
        a, b = ([F.col(x)[f"k{i}"] for i in range(max(1, len(self.keys)))] for x in (before, now))
        if self.flag is not None:
            return b[0]
        if self.equal is not None:
            return ~F.coalesce(self.equal(dict(zip(self.keys, a)), dict(zip(self.keys, b))), F.lit(False))
        same = F.lit(True)
        for x, y in zip(a, b):
            same = same & x.eqNullSafe(y)
        return ~same


def scan_runs(seq: Sequence, runs: Runs, folds: dict[str, Running] | None = None, number: str | None = None, place: str | None = None, head: str | None = None) -> DataFrame:
    """Folds that restart with each run; the run's number from 0, the row's position and whether it begins a run, as named.

    One pass: a run may span chunks, so each chunk's row in the carried table has its first and last key, its number of
    runs and the folds of its last one, and the chunks that one run fills are chained.
    """
    folds = folds or {}
    values = {n: f"_x{i}" for i, n in enumerate(folds)}
    w = seq.window()
    df = seq.chunked.select("*", runs.packed().alias("_k"), *[folds[n].value.alias(x) for n, x in values.items()])
    df = df.select("*", F.lag("_k").over(w).alias("_p"), F.row_number().over(w).alias("_i"))
    df = df.withColumn("_h", F.when(F.col("_i") == 1, F.lit(False)).otherwise(runs.begins("_p", "_k")))
    df = df.withColumn("_r", F.sum(F.col("_h").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))

    tails = [monoid(folds[n].op).fold(F.col(x)).alias(f"_t{x}") for n, x in values.items()]
    each = df.groupBy(CHUNK, "_r").agg(F.count("*").alias("_n"), F.min_by("_k", "_i").alias("_f"), F.max_by("_k", "_i").alias("_l"), *tails)
    one = each.groupBy(CHUNK).agg(F.sum("_n").alias("_n"), F.max("_r").alias("_runs"), F.min_by("_f", "_r").alias("_f"), F.max_by("_l", "_r").alias("_l"), *[F.max_by(f"_t{x}", "_r").alias(f"_t{x}") for x in values.values()])
    order = Window.orderBy(CHUNK)  # a row a chunk, here and below
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    one = one.withColumn("_q", F.lag("_l").over(order))
    one = one.withColumn("_joins", F.when(F.col("_q").isNull(), F.lit(False)).otherwise(~runs.begins("_q", "_f")))
    one = one.withColumn("_chain", F.sum(F.when(F.col("_joins") & (F.col("_runs") == 0), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    chain = Window.partitionBy("_chain").orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, 0)
    one = one.select("*", *[folds[n].before(F.col(f"_t{x}")).over(chain).alias(f"_o{x}") for n, x in values.items()])
    new = F.when(F.col("_joins"), 0).otherwise(1)
    carry = one.select(
        CHUNK,
        "_joins",
        (F.coalesce(F.sum(F.col("_runs") + new).over(before), F.lit(0)) + new - 1).alias("_number"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"),
        *[F.when(F.col("_joins"), F.lag(f"_o{x}").over(order)).alias(f"_c{x}") for x in values.values()],
    )
    inside = seq.window("_r")
    local = [monoid(folds[n].op).fold(F.col(x)).over(inside.rowsBetween(Window.unboundedPreceding, -1 if folds[n].exclusive else 0)).alias(f"_l{x}") for n, x in values.items()]
    out = df.select("*", *local).join(F.broadcast(carry), CHUNK)
    extra = {n: folds[n].result(F.when(F.col("_r") == 0, F.col(f"_c{x}")), F.col(f"_l{x}")) for n, x in values.items()}
    if number:
        extra[number] = (F.col("_number") + F.col("_r")).cast("long")
    if place:
        extra[place] = (F.col("_start") + F.col("_i") - 1).cast("long")
    if head:
        extra[head] = F.col("_h") | ((F.col("_i") == 1) & ~F.col("_joins"))
    return out.select(*[c for c in seq.df.columns if c not in extra and c != CHUNK], *[y.alias(n) for n, y in extra.items()])


def heads(seq: Sequence, keys: list[str], equal: Callable[[dict, dict], Column] | None = None, out: str = "head") -> DataFrame:
    """Whether a row begins a run: the first, or one not equal to its predecessor (null-safe on ``keys``).

    ``equal`` gets the columns of the row before and of the row, by name.
    """
    return scan_runs(seq, Runs(tuple(keys), equal), head=out)


def islands(seq: Sequence, keys: list[str], equal=None, out: str = "island", pos: str | None = None) -> DataFrame:
    """0-based number of the run of consecutive equal ``keys`` that each row is in; and its position if asked."""
    return scan_runs(seq, Runs(tuple(keys), equal), number=out, place=pos)


def tiles(seq: Sequence, size: int) -> DataFrame:
    """Fixed-size tiles: ``pos``, ``tile`` = pos / size and ``lane`` = pos % size."""
    return position(seq).withColumn("tile", F.floor(F.col("pos") / size)).withColumn("lane", (F.col("pos") % size).cast("int"))
