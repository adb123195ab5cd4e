"""Literal inputs and outputs of each operator; sequences are cut into several chunks on purpose."""

import pytest
from pyspark.sql import functions as F

from seqspark.core import Sequence, position, tiles
from seqspark.functions import arrays
from seqspark.operators import basic, copy, difference, histogram, reduce, scans, search, sorting
from seqspark.operators import tiles as tile
from seqspark.sources import iterators


def seq(spark, **columns):
    n = len(next(iter(columns.values())))
    rows = [(i, *[c[i] for c in columns.values()]) for i in range(n)]
    return Sequence(spark.createDataFrame(rows, ["pos0", *columns]).repartition(3), ("pos0",), chunks=3)


def out(df, *names, by="pos0"):
    rows = df.orderBy(by).collect()
    return [tuple(r[n] for n in names) if len(names) > 1 else r[names[0]] for r in rows]


EIGHT, FLAGS = list(range(1, 9)), [0, 1, 1, 0, 0, 1, 0, 1]
KEYS, MIN8 = [1, 1, 1, 2, 10, 10, 10, 88], [4, 7, 6, 2, 5, 1, 3, 8]


def test_select_and_partitions(spark):
    s = seq(spark, x=EIGHT, f=FLAGS)
    assert out(basic.select(s.df, "f"), "x") == [2, 3, 6, 8]
    assert out(basic.partition(s, "f"), "x", by="out_pos") == [2, 3, 6, 8, 7, 5, 4, 1]
    assert out(basic.partition(s, F.col("f") == 1), "out_pos", by="out_pos") == list(range(8))
    three = basic.partition_three_way(s.df, F.col("x") % 2 == 0, F.col("x") % 3 == 0)
    assert out(three, "part") == [2, 0, 1, 0, 2, 0, 2, 0]
    assert out(basic.unique(seq(spark, x=[1, 4, 2, 4, 4, 7, 7, 7]), "x"), "x") == [1, 4, 2, 4, 7]
    nulls = seq(spark, x=[1, None, None, 1])
    assert out(basic.unique(nulls, "x"), "x") == [1, None, 1]
    assert out(basic.select(nulls.df, F.col("x") == 1), "x") == [1, 1]


def test_folds(spark):
    s = seq(spark, x=MIN8)
    assert reduce.reduce(s.df, "x", "min", 9).first().y == 1
    assert reduce.reduce(s.df.limit(0), "x", "min", 9).first().y == 9
    csr = spark.createDataFrame([(0, 0, 2), (1, 2, 3), (2, 3, 8), (3, 5, 5)], "seg int, begin long, end long")
    assert out(reduce.segmented_reduce(s, csr, "seg", "x", "min", 9), "y", by="seg") == [4, 6, 1, 9]
    k = seq(spark, k=KEYS, v=EIGHT)
    assert out(reduce.reduce_by_key(k, ["k"], {"y": F.sum("v")}), "k", "y", by="island") == [(1, 6), (2, 4), (10, 18), (88, 8)]
    assert out(reduce.run_length_encode(k, "k"), "k", "run_length", by="island") == [(1, 3), (2, 1), (10, 3), (88, 1)]
    assert out(reduce.non_trivial_runs(k, "k"), "start", "run_length", by="start") == [(0, 3), (4, 3)]
    never = reduce.run_length_encode(seq(spark, k=[1, 1, 1]), "k", equal=lambda a, b: F.lit(False))
    assert never.count() == 3
    ties = spark.createDataFrame([(3, 1), (1, 1), (2, 5), (0, 5)], "k int, v int")
    assert tuple(reduce.arg_min(ties, "k", "v").first()) == (1, 1) and tuple(reduce.arg_max(ties, "k", "v").first()) == (0, 5)
    runs = spark.createDataFrame([("a", 2), ("b", 0), ("c", 1)], "x string, n int")
    assert out(reduce.run_length_decode(runs, "n"), "x", "run_offset", by=["x", "run_offset"]) == [("a", 0), ("a", 1), ("c", 0)]


def test_scans(spark):
    assert out(scans.exclusive_scan(seq(spark, x=MIN8), "x", 9, "min"), "y") == [9, 4, 4, 4, 2, 2, 1, 1]
    k = seq(spark, k=[1, 1, 1, 2, 2, 3, 3, 4], v=EIGHT)
    assert out(scans.exclusive_scan_by_key(k, ["k"], "v", 9), "y") == [9, 10, 12, 9, 13, 9, 15, 9]
    f = seq(spark, x=EIGHT, f=[1, 0, 0, 1, 0, 1, 0, 0])
    assert out(scans.segmented_scan_flags(f, "f", "x"), "y") == [1, 3, 6, 4, 9, 6, 13, 21]
    first_unset = seq(spark, x=EIGHT, f=[0, 0, 0, 1, 0, 1, 0, 0])
    assert out(scans.segmented_scan_flags(first_unset, "f", "x"), "y") == [1, 3, 6, 4, 9, 6, 13, 21]
    csr = spark.createDataFrame([(0, 0, 4), (1, 2, 3), (2, 6, 6)], "seg int, begin long, end long")
    got = scans.segmented_scan(seq(spark, x=EIGHT), csr, "seg", "x", exclusive=True, init=100)
    assert out(got, "seg", "y", by=["seg", "pos"]) == [(0, 100), (0, 101), (0, 103), (0, 106), (1, 100)]


@pytest.mark.parametrize("chunks", [2, 50])
@pytest.mark.parametrize("op", ["sum", "count", "product", "min", "max", "bit_and", "bit_or", "bit_xor"])
def test_scan_for_any_chunks(spark, chunks, op):
    xs = [(7 * i * i + 3) % 11 + 1 for i in range(30)]
    fold = {"sum": lambda a: sum(a), "count": len, "min": min, "max": max}
    import functools, math, operator

    fold |= {"product": math.prod, "bit_and": lambda a: functools.reduce(operator.and_, a), "bit_or": lambda a: functools.reduce(operator.or_, a), "bit_xor": lambda a: functools.reduce(operator.xor, a)}
    s = seq(spark, x=xs)
    s = Sequence(s.df, ("-pos0",), chunks)
    got = out(scans.inclusive_scan(s, "x", op), "y", by=F.desc("pos0"))
    assert got == [fold[op](xs[::-1][: i + 1]) for i in range(30)]


def test_differences(spark):
    s = seq(spark, x=EIGHT[::-1])
    assert out(difference.adjacent_difference(s, "x"), "y") == [8] + [-1] * 7
    assert out(difference.adjacent_difference_right(seq(spark, x=EIGHT), "x"), "y") == [-1] * 7 + [8]
    k = seq(spark, k=KEYS)
    both = difference.flag_heads_and_tails(k, "k")
    assert out(both, "head") == [True, False, False, True, True, False, False, True]
    assert out(both, "tail") == [False, False, True, True, False, False, True, True]
    assert out(difference.flag_heads(k, "k", outside=F.lit(1)), "head")[0] is False


def test_search_and_merge(spark):
    hay = spark.createDataFrame([(x,) for x in [0.0, 1.5, 3.0, 4.5, 6.0, 7.5, 9.0]], "h double")
    needles = spark.createDataFrame([(i, float(i)) for i in range(1, 6)], "id long, q double")
    assert out(search.lower_bound(hay, "h", needles, "q", "id", chunks=3), "bound", by="id") == [1, 2, 2, 3, 4]
    assert out(search.upper_bound(hay, "h", needles, "q", "id", chunks=3), "bound", by="id") == [1, 2, 3, 3, 4]
    digits = spark.createDataFrame([(i,) for i in range(10)], "h long")
    asked = spark.createDataFrame(list(enumerate([0, 2, 12, 4, 14, 6, 8, 10])), "id long, q long")
    assert out(search.binary_search(digits, "h", asked, "q"), "found", by="id") == [1, 1, 0, 1, 0, 1, 1, 0]
    a = seq(spark, k=[0, 1, 2, 3])
    assert out(search.merge(a, a, "k"), "k", "src", by="pos") == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 0), (2, 1), (3, 0), (3, 1)]


def test_histograms(spark):
    df = spark.createDataFrame([(x,) for x in [-10.0, 0.3, 9.5, 8.1, 1.5, 1.9, 100.0, 5.1]], "x double")
    assert out(histogram.histogram_even(df, "x", 6, 0, 10), "n", by="bin") == [3, 0, 1, 0, 2]
    assert out(histogram.histogram_range(df, "x", [0, 1, 5, 10, 20, 50]), "n", by="bin") == [1, 2, 3, 0, 0]
    with pytest.raises(ValueError):
        histogram.histogram_even(df, "x", 1, 0, 10)
    with pytest.raises(ValueError):
        histogram.histogram_even(df.select(F.col("x").cast("int").alias("x")), "x", 4, 0, 10)


def test_sorts_and_selection(spark):
    s = seq(spark, x=[6, 3, 5, 4, 1, 8, 2, 7])
    side = sorting.nth_element(s, "x", 4)
    assert {r.x for r in side.collect() if r.side == 0} == {5} and {r.x for r in side.collect() if r.side < 0} == {1, 2, 3, 4}
    with pytest.raises(ValueError):
        sorting.nth_element(s, "x", 8)
    assert out(sorting.partial_sort_copy(s, "x", 2), "x", by="pos") == [1, 2, 3]
    assert [r.x for r in sorting.partial_sort(s, "x", 3).orderBy("pos").collect() if r.pos is not None] == [1, 2, 3]
    same = seq(spark, x=[2, 2, 2])
    assert out(sorting.nth_element(same, "x", 1), "side") == [-1, 0, 1]
    signed = seq(spark, x=[3, -1, 0, -8])
    assert out(sorting.radix_sort(signed, "x"), "x", by="pos") == [-8, -1, 0, 3]
    assert out(sorting.radix_sort(signed, "x", descending=True), "x", by="pos") == [3, 0, -1, -8]
    assert out(sorting.radix_sort(signed, "x", 0, 2), "x", by="pos") == [0, -8, 3, -1]
    with pytest.raises(ValueError):
        sorting.radix_sort(seq(spark, x=[1.0]), "x", 0, 4)
    nan = seq(spark, x=[float("nan"), float("inf"), -0.0, 0.0, float("-inf")])
    assert out(sorting.merge_sort(nan, "x"), "pos0", by="pos") == [4, 2, 3, 1, 0]


def test_batch_copy(spark):
    buf = lambda name, xs: [(name, i, x) for i, x in enumerate(xs)]
    src = spark.createDataFrame(buf("a", [9, 1, 2, 3, 4, 5, 6, 7, 8]), "src_id string, off long, x int")
    dst = spark.createDataFrame(buf("b", [0] * 9), "dst_id string, off long, x int")
    moves = spark.createDataFrame([("a", 0, "b", 5, 3), ("a", 4, "b", 2, 2), ("a", 7, "b", 0, 2), ("a", 1, "b", 4, 0)], "src_id string, src_off long, dst_id string, dst_off long, len long")
    for bucket in (1024, 2):
        assert out(copy.batch_copy(src, dst, moves, bucket=bucket), "x", by="off") == [7, 8, 4, 5, 0, 9, 1, 2, 0]
    b = copy.batch_memcpy(spark.createDataFrame([("a", bytearray(b"912345678"))], "src_id string, data binary"), spark.createDataFrame([("b", bytearray(b"000000000"))], "dst_id string, data binary"), moves)
    assert bytes(b.first().data) == b"784509120"


def test_tiles_and_arrays(spark):
    t = tiles(seq(spark, x=EIGHT), 4)
    assert out(tile.reduce(t, "x"), "y", by="tile") == [10, 26]
    assert out(tile.scan(t, "x", exclusive=True, init=0), "y") == [0, 1, 3, 6, 0, 5, 11, 18]
    assert out(tile.shuffle_offset(t, "x", 1), "y") == [1, 1, 2, 3, 5, 5, 6, 7]
    assert out(tile.shuffle_rotate(t, "x", 1, 4), "y") == [2, 3, 4, 1, 6, 7, 8, 5]
    striped = tile.blocked_to_striped(t, 2, 2)
    assert out(tile.striped_to_blocked(striped, 2, 2), "lane") == [0, 1, 2, 3] * 2
    warp = tile.blocked_to_warp_striped(tiles(seq(spark, x=EIGHT), 8), 2, 2)
    assert out(tile.warp_striped_to_blocked(warp, 2, 2), "lane") == list(range(8))
    assert out(tile.ballot(t, F.col("x") % 2 == 1), "mask", by="tile") == [5, 5]
    assert tile.load(tiles(seq(spark, x=[1, 2, 3]), 2), "x", 2, -1).where("x = -1").count() == 1
    v = spark.createDataFrame([([4, 7, 6],), ([],)], "v array<int>")
    got = v.select(arrays.array_reduce(F.col("v"), F.least).alias("m"), arrays.array_scan(F.col("v"), lambda a, b: a + b, F.lit(0), True).alias("e")).collect()
    assert [tuple(r) for r in got] == [(4, [0, 4, 11]), (None, [])]


def test_sources_and_order(spark):
    a, b = seq(spark, x=[1, 2, 3]), Sequence(spark.createDataFrame([(5, "p"), (6, "q")], "k long, y string"), ("-k",))
    assert out(iterators.zipped(a, b), "x", "y", by="pos") == [(1, "q"), (2, "p")]
    assert out(position(iterators.reversed_(a)), "pos") == [2, 1, 0]
    assert out(iterators.counting(spark, 5, 3), "x", by="pos") == [5, 6, 7] and iterators.constant(spark, 1, 0).count() == 0
    iterators.discard(a.df)
    with pytest.raises(ValueError):
        Sequence(spark.createDataFrame([(1,), (1,)], "k int"), ("k",)).check()
    with pytest.raises(ValueError):
        Sequence(a.df, ("no such column",))
    assert position(Sequence(a.df.limit(0), ("pos0",))).count() == 0
