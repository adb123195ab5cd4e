"""Chunks, runs over chunk edges, operations that do not commute, and exact sums."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqspark import core
from seqspark.core import CHUNK, Running, Runs, Sequence, position, scan_runs
from seqspark.functions import arrays
from seqspark.functions.exact import Exact
from seqspark.operators import ordered, reduce, scans, sorting


def rows_of(spark, rows, schema, order, chunks):
    return Sequence(spark.createDataFrame(rows, schema).repartition(3), order, chunks)


@pytest.mark.parametrize("order", [("k", "i"), ("-k", "-i"), ("k", "-i"), ("-k", "i")])
@pytest.mark.parametrize("fanout", [128, 3])
def test_positions_for_repeated_and_string_leads(spark, monkeypatch, order, fanout):
    monkeypatch.setattr(core, "FANOUT", fanout)
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", "é", "b", None]), i) for i in range(200)]
    s = rows_of(spark, rows, "k string, i int", order, 16)
    if len(s.lead) == 2:
        assert s.chunked.select(CHUNK).distinct().count() > 6
    key = lambda r: (r[0] is not None, r[0] or "")
    want = sorted(rows, key=lambda r: r[1], reverse=order[1].startswith("-"))
    want = sorted(want, key=key, reverse=order[0].startswith("-"))
    assert [tuple(r)[:2] for r in position(s).orderBy("pos").collect()] == want


def test_any_cuts_give_the_same_runs(spark):
    rng = random.Random(8)
    keys = [k for k in range(40) for _ in range(rng.choice([1, 1, 2, 9, 60]))]
    rows = [(i, k % 3 if k % 7 else None, rng.randrange(100), rng.random() < 0.1) for i, k in enumerate(keys)]
    want = None
    for chunks in (1, 2, 7, 200):
        s = rows_of(spark, rows, "i int, k int, x int, f boolean", ("i",), chunks)
        by_key = scan_runs(s, Runs(("k",)), {"y": Running(F.col("x")), "c": Running(F.col("x"), "count", exclusive=True), "m": Running(F.col("x"), "max", init=50)}, "n", "p", "h")
        by_flag = scan_runs(s, Runs(flag="f"), {"y": Running(F.col("x"), exclusive=True, init=0)}, "n")
        got = [sorted(tuple(r) for r in df.orderBy("i").collect()) if df is by_flag else [tuple(r) for r in df.orderBy("i").collect()] for df in (by_key, by_flag)]
        want = want or got
        assert got == want
    run, total, n = -1, 0, 0
    for (i, k, x, f), r in zip(rows, want[0]):
        head = i == 0 or k != rows[i - 1][1]
        run, total, n, top = (run + 1, 0, 0, 50) if head else (run, total, n, top)
        total, top = total + x, max(top, x)
        assert r[:4] == (i, k, x, f) and r[4:] == (total, n, top, run, i, head)
        n += 1


def test_cuts_are_kept_by_layers_in_the_same_order(spark):
    s = rows_of(spark, [(i, i) for i in range(50)], "i int, x int", ("i",), 5)
    cuts = s.cuts
    assert s.with_df(s.df.withColumn("y", F.lit(1))).cuts is cuts and len(cuts) == 4
    assert Sequence(s.df.limit(0), ("i",), 4).cuts == []


@pytest.mark.parametrize("chunks", [1, 3, 30])
def test_operations_that_do_not_commute(spark, chunks):
    affine = lambda f, g: {"a": f["a"] * g["a"] % 1009, "b": (g["a"] * f["b"] + g["b"]) % 1009}
    rng = random.Random(chunks)
    rows = [(i, i // 7 % 3, rng.randrange(1, 1009), rng.randrange(1009)) for i in range(100)]
    s = rows_of(spark, rows, "i int, k int, a long, b long", ("-i",), chunks)
    state, want, by_key, last = (1, 0), [], [], None
    for i, k, a, b in rows[::-1]:
        state = (state[0] * a % 1009, (a * state[1] + b) % 1009)
        own = (a, b) if k != last else (own[0] * a % 1009, (a * own[1] + b) % 1009)
        last = k
        want.append(state)
        by_key.append(own)
    get = lambda df: [(r.a, r.b) for r in df.orderBy(F.desc("i")).collect()]
    assert get(ordered.scan(s, ["a", "b"], affine)) == want
    begin = {"a": 5, "b": 3}
    moved = [(5 * a % 1009, (a * 3 + b) % 1009) for a, b in [(1, 0), *want]]
    assert get(ordered.scan(s, ["a", "b"], affine, exclusive=True, init=begin)) == moved[:-1]
    assert get(ordered.scan(s, ["a", "b"], affine, init=begin)) == moved[1:]
    assert [(r.a, r.b) for r in ordered.reduce(s, ["a", "b"], affine).collect()] == want[-1:]
    assert get(ordered.scan_by_key(s, ["k"], ["a", "b"], affine)) == by_key
    ends = [x for x, (i, k, *_), nxt in zip(by_key, rows[::-1], [*[r[1] for r in rows[::-1]][1:], None]) if k != nxt]
    assert [(r.a, r.b) for r in ordered.reduce_by_key(s, ["k"], ["a", "b"], affine).orderBy("island").collect()] == ends
    none = Sequence(s.df.limit(0), ("i",), chunks)
    assert ordered.scan(none, ["a", "b"], affine).count() == ordered.reduce(none, ["a", "b"], affine).count() == 0
    with pytest.raises(ValueError):
        ordered.scan(s, ["a", "b"], affine, exclusive=True)


def test_opaque_functions(spark):
    df = spark.createDataFrame([(i, i) for i in range(20)], "i int, x long")
    got = ordered.map_vectors(df, lambda v: {"y": np.sqrt(v["x"]), "x": v["x"] + 1}, "y double, x long")
    assert sorted((r.i, r.x, r.y) for r in got.collect()) == [(i, i + 1, math.sqrt(i)) for i in range(20)]
    assert sorted(r.i for r in ordered.filter_vectors(df, lambda v: v["x"] % 3 == 0).collect()) == list(range(0, 20, 3))


def test_exact_sums_are_rounded_once_for_any_cuts(spark):
    rng = random.Random(1)
    xs = [rng.choice([1e12, 1.0, 1e-3]) * rng.uniform(-1, 1) for _ in range(300)] + [0.0, 0.1, -0.1]
    for chunks in (1, 9):
        s = rows_of(spark, list(enumerate(xs)), "i int, x double", ("i",), chunks)
        exact = Exact(s.df, "x")
        got = [exact.back(F.col("y")).alias("y")]
        assert [r.y for r in scans.inclusive_scan(s, exact()).orderBy("i").select(*got).collect()] == [math.fsum(xs[: i + 1]) for i in range(len(xs))]
        assert reduce.reduce(s.df, exact()).select(*got).first().y == math.fsum(xs)
    for bad in ([1e300, 1e-300], [float("inf")], [float("nan")]):
        with pytest.raises(ValueError):
            Exact(spark.createDataFrame([(x,) for x in bad], "x double"), "x")
    empty = Exact(s.df.limit(0), "x")
    assert reduce.reduce(s.df.limit(0), empty()).select(empty.back(F.col("y")).alias("y")).first().y is None


def test_codes_of_doubles_and_of_64_bits(spark):
    xs = [float("-inf"), -2.5, -1e-300, -0.0, 0.0, 5e-324, 1.0, float("inf"), float("nan"), None]
    got = spark.createDataFrame(list(enumerate(xs)), "i int, x double").coalesce(1).select("i", "x", arrays.encode_double("x").alias("c")).select("i", "c", arrays.decode_double("c").alias("back")).orderBy("i").collect()
    codes = [r.c for r in got]
    assert codes[:-1] == sorted(codes[:-1]) and len(set(codes)) == len(codes) and codes[-1] is None
    assert [repr(r.back) for r in got] == [repr(x) for x in xs]
    ks = [-(2**63), -1, 0, 1, 2**63 - 1]
    df = spark.createDataFrame(list(enumerate(ks)), "i int, k long")
    for down in (False, True):
        code = arrays.encode_key(F.col("k"), 64, down)
        rows = df.select("i", "k", code.alias("c"), arrays.decode_key(code, 64, down).alias("back")).orderBy("i").collect()
        unsigned = [r.c % 2**64 for r in rows]
        assert unsigned == sorted(unsigned, reverse=down) and all(r.k == r.back for r in rows)


def test_selection_of_many_rows(spark, monkeypatch):
    monkeypatch.setattr(sorting, "TAKEN", 3)
    s = rows_of(spark, [(i, (7 * i) % 40) for i in range(40)], "i int, x int", ("i",), 6)
    assert sorted((r.pos, r.x) for r in sorting.partial_sort_copy(s, "x", 10).collect()) == [(k, k) for k in range(11)]
    for n in (0, 17, 39):
        assert {r.x: r.side for r in sorting.nth_element(s, "x", n).collect()} == {x: (x > n) - (x < n) for x in range(40)}
