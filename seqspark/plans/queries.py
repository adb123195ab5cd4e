"""Queries over the given tables, at least one for each operator, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import Sequence, position, tiles
from ..functions import arrays, operators as ops
from ..functions.exact import Exact
from ..operators import basic, copy, difference, histogram, ordered, reduce, scans, search, sorting
from ..operators import tiles as tile
from ..sources import iterators
from .registry import query

LINE_ORDER = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate", "l_extendedprice")


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def cents(column: str):
    return F.round(F.col(column) * 100).cast("long")


def events(spark: SparkSession, sf: str) -> Sequence:
    return Sequence(read(spark, sf, "events").select("event_id", "user_id", "event_type", cents("value").alias("cents")), ("event_id",))


def orders(spark: SparkSession, sf: str) -> Sequence:
    return Sequence(read(spark, sf, "orders").select("o_orderkey", "o_custkey", cents("o_totalprice").alias("cents")), ("o_orderkey",))


def lines(spark: SparkSession, sf: str) -> Sequence:
    return Sequence(read(spark, sf, "lineitem"), LINE_ORDER)


E = "WITH e AS (SELECT event_id, user_id, event_type, CAST(round(value * 100) AS BIGINT) AS cents, row_number() OVER (ORDER BY event_id) - 1 AS pos FROM events)"
RUNS = E + """, h AS (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER (ORDER BY pos) AND pos > 0 THEN 0 ELSE 1 END AS head FROM e),
i AS (SELECT *, CAST(sum(head) OVER (ORDER BY pos) - 1 AS BIGINT) AS island FROM h)"""
SEG = """, s AS (SELECT CAST(k AS BIGINT) AS seg, CAST(k * 100 AS BIGINT) AS "begin", CAST(k * 100 + (k * 37) % 150 AS BIGINT) AS "end" FROM (SELECT unnest(range(0, (SELECT count(*) // 100 FROM events))) AS k))"""
TILES = """, t AS (SELECT *, pos // 256 AS tile, pos % 256 AS lane FROM e), w AS (SELECT *, pos // 64 AS wtile, pos % 64 AS wlane FROM e)"""


def segments(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of events: some overlap the next, some leave gaps, some are empty."""
    e = read(spark, sf, "events").select("event_id")
    k = position(Sequence(e, ("event_id",))).where("pos % 100 = 99").select(F.floor(F.col("pos") / 100).alias("k"))
    return k.select(F.col("k").alias("seg"), (F.col("k") * 100).alias("begin"), (F.col("k") * 100 + F.col("k") * 37 % 150).alias("end"))


# --- sources -----------------------------------------------------------------------------------


@query("source_constant_counting", "SELECT o_orderkey, CAST(7 AS INTEGER) AS seven, CAST(row_number() OVER (ORDER BY o_orderkey) - 1 + 10 AS BIGINT) AS counter FROM orders")
def source_constant_counting(spark, sf):
    o = orders(spark, sf)
    n = o.df.count()
    both = iterators.constant(spark, 7, n, "seven").join(iterators.counting(spark, 10, n, "counter"), "pos")
    return position(o).join(both, "pos").select("o_orderkey", "seven", "counter")


@query("source_zip", "SELECT c_custkey, o_orderkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS r FROM customer) JOIN (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS r FROM orders) USING (r)")
def source_zip(spark, sf):
    c = Sequence(read(spark, sf, "customer").select("c_custkey"), ("c_custkey",))
    o = Sequence(read(spark, sf, "orders").select("o_orderkey"), ("o_orderkey",))
    return iterators.zipped(c, o).select("c_custkey", "o_orderkey")


@query("source_arg_index", E + " SELECT event_id, pos AS idx, cents FROM e")
def source_arg_index(spark, sf):
    return iterators.arg_index(events(spark, sf), "cents").select("event_id", F.col("indexed.index").alias("idx"), F.col("indexed.value").alias("cents"))


@query("source_reverse", E + " SELECT event_id, row_number() OVER (ORDER BY event_id DESC) - 1 AS pos FROM e")
def source_reverse(spark, sf):
    return position(iterators.reversed_(events(spark, sf))).select("event_id", "pos")


@query("source_predicate_read", E + " SELECT event_id, CASE WHEN event_type = 'purchase' THEN cents ELSE 0 END AS y FROM e")
def source_predicate_read(spark, sf):
    return iterators.masked_read(events(spark, sf).df, "cents", F.col("event_type") == "purchase", 0).select("event_id", "y")


@query("source_mask_write", E + " SELECT event_id, CASE WHEN user_id % 2 = 0 THEN -cents ELSE cents END AS cents FROM e")
def source_mask_write(spark, sf):
    df = events(spark, sf).df
    return iterators.masked_write(df, "cents", -F.col("cents"), F.col("user_id") % 2 == 0).select("event_id", "cents")


# --- map, filter, partition --------------------------------------------------------------------


@query("transform_unary", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT) * 2 AS y FROM lineitem")
def transform_unary(spark, sf):
    df = read(spark, sf, "lineitem").withColumn("c", cents("l_extendedprice"))
    return basic.transform(df, lambda x: x * 2, "c").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "y")


@query("transform_binary", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(l_quantity AS BIGINT) AS y FROM lineitem")
def transform_binary(spark, sf):
    df = read(spark, sf, "lineitem").withColumn("c", cents("l_extendedprice")).withColumn("q", F.col("l_quantity").cast("long"))
    return basic.transform(df, ops.BINARY["multiplies"], "c", "q").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "y")


@query("select_flags", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R'")
def select_flags(spark, sf):
    df = read(spark, sf, "lineitem").withColumn("flag", (F.col("l_returnflag") == "R").cast("int"))
    return basic.select(df, "flag").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


@query("select_predicate", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem WHERE l_quantity > 30 AND l_discount < 0.05")
def select_predicate(spark, sf):
    df = read(spark, sf, "lineitem")
    return basic.select(df, (F.col("l_quantity") > 30) & (F.col("l_discount") < 0.05)).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


PARTITION = E + ", p AS (SELECT *, {} AS keep FROM e) SELECT event_id, row_number() OVER (ORDER BY NOT keep, CASE WHEN keep THEN pos ELSE -pos END) - 1 AS out_pos FROM p"


@query("partition_flags", PARTITION.format("user_id % 3 = 0"))
def partition_flags(spark, sf):
    s = events(spark, sf)
    s = s.with_df(s.df.withColumn("flag", (F.col("user_id") % 3 == 0).cast("int")))
    return basic.partition(s, "flag").select("event_id", "out_pos")


@query("partition_predicate", PARTITION.format("cents > 5000"))
def partition_predicate(spark, sf):
    return basic.partition(events(spark, sf), F.col("cents") > 5000).select("event_id", "out_pos")


@query("partition_two_way", E + " SELECT event_id, CAST(CASE WHEN event_type = 'click' THEN 0 ELSE 1 END AS INTEGER) AS part FROM e")
def partition_two_way(spark, sf):
    return basic.partition_two_way(events(spark, sf).df, F.col("event_type") == "click").select("event_id", "part")


@query("partition_two_way_flags_counts", E + " SELECT CAST(CASE WHEN user_id % 2 = 0 THEN 0 ELSE 1 END AS INTEGER) AS part, count(*) AS n FROM e GROUP BY 1")
def partition_two_way_flags_counts(spark, sf):
    df = events(spark, sf).df.withColumn("flag", (F.col("user_id") % 2 == 0).cast("int"))
    return basic.part_counts(basic.partition_two_way(df, "flag"))


@query("partition_three_way", E + " SELECT event_id, CAST(CASE WHEN cents % 2 = 0 THEN 0 WHEN cents % 3 = 0 THEN 1 ELSE 2 END AS INTEGER) AS part FROM e")
def partition_three_way(spark, sf):
    return basic.partition_three_way(events(spark, sf).df, F.col("cents") % 2 == 0, F.col("cents") % 3 == 0).select("event_id", "part")


@query("unique", RUNS + " SELECT event_id, event_type FROM h WHERE head = 1")
def unique(spark, sf):
    return basic.unique(events(spark, sf), "event_type").select("event_id", "event_type")


@query("unique_custom_equality", E + " SELECT event_id, cents FROM (SELECT *, lag(cents) OVER (ORDER BY pos) AS p FROM e) WHERE p IS NULL OR abs(cents - p) >= 2000")
def unique_custom_equality(spark, sf):
    near = lambda a, b: F.abs(b["cents"] - a["cents"]) < 2000
    return basic.unique(events(spark, sf), "cents", equal=near).select("event_id", "cents")


@query("unique_by_key", RUNS + " SELECT event_type, cents, pos FROM h WHERE head = 1")
def unique_by_key(spark, sf):
    s = events(spark, sf)
    return basic.unique(s.with_df(position(s)), "event_type").select("event_type", "cents", "pos")


# --- folds ---------------------------------------------------------------------------------------


@query("reduce_min_init", E + " SELECT least(100, min(cents)) AS y FROM e")
def reduce_min_init(spark, sf):
    return reduce.reduce(events(spark, sf).df, "cents", "min", init=100).select(F.col("y").cast("long").alias("y"))


@query("reduce_sum", "SELECT CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS y FROM lineitem")
def reduce_sum(spark, sf):
    return reduce.reduce(read(spark, sf, "lineitem"), cents("l_extendedprice"))


@query("reduce_empty_init", "SELECT CAST(9 AS BIGINT) AS y FROM region LIMIT 1")
def reduce_empty_init(spark, sf):
    return reduce.reduce(events(spark, sf).df.where("event_type = 'no such type'"), "cents", "sum", init=9).select(F.col("y").cast("long").alias("y"))


@query("segmented_reduce", E + SEG + ' SELECT s.seg, CAST(least(900000, min(cents)) AS BIGINT) AS y FROM s LEFT JOIN e ON pos >= "begin" AND pos < "end" GROUP BY s.seg')
def segmented_reduce(spark, sf):
    return reduce.segmented_reduce(events(spark, sf), segments(spark, sf), "seg", "cents", "min", init=900000).select("seg", F.col("y").cast("long").alias("y"))


@query("reduce_by_key_sum", RUNS + " SELECT island, min(event_type) AS event_type, CAST(sum(cents) AS BIGINT) AS total, count(*) AS run_length FROM i GROUP BY island")
def reduce_by_key_sum(spark, sf):
    return reduce.reduce_by_key(events(spark, sf), ["event_type"], {"total": F.sum("cents")})


@query("reduce_by_key_custom_equality", E + ", h AS (SELECT *, CASE WHEN pos > 0 AND cents // 5000 = lag(cents) OVER (ORDER BY pos) // 5000 THEN 0 ELSE 1 END AS head FROM e), i AS (SELECT *, sum(head) OVER (ORDER BY pos) AS island FROM h) SELECT CAST(island - 1 AS BIGINT) AS island, min_by(cents, pos) AS cents, max(cents) AS top, count(*) AS run_length FROM i GROUP BY island")
def reduce_by_key_custom_equality(spark, sf):
    coarse = lambda a, b: F.floor(a["cents"] / 5000) == F.floor(b["cents"] / 5000)
    return reduce.reduce_by_key(events(spark, sf), ["cents"], {"top": F.max("cents")}, coarse)


@query("deterministic_reduce_by_key", RUNS + " SELECT island, CAST(CAST(sum(cents) AS BIGINT) AS DOUBLE) / 100 AS total FROM i GROUP BY island")
def deterministic_reduce_by_key(spark, sf):
    total = F.sum(scans.deterministic(F.col("cents") / 100, 2)).cast("double")
    return reduce.reduce_by_key(events(spark, sf), ["event_type"], {"total": total}).select("island", "total")


@query("run_length_encode", RUNS + " SELECT island, min(event_type) AS event_type, count(*) AS run_length FROM i GROUP BY island")
def run_length_encode(spark, sf):
    return reduce.run_length_encode(events(spark, sf), "event_type")


@query("run_length_encode_per_user", "WITH e AS (SELECT event_id, user_id, event_type, row_number() OVER (ORDER BY user_id, event_id) AS r FROM events), h AS (SELECT *, CASE WHEN r > 1 AND user_id = lag(user_id) OVER (ORDER BY r) AND event_type = lag(event_type) OVER (ORDER BY r) THEN 0 ELSE 1 END AS head FROM e), i AS (SELECT *, CAST(sum(head) OVER (ORDER BY r) - 1 AS BIGINT) AS island FROM h) SELECT island, min(user_id) AS user_id, min(event_type) AS event_type, count(*) AS run_length FROM i GROUP BY island")
def run_length_encode_per_user(spark, sf):
    s = Sequence(events(spark, sf).df, ("user_id", "event_id"))
    return reduce.run_length_encode(s, "user_id", "event_type")


@query("non_trivial_runs", RUNS + " SELECT min(pos) AS start, count(*) AS run_length FROM i GROUP BY island HAVING count(*) > 1")
def non_trivial_runs(spark, sf):
    return reduce.non_trivial_runs(events(spark, sf), "event_type")


@query("run_length_decode", "SELECT p_partkey, CAST(unnest(range(0, p_size % 7)) AS BIGINT) AS run_offset FROM part")
def run_length_decode(spark, sf):
    df = read(spark, sf, "part").select("p_partkey", (F.col("p_size") % 7).alias("n"))
    return reduce.run_length_decode(df, "n").select("p_partkey", "run_offset")


@query("arg_min", E + " SELECT event_id AS key, cents // 1000 AS value FROM e ORDER BY 2, 1 LIMIT 1")
def arg_min(spark, sf):
    return reduce.arg_min(events(spark, sf).df.withColumn("v", F.floor(F.col("cents") / 1000)), "event_id", "v")


@query("arg_max", E + " SELECT event_id AS key, cents // 1000 AS value FROM e ORDER BY 2 DESC, 1 LIMIT 1")
def arg_max(spark, sf):
    return reduce.arg_max(events(spark, sf).df.withColumn("v", F.floor(F.col("cents") / 1000)), "event_id", "v")


# --- histograms ----------------------------------------------------------------------------------

EVEN = "SELECT CAST(b AS INTEGER) AS bin, count(x) AS n FROM (SELECT unnest(range(0, {bins})) AS b) LEFT JOIN (SELECT {x} AS x FROM {t}) ON x >= {lo} AND x < {hi} AND floor((x - {lo}) * {bins} / ({hi} - {lo})) = b GROUP BY b"


@query("histogram_even", EVEN.format(bins=10, x="l_quantity", t="lineitem", lo=0, hi=40))
def histogram_even(spark, sf):
    return histogram.histogram_even(read(spark, sf, "lineitem"), "l_quantity", 11, 0, 40)


@query("histogram_even_integers", EVEN.format(bins=5, x="p_size", t="part", lo=0, hi=60))
def histogram_even_integers(spark, sf):
    return histogram.histogram_even(read(spark, sf, "part"), "p_size", 6, 0, 60)


@query("histogram_even_region", EVEN.format(bins=8, x="cents", t="(SELECT CAST(round(value * 100) AS BIGINT) AS cents, row_number() OVER (ORDER BY event_id) - 1 AS pos FROM events) WHERE pos % 100 < 60 AND pos // 100 < 50", lo=0, hi=16000))
def histogram_even_region(spark, sf):
    df = position(events(spark, sf)).select("cents", (F.col("pos") % 100).alias("col"), F.floor(F.col("pos") / 100).alias("row"))
    return histogram.histogram_even(histogram.region(df, 60, 50), "cents", 9, 0, 16000)


@query("multi_histogram_even", "WITH x AS (SELECT 0 AS channel, l_quantity AS v, 0 AS lo, 50 AS hi, 5 AS bins FROM lineitem UNION ALL SELECT 1, l_discount * 100, 0, 20, 4 FROM lineitem), c AS (SELECT channel, CAST(floor((v - lo) * bins / (hi - lo)) AS INTEGER) AS bin FROM x WHERE v >= lo AND v < hi), s AS (SELECT 0 AS channel, unnest(range(0, 5)) AS bin UNION ALL SELECT 1, unnest(range(0, 4))) SELECT CAST(s.channel AS INTEGER) AS channel, CAST(s.bin AS INTEGER) AS bin, count(c.bin) AS n FROM s LEFT JOIN c ON s.channel = c.channel AND s.bin = c.bin GROUP BY 1, 2")
def multi_histogram_even(spark, sf):
    df = read(spark, sf, "lineitem").select("l_quantity", (F.col("l_discount") * 100).alias("d"))
    return histogram.multi_histogram_even(df, ["l_quantity", "d"], [6, 5], [0, 0], [50, 20])


LEVELS = [0, 100, 1000, 2500, 9000, 50000]


@query("histogram_range", "WITH l AS (SELECT * FROM (VALUES (0, 0, 100), (1, 100, 1000), (2, 1000, 2500), (3, 2500, 9000), (4, 9000, 50000)) v(bin, lo, hi)) SELECT CAST(bin AS INTEGER) AS bin, count(x) AS n FROM l LEFT JOIN (SELECT CAST(round(value * 100) AS BIGINT) AS x FROM events) ON x >= lo AND x < hi GROUP BY bin")
def histogram_range(spark, sf):
    return histogram.histogram_range(events(spark, sf).df, "cents", LEVELS)


@query("multi_histogram_range", "WITH l AS (SELECT * FROM (VALUES (0, 0, 1, 10), (0, 1, 10, 30), (1, 0, 0, 4), (1, 1, 4, 5), (1, 2, 5, 9)) v(channel, bin, lo, hi)), x AS (SELECT 0 AS channel, l_quantity AS v FROM lineitem UNION ALL SELECT 1, l_linenumber FROM lineitem) SELECT CAST(l.channel AS INTEGER) AS channel, CAST(bin AS INTEGER) AS bin, count(v) AS n FROM l LEFT JOIN x ON l.channel = x.channel AND v >= lo AND v < hi GROUP BY 1, 2")
def multi_histogram_range(spark, sf):
    return histogram.multi_histogram_range(read(spark, sf, "lineitem"), ["l_quantity", "l_linenumber"], [[1, 10, 30], [0, 4, 5, 9]])


@query("histogram_composite", "WITH q AS (SELECT o_totalprice AS x FROM orders UNION ALL SELECT l_extendedprice FROM lineitem) " + EVEN.format(bins=6, x="x", t="q", lo=0, hi=90000))
def histogram_composite(spark, sf):
    a = histogram.histogram_even(read(spark, sf, "orders"), "o_totalprice", 7, 0, 90000)
    return histogram.composite(a, histogram.histogram_even(read(spark, sf, "lineitem"), "l_extendedprice", 7, 0, 90000))


# --- scans ---------------------------------------------------------------------------------------


@query("inclusive_scan", E + " SELECT event_id, CAST(sum(cents) OVER (ORDER BY pos) AS BIGINT) AS y FROM e")
def inclusive_scan(spark, sf):
    return scans.inclusive_scan(events(spark, sf), "cents").select("event_id", "y")


@query("inclusive_scan_lineitem", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) OVER (ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate, l_extendedprice ROWS UNBOUNDED PRECEDING) AS BIGINT) AS y FROM lineitem")
def inclusive_scan_lineitem(spark, sf):
    return scans.inclusive_scan(lines(spark, sf), cents("l_extendedprice")).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "y")


@query("exclusive_scan_min", E + " SELECT event_id, CAST(coalesce(least(9000, min(cents) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 9000) AS BIGINT) AS y FROM e")
def exclusive_scan_min(spark, sf):
    return scans.exclusive_scan(events(spark, sf), "cents", 9000, "min").select("event_id", F.col("y").cast("long").alias("y"))


@query("exclusive_scan_future_init", E + ", f AS (SELECT max(cents) AS init FROM e) SELECT event_id, CAST(init + coalesce(sum(cents) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS y FROM e, f")
def exclusive_scan_future_init(spark, sf):
    s = events(spark, sf)
    init = reduce.reduce(s.df, "cents", "max", out="init")
    with_init = s.with_df(s.df.join(F.broadcast(init)))
    return scans.exclusive_scan(with_init, "cents", F.col("init")).select("event_id", "y")


@query("deterministic_inclusive_scan", E + " SELECT event_id, CAST(CAST(sum(cents) OVER (ORDER BY pos) AS BIGINT) AS DOUBLE) / 100 AS y FROM e")
def deterministic_inclusive_scan(spark, sf):
    return scans.inclusive_scan(events(spark, sf), scans.deterministic(F.col("cents") / 100, 2)).select("event_id", F.col("y").cast("double").alias("y"))


@query("deterministic_exclusive_scan", E + " SELECT event_id, CAST(CAST(coalesce(sum(cents) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS DOUBLE) / 100 AS y FROM e")
def deterministic_exclusive_scan(spark, sf):
    zero = F.lit(0).cast("decimal(38,2)")
    return scans.exclusive_scan(events(spark, sf), scans.deterministic(F.col("cents") / 100, 2), zero).select("event_id", F.col("y").cast("double").alias("y"))


@query("inclusive_scan_by_key", RUNS + " SELECT event_id, CAST(sum(cents) OVER (PARTITION BY island ORDER BY pos) AS BIGINT) AS y FROM i")
def inclusive_scan_by_key(spark, sf):
    return scans.inclusive_scan_by_key(events(spark, sf), ["event_type"], "cents").select("event_id", "y")


@query("exclusive_scan_by_key", RUNS + " SELECT event_id, CAST(9 + coalesce(sum(cents) OVER (PARTITION BY island ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS y FROM i")
def exclusive_scan_by_key(spark, sf):
    return scans.exclusive_scan_by_key(events(spark, sf), ["event_type"], "cents", 9).select("event_id", "y")


@query("deterministic_scan_by_key", RUNS + " SELECT event_id, CAST(CAST(sum(cents) OVER (PARTITION BY island ORDER BY pos) AS BIGINT) AS DOUBLE) / 100 AS y FROM i")
def deterministic_scan_by_key(spark, sf):
    return scans.inclusive_scan_by_key(events(spark, sf), ["event_type"], scans.deterministic(F.col("cents") / 100, 2)).select("event_id", F.col("y").cast("double").alias("y"))


@query("segmented_inclusive_scan", E + SEG + ' SELECT s.seg, e.pos, CAST(sum(cents) OVER (PARTITION BY s.seg ORDER BY e.pos) AS BIGINT) AS y FROM s JOIN e ON pos >= "begin" AND pos < "end"')
def segmented_inclusive_scan(spark, sf):
    return scans.segmented_scan(events(spark, sf), segments(spark, sf), "seg", "cents").select("seg", "pos", "y")


@query("segmented_exclusive_scan", E + SEG + ' SELECT s.seg, e.pos, CAST(coalesce(greatest(5, max(cents) OVER (PARTITION BY s.seg ORDER BY e.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 5) AS BIGINT) AS y FROM s JOIN e ON pos >= "begin" AND pos < "end"')
def segmented_exclusive_scan(spark, sf):
    return scans.segmented_scan(events(spark, sf), segments(spark, sf), "seg", "cents", "max", exclusive=True, init=5).select("seg", "pos", F.col("y").cast("long").alias("y"))


FLAGS = E + ", f AS (SELECT *, sum(CASE WHEN pos > 0 AND event_type = 'signup' THEN 1 ELSE 0 END) OVER (ORDER BY pos) AS g FROM e)"


@query("segmented_inclusive_scan_flags", FLAGS + " SELECT event_id, CAST(sum(cents) OVER (PARTITION BY g ORDER BY pos) AS BIGINT) AS y FROM f")
def segmented_inclusive_scan_flags(spark, sf):
    s = events(spark, sf)
    s = s.with_df(s.df.withColumn("flag", F.col("event_type") == "signup"))
    return scans.segmented_scan_flags(s, "flag", "cents").select("event_id", "y")


@query("segmented_exclusive_scan_flags", FLAGS + " SELECT event_id, CAST(coalesce(sum(cents) OVER (PARTITION BY g ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS y FROM f")
def segmented_exclusive_scan_flags(spark, sf):
    s = events(spark, sf)
    s = s.with_df(s.df.withColumn("flag", F.col("event_type") == "signup"))
    return scans.segmented_scan_flags(s, "flag", "cents", exclusive=True, init=0).select("event_id", "y")


# --- differences ---------------------------------------------------------------------------------


@query("adjacent_difference", E + " SELECT event_id, cents - coalesce(lag(cents) OVER (ORDER BY pos), 0) AS y FROM e")
def adjacent_difference(spark, sf):
    return difference.adjacent_difference(events(spark, sf), "cents").select("event_id", "y")


@query("adjacent_difference_right", E + " SELECT event_id, cents - coalesce(lead(cents) OVER (ORDER BY pos), 0) AS y FROM e")
def adjacent_difference_right(spark, sf):
    return difference.adjacent_difference_right(events(spark, sf), "cents").select("event_id", "y")


@query("adjacent_difference_product", E + " SELECT event_id, cents * coalesce(lag(cents) OVER (ORDER BY pos), 1) AS y FROM e")
def adjacent_difference_product(spark, sf):
    return difference.adjacent_difference(events(spark, sf), "cents", ops.BINARY["multiplies"]).select("event_id", "y")


@query("discontinuity", E + " SELECT event_id, pos = 0 OR event_type <> lag(event_type) OVER (ORDER BY pos) AS head, coalesce(event_type <> lead(event_type) OVER (ORDER BY pos), true) AS tail FROM e")
def discontinuity(spark, sf):
    return difference.flag_heads_and_tails(events(spark, sf), "event_type").select("event_id", "head", "tail")


@query("discontinuity_heads", E + " SELECT event_id, pos = 0 OR cents < lag(cents) OVER (ORDER BY pos) AS head FROM e")
def discontinuity_heads(spark, sf):
    return difference.flag_heads(events(spark, sf), "cents", lambda a, b: b < a).select("event_id", "head")


# --- sorts and selection -------------------------------------------------------------------------


@query("merge_sort_keys", "SELECT event_id, row_number() OVER (ORDER BY event_type, event_id) - 1 AS pos FROM events")
def merge_sort_keys(spark, sf):
    return sorting.merge_sort(events(spark, sf), "event_type").select("event_id", "pos")


@query("merge_sort_pairs", E + " SELECT cents, event_id, row_number() OVER (ORDER BY cents DESC, event_id) - 1 AS pos FROM e")
def merge_sort_pairs(spark, sf):
    return sorting.merge_sort(events(spark, sf), "-cents").select("cents", "event_id", "pos")


@query("radix_sort_bits", "SELECT p_partkey, row_number() OVER (ORDER BY (p_partkey >> 2) & 31, p_partkey) - 1 AS pos FROM part")
def radix_sort_bits(spark, sf):
    s = Sequence(read(spark, sf, "part").select("p_partkey"), ("p_partkey",))
    return sorting.radix_sort(s, "p_partkey", 2, 7).select("p_partkey", "pos")


@query("radix_sort_desc", "SELECT o_orderkey, row_number() OVER (ORDER BY o_custkey DESC, o_orderkey) - 1 AS pos FROM orders")
def radix_sort_desc(spark, sf):
    return sorting.radix_sort(orders(spark, sf), "o_custkey", descending=True).select("o_orderkey", "pos")


@query("radix_sort_decomposer", "SELECT p_partkey, row_number() OVER (ORDER BY p_size, p_retailprice, p_partkey) - 1 AS pos FROM part")
def radix_sort_decomposer(spark, sf):
    df = read(spark, sf, "part").select("p_partkey", F.struct("p_size", "p_retailprice").alias("key"))
    return sorting.radix_sort_decomposed(Sequence(df, ("p_partkey",)), [F.col("key.p_size"), F.col("key.p_retailprice")]).select("p_partkey", "pos")


@query("segmented_radix_sort", E + SEG + ' SELECT s.seg, e.event_id, row_number() OVER (PARTITION BY s.seg ORDER BY cents, pos) - 1 AS rank FROM s JOIN e ON pos >= "begin" AND pos < "end"')
def segmented_radix_sort(spark, sf):
    return sorting.segmented_sort(events(spark, sf), segments(spark, sf), "seg", "cents").select("seg", "event_id", "rank")


@query("segmented_radix_sort_desc", E + SEG + ' SELECT s.seg, e.event_id, row_number() OVER (PARTITION BY s.seg ORDER BY user_id DESC, pos) - 1 AS rank FROM s JOIN e ON pos >= "begin" AND pos < "end"')
def segmented_radix_sort_desc(spark, sf):
    return sorting.segmented_sort(events(spark, sf), segments(spark, sf), "seg", "user_id", descending=True).select("seg", "event_id", "rank")


@query("nth_element", "WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY CAST(round(o_totalprice * 100) AS BIGINT), o_orderkey) - 1 AS r FROM orders) SELECT o_orderkey, CAST(CASE WHEN r < 300 THEN -1 WHEN r = 300 THEN 0 ELSE 1 END AS INTEGER) AS side FROM r")
def nth_element(spark, sf):
    return sorting.nth_element(orders(spark, sf), "cents", 300).select("o_orderkey", "side")


@query("partial_sort", "WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY CAST(round(o_totalprice * 100) AS BIGINT), o_orderkey) - 1 AS r FROM orders) SELECT o_orderkey, CASE WHEN r < 100 THEN r END AS pos FROM r")
def partial_sort(spark, sf):
    return sorting.partial_sort(orders(spark, sf), "cents", 100).select("o_orderkey", "pos")


@query("partial_sort_copy", "SELECT o_orderkey, row_number() OVER (ORDER BY CAST(round(o_totalprice * 100) AS BIGINT), o_orderkey) - 1 AS pos FROM orders QUALIFY pos <= 50")
def partial_sort_copy(spark, sf):
    return sorting.partial_sort_copy(orders(spark, sf), "cents", 50).select("o_orderkey", "pos")


# --- search and merge ----------------------------------------------------------------------------

BOUND = "WITH h AS (SELECT CAST(round(l_extendedprice * 100) AS BIGINT) AS x FROM lineitem), r AS (SELECT x, count(*) AS n FROM h GROUP BY x), p AS (SELECT p_partkey, CAST(round(p_retailprice * 100) AS BIGINT) AS q FROM part) SELECT p_partkey, CAST(coalesce((SELECT sum(n) FROM r WHERE x {op} q), 0) AS BIGINT) AS bound FROM p"


def _needles(spark, sf):
    hay = read(spark, sf, "lineitem").select(cents("l_extendedprice").alias("x"))
    return hay, read(spark, sf, "part").select("p_partkey", cents("p_retailprice").alias("q"))


@query("lower_bound", BOUND.format(op="<"))
def lower_bound(spark, sf):
    hay, needles = _needles(spark, sf)
    return search.lower_bound(hay, "x", needles, "q", "p_partkey").select("p_partkey", "bound")


@query("upper_bound", BOUND.format(op="<="))
def upper_bound(spark, sf):
    hay, needles = _needles(spark, sf)
    return search.upper_bound(hay, "x", needles, "q", "p_partkey").select("p_partkey", "bound")


@query("binary_search", "SELECT c_custkey, CAST(CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 1 ELSE 0 END AS INTEGER) AS found FROM customer")
def binary_search(spark, sf):
    return search.binary_search(read(spark, sf, "orders"), "o_custkey", read(spark, sf, "customer").select("c_custkey"), "c_custkey")


MERGE = "WITH b AS (SELECT CAST(round(c_acctbal * 100) AS BIGINT) AS bal, 0 AS src, c_custkey AS id FROM customer UNION ALL SELECT CAST(round(s_acctbal * 100) AS BIGINT), 1, s_suppkey FROM supplier) SELECT bal, {cols}CAST(row_number() OVER (ORDER BY bal, src, id) - 1 AS BIGINT) AS pos FROM b"


def _merged(spark, sf):
    a = read(spark, sf, "customer").select(cents("c_acctbal").alias("bal"), F.col("c_custkey").alias("id"))
    b = read(spark, sf, "supplier").select(cents("s_acctbal").alias("bal"), F.col("s_suppkey").alias("id"))
    return search.merge(Sequence(a, ("bal", "id")), Sequence(b, ("bal", "id")), "bal")


@query("merge_keys", MERGE.format(cols=""))
def merge_keys(spark, sf):
    return _merged(spark, sf).select("bal", "pos")


@query("merge_pairs", MERGE.format(cols="CAST(src AS INTEGER) AS src, id, "))
def merge_pairs(spark, sf):
    return _merged(spark, sf).select("bal", "src", "id", "pos")


# --- batched copies ------------------------------------------------------------------------------


@query("batch_copy", "WITH b AS (SELECT CAST(p_partkey // 100 AS BIGINT) AS id, p_partkey % 100 AS off, CAST(p_size AS BIGINT) AS x FROM part) SELECT d.id AS dst_id, d.off, coalesce(s.x, -d.x) AS x FROM b d LEFT JOIN b s ON s.id = d.id + 1 AND d.off >= 10 AND d.off < 30 AND s.off = d.off + 5")
def batch_copy(spark, sf):
    p = read(spark, sf, "part").select(F.floor(F.col("p_partkey") / 100).alias("id"), (F.col("p_partkey") % 100).alias("off"), F.col("p_size").cast("long").alias("x"))
    src = p.withColumnRenamed("id", "src_id")
    dst = p.select(F.col("id").alias("dst_id"), "off", (-F.col("x")).alias("x"))
    moves = p.select("id").distinct().select((F.col("id") + 1).alias("src_id"), F.lit(15).cast("long").alias("src_off"), F.col("id").alias("dst_id"), F.lit(10).cast("long").alias("dst_off"), F.lit(20).cast("long").alias("len"))
    return copy.batch_copy(src, dst, moves)


@query("batch_memcpy", "SELECT n_nationkey AS dst_id, hex(encode(substr('..........', 1, 2) || substr(n_name || '          ', 1, 4) || substr('..........', 7))) AS data FROM nation")
def batch_memcpy(spark, sf):
    n = read(spark, sf, "nation")
    src = n.select(F.col("n_nationkey").alias("src_id"), F.rpad("n_name", 20, " ").cast("binary").alias("data"))
    dst = n.select(F.col("n_nationkey").alias("dst_id"), F.lit("..........").cast("binary").alias("data"))
    moves = n.select(F.col("n_nationkey").alias("src_id"), F.lit(0).alias("src_off"), F.col("n_nationkey").alias("dst_id"), F.lit(2).alias("dst_off"), F.lit(4).alias("len"))
    return copy.batch_memcpy(src, dst, moves).select("dst_id", F.hex("data").alias("data"))


# --- tiles ---------------------------------------------------------------------------------------


def _tiles(spark, sf, size=256):
    return tiles(events(spark, sf), size)


@query("block_reduce", E + TILES + " SELECT tile, CAST(sum(cents) AS BIGINT) AS y FROM t GROUP BY tile")
def block_reduce(spark, sf):
    return tile.reduce(_tiles(spark, sf), "cents")


@query("block_reduce_valid", E + TILES + " SELECT tile, max(cents) AS y FROM t WHERE lane < 10 GROUP BY tile")
def block_reduce_valid(spark, sf):
    return tile.reduce(_tiles(spark, sf), "cents", "max", valid=10)


@query("block_scan", E + TILES + " SELECT event_id, CAST(sum(cents) OVER (PARTITION BY tile ORDER BY lane) AS BIGINT) AS y, CAST(sum(cents) OVER (PARTITION BY tile) AS BIGINT) AS total FROM t")
def block_scan(spark, sf):
    return tile.scan(_tiles(spark, sf), "cents", total="total").select("event_id", "y", "total")


@query("block_exclusive_scan", E + TILES + " SELECT event_id, CAST(tile + coalesce(sum(cents) OVER (PARTITION BY tile ORDER BY lane ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS y FROM t")
def block_exclusive_scan(spark, sf):
    return tile.scan(_tiles(spark, sf), "cents", exclusive=True, init=F.col("tile")).select("event_id", "y")


@query("block_exchange", E + TILES + " SELECT event_id, tile, CAST((lane % 4) * 64 + lane // 4 AS INTEGER) AS striped, CAST((lane % 64) * 4 + lane // 64 AS INTEGER) AS blocked, CAST(lane // 64 * 64 + (lane % 64 % 4) * 16 + lane % 64 // 4 AS INTEGER) AS warp_striped FROM t")
def block_exchange(spark, sf):
    t = _tiles(spark, sf)
    a = tile.blocked_to_striped(t, 64, 4).select("event_id", "tile", F.col("lane").alias("striped"))
    b = tile.striped_to_blocked(t, 64, 4).select("event_id", F.col("lane").alias("blocked"))
    c = tile.blocked_to_warp_striped(t, 16, 4).select("event_id", F.col("lane").alias("warp_striped"))
    return a.join(b, "event_id").join(c, "event_id")


@query("block_scatter", E + TILES + " SELECT event_id, tile, CAST(255 - lane AS INTEGER) AS lane FROM t WHERE cents % 5 <> 0")
def block_scatter(spark, sf):
    t = _tiles(spark, sf).withColumn("rank", F.when(F.col("cents") % 5 == 0, -1).otherwise(255 - F.col("lane")))
    return tile.scatter(t, "rank").select("event_id", "tile", "lane")


@query("block_gather", E + TILES + " SELECT a.event_id, coalesce(b.cents, a.cents) AS y FROM t a LEFT JOIN t b ON a.tile = b.tile AND b.lane = (a.lane * 7) % 256")
def block_gather(spark, sf):
    return tile.gather(_tiles(spark, sf), F.col("lane") * 7 % 256, "cents").select("event_id", "y")


@query("block_shuffle", E + TILES + " SELECT a.event_id, coalesce(b.cents, a.cents) AS moved, coalesce(c.cents, a.cents) AS rotated FROM t a LEFT JOIN t b ON a.tile = b.tile AND b.lane = a.lane - 3 LEFT JOIN t c ON a.tile = c.tile AND c.lane = (a.lane + 5) % 256")
def block_shuffle(spark, sf):
    t = _tiles(spark, sf)
    return tile.shuffle_rotate(tile.shuffle_offset(t, "cents", 3, "moved"), "cents", 5, 256, "rotated").select("event_id", "moved", "rotated")


@query("block_shuffle_up_down", E + TILES + " SELECT event_id, coalesce(lag(cents) OVER w, cents) AS up, coalesce(lead(cents) OVER w, cents) AS down FROM t WINDOW w AS (PARTITION BY tile ORDER BY lane)")
def block_shuffle_up_down(spark, sf):
    return tile.shuffle_down(tile.shuffle_up(_tiles(spark, sf), "cents", "up"), "cents", "down").select("event_id", "up", "down")


@query("block_load_fill", E + TILES + " SELECT a.tile, CAST(b.lane AS INTEGER) AS lane, coalesce(t.cents, -1) AS cents FROM (SELECT DISTINCT tile FROM t) a, (SELECT unnest(range(0, 256)) AS lane) b LEFT JOIN t ON t.tile = a.tile AND t.lane = b.lane")
def block_load_fill(spark, sf):
    return tile.load(_tiles(spark, sf), "cents", 256, -1)


@query("block_subtract", E + TILES + " SELECT event_id, cents - coalesce(lag(cents) OVER w, 0) AS l, cents - coalesce(lead(cents) OVER w, 0) AS r FROM t WINDOW w AS (PARTITION BY tile ORDER BY lane)")
def block_subtract(spark, sf):
    return tile.subtract_right(tile.subtract_left(_tiles(spark, sf), "cents", "l"), "cents", "r").select("event_id", "l", "r")


@query("block_sort", E + TILES + " SELECT event_id, CAST(row_number() OVER (PARTITION BY tile ORDER BY cents, lane) - 1 AS INTEGER) AS rank FROM t")
def block_sort(spark, sf):
    return tile.sort(_tiles(spark, sf), "cents").select("event_id", "rank")


@query("block_radix_rank", E + TILES + " SELECT event_id, CAST(row_number() OVER (PARTITION BY tile ORDER BY (cents >> 3) & 15, lane) - 1 AS INTEGER) AS rank FROM t")
def block_radix_rank(spark, sf):
    return sorting.radix_rank(_tiles(spark, sf), "cents", 3, 7).select("event_id", "rank")


WARP = ", f AS (SELECT *, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY wtile ORDER BY wlane {frame}) AS g FROM w) SELECT wtile AS tile, CAST(min(wlane) AS INTEGER) AS lane, CAST(sum(cents) AS BIGINT) AS y FROM f GROUP BY wtile, coalesce(g, 0)"


@query("warp_head_segmented_reduce", E + TILES + WARP.format(frame=""))
def warp_head_segmented_reduce(spark, sf):
    t = _tiles(spark, sf, 64).withColumn("flag", F.col("event_type") == "purchase")
    return tile.segmented_reduce(t, "flag", "cents")


@query("warp_tail_segmented_reduce", E + TILES + WARP.format(frame="ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"))
def warp_tail_segmented_reduce(spark, sf):
    t = _tiles(spark, sf, 64).withColumn("flag", F.col("event_type") == "purchase")
    return tile.segmented_reduce(t, "flag", "cents", tails=True)


@query("warp_ballot", E + TILES + " SELECT wtile AS tile, CAST(bit_or(CASE WHEN cents > 5000 THEN CASE WHEN wlane = 63 THEN -9223372036854775807 - 1 ELSE CAST(1 AS BIGINT) << wlane END ELSE 0 END) AS BIGINT) AS mask FROM w GROUP BY wtile")
def warp_ballot(spark, sf):
    return tile.ballot(_tiles(spark, sf, 64), F.col("cents") > 5000)


@query("warp_any_all", E + TILES + """ SELECT wtile AS tile, bool_or(cents < 100) AS "any", bool_and(cents < 40000) AS "all" FROM w GROUP BY wtile""")
def warp_any_all(spark, sf):
    t = _tiles(spark, sf, 64)
    return tile.any_all(t, F.col("cents") < 100).drop("all").join(tile.any_all(t, F.col("cents") < 40000).drop("any"), "tile")


@query("warp_match_any", E + ", w AS (SELECT *, pos // 32 AS tile, pos % 32 AS lane FROM e) SELECT event_id, CAST(bit_or(CAST(1 AS BIGINT) << lane) OVER p AS BIGINT) AS mask, lane = min(lane) OVER p AS elected FROM w WINDOW p AS (PARTITION BY tile, event_type)")
def warp_match_any(spark, sf):
    return tile.match_any(_tiles(spark, sf, 32), "event_type").select("event_id", "mask", "elected")


@query("warp_shuffle_xor", E + TILES + " SELECT a.event_id, coalesce(b.cents, a.cents) AS y FROM w a LEFT JOIN w b ON a.wtile = b.wtile AND b.wlane = xor(a.wlane, 5)")
def warp_shuffle_xor(spark, sf):
    return tile.warp_xor(_tiles(spark, sf, 64), "cents", 5).select("event_id", "y")


@query("warp_read_lane", E + TILES + " SELECT event_id, max(CASE WHEN wlane = 2 THEN cents END) OVER (PARTITION BY wtile) AS y FROM w")
def warp_read_lane(spark, sf):
    return tile.read_lane(_tiles(spark, sf, 64), "cents", 2).select("event_id", "y")


@query("masked_bit_count", E + ", w AS (SELECT *, pos // 32 AS tile, pos % 32 AS lane FROM e), m AS (SELECT *, bit_or(CAST(1 AS BIGINT) << lane) OVER (PARTITION BY tile, event_type) AS mask FROM w) SELECT event_id, CAST(bit_count(CAST(mask & ((CAST(1 AS BIGINT) << lane) - 1) AS BIGINT)) AS INTEGER) AS below FROM m")
def masked_bit_count(spark, sf):
    t = tile.match_any(_tiles(spark, sf, 32), "event_type")
    return t.select("event_id", tile.masked_bit_count(F.col("mask"), F.col("lane")).alias("below"))


# --- arrays and scalars --------------------------------------------------------------------------

ARR = "WITH a AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 100) AS BIGINT)) AS v FROM embeddings)"


def _vectors(spark, sf):
    return read(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 100)).alias("v"))


@query("thread_reduce", ARR + " SELECT vec_id, CAST(list_max(v) AS BIGINT) AS top, CAST(5 + list_sum(v) AS BIGINT) AS total FROM a")
def thread_reduce(spark, sf):
    v = F.col("v")
    return _vectors(spark, sf).select("vec_id", arrays.array_reduce(v, F.greatest).alias("top"), arrays.array_reduce(v, lambda a, b: a + b, F.lit(5).cast("long")).alias("total"))


@query("thread_scan", ARR + ", s AS (SELECT vec_id, list_transform(range(1, len(v) + 1), lambda i: CAST(list_sum(v[1:i]) AS BIGINT)) AS s FROM a) SELECT vec_id, array_to_string(s, ',') AS inclusive, array_to_string(list_concat([0], s[1:len(s) - 1]), ',') AS exclusive FROM s")
def thread_scan(spark, sf):
    plus, zero = (lambda a, b: a + b), F.lit(0).cast("long")
    both = [arrays.array_scan(F.col("v"), plus, zero, e) for e in (False, True)]
    return _vectors(spark, sf).select("vec_id", *[F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(n) for c, n in zip(both, ("inclusive", "exclusive"))])


@query("thread_search", ARR + " SELECT vec_id, CAST(len(list_filter(v, lambda x: x < 3)) AS INTEGER) AS lower, CAST(len(list_filter(v, lambda x: x <= 3)) AS INTEGER) AS upper FROM a")
def thread_search(spark, sf):
    v = F.array_sort("v")
    return _vectors(spark, sf).select("vec_id", arrays.array_lower_bound(v, F.lit(3)).alias("lower"), arrays.array_upper_bound(v, F.lit(3)).alias("upper"))


@query("radix_key_codec", "SELECT p_partkey, CAST(p_size AS BIGINT) + 2147483648 AS code, CAST(2147483647 - CAST(p_size AS BIGINT) AS BIGINT) AS code_desc, CAST(((CAST(p_size AS BIGINT) + 2147483648) >> 2) & 15 AS BIGINT) AS digit, CAST(p_size AS BIGINT) AS back FROM part")
def radix_key_codec(spark, sf):
    code, down = arrays.encode_key(F.col("p_size"), 32), arrays.encode_key(F.col("p_size"), 32, descending=True)
    return read(spark, sf, "part").select("p_partkey", code.alias("code"), down.alias("code_desc"), arrays.extract_digit(code, 2, 4).alias("digit"), arrays.decode_key(down, 32, descending=True).alias("back"))


@query("bits", "SELECT p_partkey, CAST((p_partkey >> 3) & 1 AS TINYINT) AS bit3, CAST(bit_count(p_partkey) AS INTEGER) AS ones FROM part")
def bits(spark, sf):
    return read(spark, sf, "part").select("p_partkey", arrays.get_bit(F.col("p_partkey"), 3).alias("bit3"), F.bit_count("p_partkey").alias("ones"))


@query("functional", "SELECT p_partkey, p_size < 25 AS less, p_size <= 25 AS less_equal, p_size > 25 AS greater, p_size >= 25 AS greater_equal, p_size = 25 AS equal_to, p_size <> 25 AS not_equal_to, p_size + 25 AS plus, p_size - 25 AS minus, p_size * 25 AS multiplies, greatest(p_size, 25) AS maximum, least(p_size, 25) AS minimum, p_size AS identity, CAST((p_size - 25 + 256) % 256 AS BIGINT) AS wrapped FROM part")
def functional(spark, sf):
    x = F.col("p_size")
    return read(spark, sf, "part").select("p_partkey", *[f(x, F.lit(25)).alias(n) for n, f in ops.BINARY.items()], ops.identity(x).alias("identity"), ops.wrapped(x - 25, 8).alias("wrapped"))


@query("sort_then_search", "WITH h AS (SELECT o_orderkey, row_number() OVER (ORDER BY CAST(round(o_totalprice * 100) AS BIGINT), o_orderkey) - 1 AS pos, CAST(round(o_totalprice * 100) AS BIGINT) AS x FROM orders), n AS (SELECT c_custkey, CAST(round(c_acctbal * 1000) AS BIGINT) AS q FROM customer) SELECT c_custkey, CAST((SELECT count(*) FROM h WHERE x < q) AS BIGINT) AS bound FROM n")
def sort_then_search(spark, sf):
    hay = sorting.merge_sort(orders(spark, sf), "cents").select("pos", "cents")
    needles = read(spark, sf, "customer").select("c_custkey", F.round(F.col("c_acctbal") * 1000).cast("long").alias("q"))
    return search.lower_bound(hay, "cents", needles, "q", "c_custkey").select("c_custkey", "bound")


# --- opaque functions and operations that do not commute -------------------------------------------


@query("transform_opaque", E + " SELECT event_id, cents * 3 + user_id % 7 AS y FROM e")
def transform_opaque(spark, sf):
    return ordered.map_vectors(events(spark, sf).df, lambda v: {"y": v["cents"] * 3 + v["user_id"] % 7}, "y long").select("event_id", "y")


@query("select_opaque", E + " SELECT event_id FROM e WHERE (cents + user_id) % 3 = 1")
def select_opaque(spark, sf):
    return ordered.filter_vectors(events(spark, sf).df, lambda v: (v["cents"] + v["user_id"]) % 3 == 1).select("event_id")


def then(f, g):
    """The map x -> a * x + b of f, then that of g."""
    return {"a": f["a"] * g["a"], "b": g["a"] * f["b"] + g["b"]}


def _maps(spark, sf):
    """Maps that keep what came before (a = 1), or forget it at each signup (a = 0), and add the cents."""
    s = events(spark, sf)
    return s.with_df(s.df.select("event_id", "event_type", (F.col("event_type") != "signup").cast("long").alias("a"), F.col("cents").alias("b")))


RESETS = E + ", r AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (ORDER BY pos) AS g FROM e), s AS (SELECT event_id, pos, CASE WHEN g = 0 THEN 1 ELSE 0 END AS a, CAST(sum(cents) OVER (PARTITION BY g ORDER BY pos) AS BIGINT) AS b FROM r)"


@query("inclusive_scan_user_operation", RESETS + " SELECT event_id, CAST(a AS BIGINT) AS a, b FROM s")
def inclusive_scan_user_operation(spark, sf):
    return ordered.scan(_maps(spark, sf), ["a", "b"], then).select("event_id", "a", "b")


@query("exclusive_scan_user_operation", RESETS + " SELECT event_id, CAST(coalesce(lag(a) OVER (ORDER BY pos), 1) AS BIGINT) AS a, CAST(coalesce(lag(b + 7 * a) OVER (ORDER BY pos), 7) AS BIGINT) AS b FROM s")
def exclusive_scan_user_operation(spark, sf):
    return ordered.scan(_maps(spark, sf), ["a", "b"], then, exclusive=True, init={"a": 1, "b": 7}).select("event_id", "a", "b")


@query("reduce_user_operation", RESETS + " SELECT CAST(max_by(a, pos) AS BIGINT) AS a, max_by(b, pos) AS b FROM s")
def reduce_user_operation(spark, sf):
    return ordered.reduce(_maps(spark, sf), ["a", "b"], then)


@query("reduce_by_key_user_operation", RUNS + " SELECT island, min(event_type) AS event_type, string_agg(CAST(event_id AS VARCHAR), '-' ORDER BY pos) AS ids FROM i GROUP BY island")
def reduce_by_key_user_operation(spark, sf):
    s = events(spark, sf)
    s = s.with_df(s.df.withColumn("ids", F.col("event_id").cast("string")))
    return ordered.reduce_by_key(s, ["event_type"], ["ids"], lambda a, b: {"ids": a["ids"] + "-" + b["ids"]})


@query("scan_by_key_user_operation", RUNS + ", r AS (SELECT *, sum(CASE WHEN cents % 4 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY island ORDER BY pos) AS g FROM i) SELECT event_id, CAST(sum(cents) OVER (PARTITION BY island, g ORDER BY pos) AS BIGINT) AS b FROM r")
def scan_by_key_user_operation(spark, sf):
    s = events(spark, sf)
    s = s.with_df(s.df.select("event_id", "event_type", (F.col("cents") % 4 != 0).cast("long").alias("a"), F.col("cents").alias("b")))
    return ordered.scan_by_key(s, ["event_type"], ["a", "b"], then).select("event_id", "b")


# --- sums of doubles, the same bits for any grouping ------------------------------------------------

#: Thirds of values as whole multiples of 2 ** -70, and their sum rounded once to a double.
THIRDS = "CAST(value / 3 * 1180591620717411303424 AS HUGEINT)"
NEAREST = "(CAST({s} // 9007199254740992 AS DOUBLE) * 9007199254740992 + CAST({s} % 9007199254740992 AS DOUBLE)) / 1180591620717411303424"
D = "WITH e AS (SELECT event_id, event_type, " + THIRDS + " AS x, row_number() OVER (ORDER BY event_id) - 1 AS pos FROM events WHERE value <> 0), h AS (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER (ORDER BY pos) AND pos > 0 THEN 0 ELSE 1 END AS head FROM e), i AS (SELECT *, CAST(sum(head) OVER (ORDER BY pos) - 1 AS BIGINT) AS island FROM h)"


def _thirds(spark, sf):
    df = read(spark, sf, "events").where("value <> 0").select("event_id", "event_type", (F.col("value") / 3).alias("x"))
    return Sequence(df, ("event_id",)), Exact(df, "x")


@query("deterministic_scan_doubles", D + ", s AS (SELECT event_id, sum(x) OVER (ORDER BY pos) AS s FROM e) SELECT event_id, " + NEAREST.format(s="s") + " AS y FROM s")
def deterministic_scan_doubles(spark, sf):
    s, exact = _thirds(spark, sf)
    return scans.inclusive_scan(s, exact()).select("event_id", exact.back(F.col("y")).alias("y"))


@query("deterministic_scan_by_key_doubles", D + ", s AS (SELECT event_id, sum(x) OVER (PARTITION BY island ORDER BY pos) AS s FROM i) SELECT event_id, " + NEAREST.format(s="s") + " AS y FROM s")
def deterministic_scan_by_key_doubles(spark, sf):
    s, exact = _thirds(spark, sf)
    return scans.inclusive_scan_by_key(s, ["event_type"], exact()).select("event_id", exact.back(F.col("y")).alias("y"))


@query("deterministic_reduce_by_key_doubles", D + ", s AS (SELECT island, sum(x) AS s FROM i GROUP BY island) SELECT island, " + NEAREST.format(s="s") + " AS y FROM s")
def deterministic_reduce_by_key_doubles(spark, sf):
    s, exact = _thirds(spark, sf)
    return reduce.reduce_by_key(s, ["event_type"], {"s": F.sum(exact())}).select("island", exact.back(F.col("s")).alias("y"))


# --- other forms ------------------------------------------------------------------------------------


@query("partition_two_way_flags", E + " SELECT event_id, CAST(CASE WHEN user_id % 2 = 0 THEN 0 ELSE 1 END AS INTEGER) AS part FROM e")
def partition_two_way_flags(spark, sf):
    df = events(spark, sf).df.withColumn("flag", (F.col("user_id") % 2 == 0).cast("int"))
    return basic.partition_two_way(df, "flag").select("event_id", "part")


@query("partition_three_way_counts", E + " SELECT CAST(CASE WHEN cents % 2 = 0 THEN 0 WHEN cents % 3 = 0 THEN 1 ELSE 2 END AS INTEGER) AS part, count(*) AS n FROM e GROUP BY 1")
def partition_three_way_counts(spark, sf):
    return basic.part_counts(basic.partition_three_way(events(spark, sf).df, F.col("cents") % 2 == 0, F.col("cents") % 3 == 0))


@query("radix_sort_pairs", "SELECT o_custkey, o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1 AS pos FROM orders")
def radix_sort_pairs(spark, sf):
    return sorting.radix_sort(orders(spark, sf), "o_custkey").select("o_custkey", "o_orderkey", "cents", "pos")


@query("radix_sort_pairs_desc", "SELECT o_custkey, o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, row_number() OVER (ORDER BY (o_custkey >> 1) & 255 DESC, o_orderkey) - 1 AS pos FROM orders")
def radix_sort_pairs_desc(spark, sf):
    return sorting.radix_sort(orders(spark, sf), "o_custkey", 1, 9, descending=True).select("o_custkey", "o_orderkey", "cents", "pos")


IMAGE = "(SELECT CAST(round(value * 100) AS BIGINT) AS cents, user_id, row_number() OVER (ORDER BY event_id) - 1 AS pos FROM events) WHERE pos % 100 < 60"


def _image(spark, sf):
    """Events as an image, 100 to a row; its first 60 columns."""
    df = position(events(spark, sf)).select("cents", "user_id", (F.col("pos") % 100).alias("col"), F.floor(F.col("pos") / 100).alias("row"))
    return histogram.region(df, 60, None)


@query("histogram_range_region", "WITH l AS (SELECT * FROM (VALUES (0, 0, 100), (1, 100, 1000), (2, 1000, 2500), (3, 2500, 9000), (4, 9000, 50000)) v(bin, lo, hi)) SELECT CAST(bin AS INTEGER) AS bin, count(x) AS n FROM l LEFT JOIN (SELECT cents AS x FROM " + IMAGE + ") ON x >= lo AND x < hi GROUP BY bin")
def histogram_range_region(spark, sf):
    return histogram.histogram_range(_image(spark, sf), "cents", LEVELS)


MULTI = "WITH x AS (SELECT 0 AS channel, cents AS v FROM {t} UNION ALL SELECT 1, user_id FROM {t}), l AS (SELECT * FROM (VALUES {l}) v(channel, bin, lo, hi)) SELECT CAST(l.channel AS INTEGER) AS channel, CAST(bin AS INTEGER) AS bin, count(v) AS n FROM l LEFT JOIN x ON l.channel = x.channel AND v >= lo AND v < hi GROUP BY 1, 2"


@query("multi_histogram_even_region", MULTI.format(t=IMAGE, l="(0, 0, 0, 4000), (0, 1, 4000, 8000), (0, 2, 8000, 12000), (1, 0, 0, 10), (1, 1, 10, 20)"))
def multi_histogram_even_region(spark, sf):
    return histogram.multi_histogram_even(_image(spark, sf), ["cents", "user_id"], [4, 3], [0, 0], [12000, 20])


@query("multi_histogram_range_region", MULTI.format(t=IMAGE, l="(0, 0, 0, 100), (0, 1, 100, 9000), (1, 0, 1, 5), (1, 1, 5, 50)"))
def multi_histogram_range_region(spark, sf):
    return histogram.multi_histogram_range(_image(spark, sf), ["cents", "user_id"], [[0, 100, 9000], [1, 5, 50]])


@query("discontinuity_indexed", E + " SELECT event_id, pos % 64 = 0 OR event_type <> lag(event_type) OVER (ORDER BY pos) AS head FROM e")
def discontinuity_indexed(spark, sf):
    return difference.flag_heads_indexed(events(spark, sf), "event_type", lambda a, b, i: ~a.eqNullSafe(b) | (i % 64 == 0)).select("event_id", "head")


@query("radix_key_codec_64", "SELECT o_orderkey, o_orderkey + (-9223372036854775807 - 1) AS code, -1 - (o_orderkey + (-9223372036854775807 - 1)) AS code_desc, o_orderkey AS back FROM orders")
def radix_key_codec_64(spark, sf):
    code, down = arrays.encode_key(F.col("o_orderkey"), 64), arrays.encode_key(F.col("o_orderkey"), 64, descending=True)
    return read(spark, sf, "orders").select("o_orderkey", code.alias("code"), down.alias("code_desc"), arrays.decode_key(down, 64, descending=True).alias("back"))


@query("radix_key_codec_doubles", "SELECT c_custkey, c_acctbal AS back, dense_rank() OVER (ORDER BY c_acctbal) - 1 AS rank FROM customer")
def radix_key_codec_doubles(spark, sf):
    """Ranks by the codes of doubles are those of the doubles."""
    df = read(spark, sf, "customer").select("c_custkey", arrays.encode_double("c_acctbal").alias("code"))
    s = Sequence(df, ("code", "c_custkey"))
    return scans.scan_runs(s, scans.Runs(("code",)), number="rank").select("c_custkey", arrays.decode_double("code").alias("back"), "rank")


@query("block_subtract_partial", E + TILES + " SELECT event_id, CASE WHEN lane < 200 THEN cents - coalesce(lag(cents) OVER w, 11) ELSE cents END AS l, CASE WHEN lane < 199 THEN cents - coalesce(lead(cents) OVER w, 0) ELSE cents END AS r FROM t WINDOW w AS (PARTITION BY tile ORDER BY lane)")
def block_subtract_partial(spark, sf):
    t = tile.subtract_left(_tiles(spark, sf), "cents", "l", valid=200, before=F.lit(11))
    return tile.subtract_right(t, "cents", "r", valid=200).select("event_id", "l", "r")


@query("block_sort_partial", E + TILES + " SELECT event_id, CAST(CASE WHEN lane >= 100 THEN lane ELSE row_number() OVER (PARTITION BY tile, lane >= 100 ORDER BY cents DESC, lane) - 1 END AS INTEGER) AS rank FROM t")
def block_sort_partial(spark, sf):
    return tile.sort(_tiles(spark, sf), "cents", descending=True, valid=100).select("event_id", "rank")


@query("warp_reduce", E + TILES + " SELECT wtile AS tile, max(cents) AS y FROM w GROUP BY wtile")
def warp_reduce(spark, sf):
    return tile.reduce(_tiles(spark, sf, 64), "cents", "max")


@query("warp_scan", E + TILES + " SELECT event_id, CAST(sum(cents) OVER (PARTITION BY wtile ORDER BY wlane) AS BIGINT) AS y FROM w")
def warp_scan(spark, sf):
    return tile.scan(_tiles(spark, sf, 64), "cents").select("event_id", "y")


@query("warp_sort", E + TILES + " SELECT event_id, CAST(row_number() OVER (PARTITION BY wtile ORDER BY cents DESC, wlane) - 1 AS INTEGER) AS rank FROM w")
def warp_sort(spark, sf):
    return tile.sort(_tiles(spark, sf, 64), "cents", descending=True).select("event_id", "rank")
