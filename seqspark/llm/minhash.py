"""Near-duplicate detection: MinHash, banding, verification, connected components.

1. One pass hashes the word shingles of each text to its set, the set's fingerprint and
   ``BANDS * ROWS`` minima of universal hash functions. Equal sets become one node.
2. Nodes that agree in a band share a bucket. Each is paired with the bucket's least node only, so a bucket of
   n nodes gives n - 1 pairs; buckets are salted, and no task holds a whole one. Pairs whose signatures agree enough are confirmed on the full sets; star
   contraction gives components.
3. Buckets that still hold several components are searched exactly: buckets that share nodes make a
   family, and the members outside a family's commonest component meet all its members. Members are dealt
   to blocks of about ``BLOCK`` rows (fewer if they exceed ``BLOCK_BYTES``) and those outside to such parts, so each row is copied once
   for each block or part of the other side, however many rows those hold. Pairs of different components with close signatures are
   confirmed there on their full sets and only links come out. No bucket, family or partner is capped.

At similarity 0.85 a pair shares no band with probability 7e-9, and ``SLACK`` standard errors are
allowed before a signature dismisses a pair. Sets needed for confirmation are computed in a second pass over the texts;
a bit table of fixed size (``FILTER_BITS``) of wanted ids, broadcast, only spares sets that nobody asked
for.

Defined results: null, empty and wordless texts have an empty set and are linked with nothing; rows of
one id are one node of the graph and give one row each; a row without an id joins the group of an equal set
or stands alone and is kept; texts of any length are one set each; an empty table gives no rows; columns other
than id and text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import components
from .tables import ship_code, stored
from .textops import LOWER, SPACE, U64, chunks, mix64, utf8, word_hashes

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 5
SLACK = 4.5
BLOCK, BLOCK_BYTES = 512, 8 << 20
#: Nodes for each salt of a bucket, if one bucket held all of them.
SALT_NODES = 50_000
FILTER_BITS = 1 << 26

_rng = np.random.default_rng(20240229)
#: Multipliers (odd) and offsets of the universal hash functions x -> a * x + b modulo 2**32.
A = _rng.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
B = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)


def shingle_sets(texts: pa.Array, size: int, keep: np.ndarray | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last + 1, hashes, offsets): the sorted distinct shingle hashes of consecutive texts.

    Fewer words than ``size`` are one shingle. Rows where ``keep`` is false get an empty set.
    """
    data, off = utf8(texts)
    for i, j in chunks(off):
        w, counts = word_hashes(LOWER[data[off[i] : off[j]]], off[i : j + 1] - off[i], SPACE)
        at, sets = 0, []
        mixed = np.zeros(len(w), U64)
        for k in range(min(size, len(w))):
            mixed[: len(w) - k] = mix64(mixed[: len(w) - k] * U64(0x9E3779B97F4A7C15) + w[k:] + U64(k + 1))
        for d in range(i, j):
            n = int(counts[d - i])
            if not n or keep is not None and not keep[d]:
                sets.append(np.zeros(0, U64))
            elif n < size:
                h = U64(n)
                with np.errstate(over="ignore"):
                    for x in w[at : at + n]:
                        h = mix64(np.array([h * U64(0xD1B54A32D192ED03) + x + U64(77)]))[0]
                sets.append(np.array([h], U64))
            else:
                sets.append(np.unique(mixed[at : at + n - size + 1]))
            at += n
        lengths = np.array([len(s) for s in sets])
        yield i, j, np.concatenate(sets) if sets else np.zeros(0, U64), np.concatenate([[0], np.cumsum(lengths)])


def signatures(hashes: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(sets, BANDS * ROWS) minima; all of an empty set are the greatest value."""
    full = np.flatnonzero(np.diff(off))
    out = np.full((len(off) - 1, len(A)), 0xFFFFFFFF, np.uint32)
    if len(full):
        x, starts = (hashes >> U64(32)).astype(np.uint32), off[:-1][full]
        y = np.empty_like(x)
        for k in range(len(A)):
            np.multiply(x, A[k], out=y)
            y += B[k]
            out[full, k] = np.minimum.reduceat(y, starts)
    return out


def bands(sig: np.ndarray) -> np.ndarray:
    """(sets, BANDS) keys of the bands."""
    parts = sig.reshape(len(sig), BANDS, ROWS).astype(U64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=U64), parts.shape[:2]).copy()
    for r in range(ROWS):
        key = mix64(key * U64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return key.view(np.int64)


def _sum_by(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, U64), np.cumsum(values, dtype=U64)])
    return (total[off[1:]] - total[off[:-1]]).view(np.int64)


def _binary(rows: list[bytes]) -> pa.Array:
    return pa.array(rows, pa.binary())


def describe(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, fingerprint (h1, h2) and signature of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, h, off in shingle_sets(batch.column(1), size):
                sig = signatures(h, off)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(np.diff(off)), pa.array(_sum_by(mix64(h), off)), pa.array(_sum_by(mix64(h ^ U64(0xA5A5A5A5A5A5A5A5)), off)), _binary([s.tobytes() for s in sig])],
                    ["doc_id", "n_shingles", "h1", "h2", "sig"],
                )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, h1 long, h2 long, sig binary")


def _band_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_numpy()
        for at in range(0, len(ids), 4096):
            sig = np.frombuffer(b"".join(batch.column(1).slice(at, 4096).to_pylist()), np.uint32).reshape(-1, len(A))
            yield pa.RecordBatch.from_arrays([pa.array(bands(sig).ravel()), pa.array(np.repeat(ids[at : at + 4096], BANDS))], ["band", "node"])


def floor_of(similarity: float) -> float:
    """Least share of equal minima that does not dismiss a pair."""
    return similarity - SLACK * np.sqrt(similarity * (1 - similarity) / len(A))


def _screen(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint32).reshape(-1, len(A)) for k in (2, 3))
            ok = pa.array((a == b).mean(axis=1) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["x", "y"]).filter(ok)

    return run


def _similar(a: bytes, b: bytes, percent: int) -> bool:
    """100 * intersection >= percent * union, of sorted sets of hashes."""
    small, large = sorted((np.frombuffer(a, U64), np.frombuffer(b, U64)), key=len)
    if not len(small) or 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * both >= percent * (len(small) + len(large) - both)


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [_similar(a.as_buffer(), b.as_buffer(), percent) for a, b in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(ok, pa.bool_()))

    return run


def wanted_sets(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(doc_id, hashes) of at least the documents in ``ids`` (doc_id)."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    marked = ids.select(place.alias("place")).selectExpr("cast(place div 64 as int) AS word", "shiftleft(1L, cast(place % 64 as int)) AS bit")
    marked = marked.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # FILTER_BITS / 64 rows at most
    table = np.zeros(FILTER_BITS // 64, np.int64)
    table[marked["word"].to_numpy()] = marked["bits"].to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column(2).to_numpy()
            keep = (shared.value[p >> 6] >> (p & 63)) & 1 == 1
            batch = batch.filter(pa.array(keep))
            for i, j, h, off in shingle_sets(batch.column(1), size):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), _binary([h[a:b].tobytes() for a, b in zip(off[:-1], off[1:])])], ["doc_id", "hashes"])

    return docs.withColumn("place", place).mapInArrow(run, "doc_id long, hashes binary")


def _confirm(docs: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (u, v) of the pairs (x, y) whose full sets are similar enough."""
    pairs = stored(pairs, "pairs")
    ids = pairs.select(F.col("x").alias("doc_id")).union(pairs.select(F.col("y").alias("doc_id")))
    sets = stored(wanted_sets(docs, ids, size), "sets")
    left, right = sets.select(F.col("doc_id").alias("x"), F.col("hashes").alias("a")), sets.select(F.col("doc_id").alias("y"), F.col("hashes").alias("b"))
    return stored(pairs.join(left, "x").join(right, "y").select("x", "y", "a", "b").mapInArrow(_verify(percent), "u long, v long"), "links")


def _bucketed(nodes: DataFrame) -> DataFrame:
    """(band, node, first) of the buckets with several nodes; first: the bucket's least node.

    Each salt of a bucket finds its least node, and those the bucket's, which goes back to the nodes by band and salt.
    """
    salts = nodes.count() // SALT_NODES + 16
    banded = nodes.mapInArrow(_band_rows, "band long, node long").withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(salts)))
    own = Window.partitionBy("band", "salt")
    local = banded.select("band", "node", "salt", F.min("node").over(own).alias("local"), F.count("*").over(own).alias("n"))
    local = local.withColumn("tier", F.when(F.col("node") == F.col("local"), -1).otherwise(F.col("salt")))
    tier = Window.partitionBy("band", "tier")
    out = local.select("band", "node", "salt", "tier", F.min("node").over(tier).alias("least"), F.sum("n").over(tier).alias("total"))
    out = stored(out.where("tier >= 0 OR total > 1").drop("total"), "salted")
    leaders = out.where("tier < 0").select("band", "salt", "node", F.col("least").alias("first"))
    others = out.where("tier >= 0").select("band", "salt", "node").join(leaders.drop("node"), ["band", "salt"])
    return leaders.drop("salt").unionByName(others.drop("salt"))


def _cells(members: DataFrame, homes: DataFrame) -> tuple[DataFrame, list[str]]:
    """Rows of ``members`` by cell, block and part: those outside their family's commonest component ask, all are asked."""
    per = homes.groupBy("family", "component").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    family = per.groupBy("family").agg(F.max(F.struct("n", "component", "bytes")).alias("main"), F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
    blocks = lambda n, size: F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_BYTES))
    all_ = blocks(F.col("n"), F.col("bytes")).alias("blocks")
    outside = blocks(F.col("n") - F.col("main.n"), F.col("bytes") - F.col("main.bytes")).alias("parts")
    family = stored(family.select("family", F.col("main.component").alias("main"), "bytes", "n", all_, outside).where("parts > 0"), "sizes")
    cells = int(family.agg(F.coalesce(F.sum(F.col("bytes") / BLOCK_BYTES + F.col("n") / BLOCK), F.lit(0))).first()[0]) + 1
    own = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("family"), F.lit(cells))).otherwise(F.col("family") + cells)
    keyed = members.join(family, "family").withColumn("cell", own)  # small families share cells
    dealt = lambda c, salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(c))
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    asking = keyed.where("component <> main").withColumn("part", dealt("parts", 2)).withColumn("block", every("blocks")).withColumn("asks", F.lit(True))
    asked = keyed.withColumn("block", dealt("blocks", 1)).withColumn("part", every("parts")).withColumn("asks", F.lit(False))
    columns = ["cell", "block", "part", "family", "asks", "node", "component", "sig", "hashes"]
    return asking.select(columns).union(asked.select(columns)), ["cell", "block", "part"]


def _blocks(members: DataFrame, homes: DataFrame, least: float, percent: int) -> DataFrame:
    """Links between components of (family, node, component, sig, hashes). A link is given only where it joins two components of its group."""

    def links(pdf: pd.DataFrame) -> list[tuple[int, int]]:
        asks, rest = pdf[pdf.asks], pdf[~pdf.asks]
        out: list[tuple[int, int]] = []
        if not len(asks) or not len(rest):
            return out
        s = np.frombuffer(b"".join(rest.sig), np.uint32).reshape(len(rest), -1)
        home, nodes, sets = rest.component.to_numpy().copy(), rest.node.to_numpy(), list(rest.hashes)
        joined: dict[int, int] = {}
        for node, component, sig, own in zip(asks.node, asks.component, asks.sig, asks.hashes):
            while component in joined:
                component = joined[component]
            near = np.count_nonzero(s == np.frombuffer(sig, np.uint32), axis=1) >= least * len(A)
            for i in np.flatnonzero(near & (home != component)):
                if home[i] != component and _similar(own, sets[i], percent):
                    out.append((node, nodes[i]))
                    low, high = sorted((int(component), int(home[i])))
                    joined[high] = component = low
                    home[home == high] = low
        return out

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [x for _, family in pdf.groupby("family") for x in links(family)]
        return pd.DataFrame(out, columns=["u", "v"], dtype="int64")

    rows, keys = _cells(members, homes)
    return rows.groupBy(*keys).applyInPandas(group, "u long, v long")


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row; similarity in whole hundredths."""
    percent = round(100 * similarity)
    ship_code(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    described = stored(describe(rows, shingle_words), "described")
    groups = stored(described.where("n_shingles > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("node")), "groups")  # stored, a skewed join to it can be split
    nodes = stored(groups.join(described.select("h1", "h2", F.col("doc_id").alias("node"), "sig"), ["h1", "h2", "node"]).select("node", "sig").dropDuplicates(["node"]), "nodes")

    buckets = stored(_bucketed(nodes), "buckets")
    pairs = buckets.where("node <> first").select(F.col("node").alias("x"), F.col("first").alias("y")).distinct()
    signed = pairs.join(nodes.select(F.col("node").alias("x"), F.col("sig").alias("a")), "x").join(nodes.select(F.col("node").alias("y"), F.col("sig").alias("b")), "y")
    links = _confirm(rows, signed.select("x", "y", "a", "b").mapInArrow(_screen(floor_of(percent / 100)), "x long, y long"), shingle_words, percent)

    found = stored(components(links), "components")
    placed = buckets.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = stored(placed.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("band"), "mixed")
    families = stored(components(placed.join(mixed, "band").select(F.col("node").alias("u"), F.col("first").alias("v"))), "families").select("node", F.col("component").alias("family"))
    homes = families.join(found, "node", "left").select("node", "family", F.coalesce("component", "node").alias("component"))
    sets = wanted_sets(rows, homes.select(F.col("node").alias("doc_id")), shingle_words).withColumnRenamed("doc_id", "node").dropDuplicates(["node"])
    members = stored(homes.join(nodes, "node").join(sets, "node").withColumn("bytes", F.octet_length("hashes") + 4 * len(A)), "members")
    more = stored(_blocks(members.drop("bytes"), members.select("family", "component", "bytes"), floor_of(percent / 100), percent), "links")
    if not more.isEmpty():
        found = stored(components(links.union(more)), "components")

    out = described.select("doc_id", "n_shingles", "h1", "h2").join(groups, ["h1", "h2"], "left").join(found, "node", "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "node")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def op9_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    from .tables import table

    return near_duplicates(table(spark, sf_dir, "documents"), shingle_words=3, similarity=0.85)
