"""Removal of repeated byte strings with multi-string Burrows-Wheeler transforms built column by column.

A byte of a document goes if a string of ``length`` (50) bytes over it also starts in a document with a
smaller id. Whole texts are compared, in these steps:

0. A text that a smaller id has whole goes whole; the rest works on texts without these copies.
1. Every window of ``length`` bytes has a key: the hash of its minimizer, the ``K`` bytes in it with the least hash,
   and of 13 bytes on one side of it; equal windows have equal keys. Keys in at least two rows are marked in a bit
   table (its size follows the input up to ``MAX_TABLE`` bits; a false mark only costs work).
2. Windows in a row with one marked key form a segment of at most 63 bytes. Equal segments are found by key and
   hash (95 bits) and give their least id. Keys met more than ``HOT`` times are dealt window by window, by the
   window's hash, so no group grows with them.
3. Unlike segments with one key may share windows too. Their bytes are dealt to buckets by key, and in each
   bucket the transform of all segments is built by inserting one symbol of every segment a round, from the last
   to the first; the common prefixes of neighbouring suffixes are updated in the same round, from those of the round before.
   Neighbours sharing ``length`` symbols are one string, whose least id is taken.
4. Least ids of segments, and of runs of their windows, are joined back to all occurrences; texts with a
   hit (found by a bit table, then exactly) are joined to their spans and cut.

Defined results: a null text is empty; texts under ``length`` bytes stay whole; matches never cross
documents; rows of one id do not remove each other; an empty table gives no rows; columns other than id and
text are ignored, whatever their names. Texts of any length are compared whole. Rows without an id lose what any id has and remove nothing.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import ship_code, stored
from .textops import BASE_INV, U64, chunks, mix64, pack_steps, powers, prefix_hash, span_hash, unpack_steps, utf8

LENGTH = 50
K = 24
HOT = 20_000
COPY_BITS = 24
MAX_TABLE = 1 << 29
SEGMENT_BYTES, BUCKET_BYTES, BATCH_BYTES = 8 << 20, 2 << 20, 6 << 20
FRACTION = 28
#: Rows and bytes of text that a task works on at a time.
ROWS, TEXT_BYTES = 512, 1 << 18
NO_ID = np.iinfo(np.int64).max


def minimizers(data: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window and key of every run of windows with one key, and run lengths.

    A window's minimizer is the leftmost of its ``K`` bytes with the least hash. Its key is the hash of the minimizer and
    of ``(length - K) // 2`` bytes before it, where the window has as many, else of as many after it.
    """
    width, half = length - K + 1, (length - K) // 2
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, np.int64)
    h = prefix_hash(data)
    back = powers(len(data) + 1, BASE_INV)
    each = (h[K:] - h[:-K]) * back[: len(data) - K + 1]
    each ^= each >> U64(29)
    each *= U64(0xBF58476D1CE4E5B9)
    each &= ~U64(0xFFFFFFFF)
    least, step = each | np.arange(len(each), dtype=U64), 1  # hash, then place: of equal ones the leftmost
    while 2 * step <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if step < width:
        least = np.minimum(least[: len(least) - (width - step)], least[width - step :])
    inside = np.zeros(len(least) + 1, bool)  # windows within one document, at 1 + window
    for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
        if b - a >= length:
            inside[1 + a : 1 + b - length + 1] = True
    first = inside[1:].copy()
    first[1:] &= (least[1:] != least[:-1]) | ~inside[1:-1]
    edge = off[:-1][off[:-1] < len(first)]
    first[edge] = inside[1 + edge]
    start = np.flatnonzero(first)
    total = np.concatenate([[0], np.cumsum(inside[1:])])
    end = start + np.diff(total[np.concatenate([start, [len(least)]])])
    at = (least[start] & U64(0xFFFFFFFF)).astype(np.int64)
    split = np.clip(at - half + 1, start, end)
    parts = []
    for x, y, gram, salt in ((start, split, at - half, 1), (split, end, at, 2)):
        some = np.flatnonzero(x < y)
        gram = gram[some]
        parts.append((x[some], mix64((h[gram + K + half] - h[gram]) * back[gram] + U64(salt)), (y - x)[some]))
    x, key, n = (np.concatenate(c) for c in zip(*parts))
    order = np.argsort(x, kind="stable")
    return x[order], key[order], n[order]


def _in_table(table: np.ndarray, values: np.ndarray, bits: int) -> np.ndarray:
    at = values & ((1 << bits) - 1)
    return (table[at >> 6] >> (at & 63)) & 1 == 1


def _kept_rows(batch: pa.RecordBatch, copies: np.ndarray) -> pa.Array:
    """Rows that are not in the table of copies, and those that were let in again."""
    force = batch.column(3).to_numpy(zero_copy_only=False).astype(bool)
    return pa.array(force | ~_in_table(copies, batch.column(4).to_numpy(), COPY_BITS))


def _texts(batches: Iterator[pa.RecordBatch], copies: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, text keys, bytes, offsets) of some documents at a time."""
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            batch = whole.slice(at, ROWS)
            batch = batch.filter(_kept_rows(batch, copies))
            ids, t = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            data, off = utf8(batch.column(1))
            for i, j in chunks(off, TEXT_BYTES):
                yield ids[i:j], t[i:j], data[off[i] : off[j]], off[i : j + 1] - off[i]


def _places(h: np.ndarray, stretch: int) -> np.ndarray:
    """Two places of each key in its segment's stretch of the bit table, by the key's ``FRACTION`` bits there."""
    other = (mix64(h + U64(1)) >> U64(64 - FRACTION)) if len(h) else h
    return np.stack([(h * U64(stretch)) >> U64(FRACTION), (other * U64(stretch)) >> U64(FRACTION)]).astype(np.int64)


def marks(docs: DataFrame, length: int, bits: int, table_bits: int, copies) -> tuple[np.ndarray, np.ndarray]:
    """Bit tables, by the first bits of the hash, of shared and of hot keys.

    A segment holds the keys with the same first ``bits`` bits and so a stretch of either table.
    """
    stretch = (1 << table_bits) >> bits

    def run(batches):
        def flush(parts):
            h, n = np.unique(np.concatenate(parts), return_counts=True)
            where, first = np.unique((h >> U64(64 - bits)).astype(np.int32), return_index=True)  # no empty rows
            rest = (h << U64(bits)) >> U64(64 - FRACTION)
            rows = [(rest[a:b], n[a:b]) for a, b in zip(first, [*first[1:], len(h)])]
            columns = [[pack_steps(r[k == 1]) for r, k in rows], [pack_steps(r[k > 1]) for r, k in rows], [k[k > 1].astype(np.uint32).tobytes() for _, k in rows]]
            return pa.RecordBatch.from_arrays([pa.array(where), *[pa.array(c, pa.binary()) for c in columns]], ["segment", "once", "more", "counts"])

        held, size = [], 0
        for _, _, data, off in _texts(batches, copies.value):
            start, h, _ = minimizers(data, off, length)
            owner = np.searchsorted(off, start, "right").astype(U64)
            _, once = np.unique(mix64(h + owner * U64(0x9E3779B97F4A7C15)), return_index=True)
            held.append(h[once])  # each key once for each document
            size += len(data)
            if size >= BATCH_BYTES:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        once, more = unpack_steps(pdf.once), unpack_steps(pdf.more)
        h = np.concatenate([once, more])
        n = np.concatenate([np.ones(len(once), np.int64), np.frombuffer(b"".join(pdf.counts), np.uint32).astype(np.int64)])
        order = np.argsort(h, kind="stable")
        h, n = h[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        n = np.add.reduceat(n, first) if len(first) else n
        out = {"segment": [pdf.segment.iloc[0]]}
        for name, most in (("shared", 1), ("hot", HOT)):
            bitmap = np.zeros(stretch, bool)
            bitmap[_places(h[first[n > most]], stretch)] = True
            out[name] = [np.packbits(bitmap, bitorder="little").tobytes() if bitmap.any() else b""]
        return pd.DataFrame(out)

    rows = docs.mapInArrow(run, "segment int, once binary, more binary, counts binary").groupBy("segment").applyInPandas(merge, "segment int, shared binary, hot binary").toArrow()  # 2 * MAX_TABLE bits at most
    tables = []
    for name in ("shared", "hot"):
        table = np.zeros((1 << table_bits) // 8, np.uint8)
        for s, raw in zip(rows["segment"].to_pylist(), rows[name]):
            if len(part := np.frombuffer(raw.as_buffer(), np.uint8)):
                table[s * stretch // 8 : (s + 1) * stretch // 8] = part
        tables.append(table if table.any() else table[:0])
    return tables[0], tables[1]


def _marked(table: np.ndarray, h: np.ndarray, table_bits: int, bits: int) -> np.ndarray:
    if not len(table):
        return np.zeros(len(h), bool)
    stretch = (1 << table_bits) >> bits
    at = _places((h << U64(bits)) >> U64(64 - FRACTION), stretch) + (h >> U64(64 - bits)).astype(np.int64) * stretch
    return ((table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1).all(axis=0)


def segments(data, off, length, shared, hot, table_bits, bits):
    """(start, end, key, hash) of the segments with marked keys; the key of a hot one's window is the window's hash."""
    start, h, run = minimizers(data, off, length)
    keep = _marked(shared, h, table_bits, bits)
    start, h, run = start[keep], h[keep], run[keep]
    is_hot = _marked(hot, h, table_bits, bits)
    size = np.where(is_hot, 1, length - K + 1)
    pieces = -(-run // size)
    at = np.repeat(start, pieces) + (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * np.repeat(size, pieces)
    end = np.minimum(at + np.repeat(size, pieces), np.repeat(start + run, pieces)) + length - 1
    own = span_hash(prefix_hash(data), at, end)
    return at, end, np.where(np.repeat(is_hot, pieces), own, np.repeat(h, pieces)), own


def _least_between(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Minimum of values[low : high + 1] of each pair, low <= high, by minima over powers of two."""
    size = high - low + 1
    power = np.frexp(size)[1] - 1
    out, level = np.empty(len(low), values.dtype), values
    for k in range(int(power.max(initial=-1)) + 1):
        if k:
            level = np.minimum(level[: -(1 << (k - 1))], level[1 << (k - 1) :])
        who = np.flatnonzero(power == k)
        out[who] = np.minimum(level[low[who]], level[high[who] - (1 << k) + 1])
    return out


def transform(data: np.ndarray, off: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Burrows-Wheeler transform of all strings, 0 ending a string and a byte being one more, and its rows' common prefixes.

    Round j inserts, at the place that the transform so far gives it, the symbol before each string's suffix of
    length j. The suffix shares with its neighbour of the same first symbol one symbol more than the suffixes after that
    symbol share, which the rows so far tell; prefixes over ``most`` (up to 127) count as ``most``.
    """
    m, size = len(off) - 1, np.diff(off)
    symbol = np.concatenate([data, [0]]).astype(np.uint8) + np.uint8(1)
    before = lambda j, who: np.where(size[who] > j, symbol[np.maximum(off[1:][who] - 1 - j, 0)], 0).astype(np.uint8)
    who = np.arange(m)
    out, place, common = before(0, who), np.arange(m), np.zeros(m, np.int8)
    for j in range(1, int(size.max(initial=0)) + 1):
        active = size[who] >= j
        who, place = who[active], place[active]
        order = np.argsort(out, kind="stable")
        rank = np.empty(len(out), np.int64)
        rank[order] = np.arange(len(out))
        at = rank[place]
        ends = np.count_nonzero(out == 0)
        grown = np.zeros(m + len(out) - ends, np.int8)
        old = np.ones(len(grown), bool)
        old[m + at - ends] = False
        grown[old] = common
        for first, last in ((at - 1, at), (at, np.minimum(at + 1, len(out) - 1))):  # with the row before, and the row after with this one
            x, y = order[np.maximum(first, 0)], order[last]
            same = (first >= 0) & (first < last) & (out[x] == out[y])
            shared = np.zeros(len(at), np.int8)
            shared[same] = np.minimum(_least_between(common, x[same] + 1, y[same]), most - 1) + 1
            row = m + last - ends
            grown[row[first < last]] = shared[first < last]
        symbols = np.empty(len(grown), np.uint8)
        place = m + at - ends
        symbols[old], symbols[place] = out, before(j, who)
        out, common = symbols, grown
    return out, common


def least_ids(data: np.ndarray, off: np.ndarray, ids: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Least id over equal windows, for every window of every string, and offsets of the strings' windows."""
    m, size = len(off) - 1, np.diff(off)
    bwt, common = transform(data, off, length)
    order = np.argsort(bwt, kind="stable")
    step = np.empty(len(bwt), np.int32)
    step[order] = np.arange(len(bwt), dtype=np.int32)
    step += np.int32(m - np.count_nonzero(bwt == 0))
    string, offset = np.zeros(len(bwt), np.int32), np.zeros(len(bwt), np.int32)
    place = np.arange(m)
    string[:m], offset[:m] = np.arange(m), size
    for j in range(1, int(size.max(initial=0)) + 1):
        who = np.flatnonzero(size >= j)
        place[who] = step[place[who]]
        string[place[who]], offset[place[who]] = who, size[who] - j
    windows = np.maximum(size - length + 1, 0)
    woff = np.concatenate([[0], np.cumsum(windows)])
    out = np.zeros(woff[-1], np.int64)
    rows = np.flatnonzero(size[string] - offset >= length)
    if len(rows):
        first = np.flatnonzero(common[rows] < length)
        low = np.minimum.reduceat(ids[string[rows]], first)
        out[woff[string[rows]] + offset[rows]] = np.repeat(low, np.diff(np.concatenate([first, [len(rows)]])))
    return out, woff


def _bit_table(ids: DataFrame, column: str, bits: int) -> np.ndarray:
    """Bits set at the values of a long column modulo 2**bits."""
    place = ids.select(F.pmod(F.col(column), F.lit(1 << bits)).alias("p")).selectExpr("cast(p div 64 as int) AS word", "shiftleft(1L, cast(p % 64 as int)) AS bit")
    got = place.groupBy("word").agg(F.bit_or("bit").alias("b")).toArrow()  # 2**bits / 64 rows at most
    table = np.zeros((1 << bits) // 64, np.int64)
    table[got["word"].to_numpy()] = got["b"].to_numpy()
    return table


def _narrow(h: np.ndarray) -> np.ndarray:
    """A key's group: 31 of its bits; unlike keys in one group only share a transform."""
    return (h >> U64(33)).astype(np.int64)


def _split_copies(rows: DataFrame, length: int):
    """Rows whose text an id below theirs has whole, the other rows, and the table that tells them apart.

    The table has false hits; rows it names wrongly are found by an exact join and let in again (``force``).
    """
    key = [F.col("t"), F.octet_length("text").alias("n"), F.crc32("text").alias("c")]
    keyed = rows.where(F.octet_length("text") >= length).select("doc_id", "r", *key)
    first = keyed.groupBy("t", "n", "c").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    copied = stored(keyed.join(first, ["t", "n", "c"]).where("doc_id > low").select("doc_id", "t", "r").distinct(), "copies")
    copies = rows.sparkSession.sparkContext.broadcast(_bit_table(copied, "r", COPY_BITS))

    def named(batches):
        for batch in batches:
            yield batch.filter(pa.array(_in_table(copies.value, batch.column(4).to_numpy(), COPY_BITS)))

    maybe = rows.mapInArrow(named, rows.schema)
    gone = maybe.join(copied, ["doc_id", "t", "r"], "left_semi")
    wrong = stored(maybe.join(copied, ["doc_id", "t", "r"], "left_anti").select(*rows.columns), "again").withColumn("force", F.lit(True))
    return gone, rows.union(wrong), copies


def removed(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the remaining bytes) of every row."""
    ship_code(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("t"), F.lit(False).alias("force"))
    rows = rows.withColumn("r", F.xxhash64("doc_id", "t"))
    n_bytes = rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    bits = max(8, int(n_bytes // SEGMENT_BYTES).bit_length())
    table_bits = min(max(int(n_bytes * 0.15).bit_length(), 20), MAX_TABLE.bit_length() - 1)
    context = rows.sparkSession.sparkContext
    gone, rows, copies = _split_copies(rows, length)
    tables = context.broadcast(marks(rows, length, bits, table_bits, copies))
    buckets = n_bytes // BUCKET_BYTES + 1

    def occur(batches):
        for ids, t, data, off in _texts(batches, copies.value):
            a, b, h, s = segments(data, off, length, *tables.value, table_bits, bits)
            if len(a):
                d = np.searchsorted(off, a, "right") - 1
                columns = [_narrow(h), s.view(np.int64), ids[d], t[d], (a - off[d]).astype(np.int32), (b - a - length + 1).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["m", "s", "doc_id", "t", "at", "windows"])

    met = rows.mapInArrow(occur, "m long, s long, doc_id long, t long, at int, windows int")
    distinct = stored(met.groupBy("m", "s").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).select("m", "s", F.when(F.col("low") < F.col("high"), F.col("low")).alias("low")), "segments")
    mixed = distinct.groupBy("m").agg(F.count("*").alias("n")).where("n > 1")
    mixed_bits = min(table_bits, 25)
    mixed_table = context.broadcast(_bit_table(mixed, "m", mixed_bits))

    def emit(batches):
        for ids, _, data, off in _texts(batches, copies.value):
            a, b, h, s = segments(data, off, length, *tables.value, table_bits, bits)
            m = _narrow(h)
            keep = np.flatnonzero(_in_table(mixed_table.value, m, mixed_bits))
            keep = keep[np.lexsort((ids[np.searchsorted(off, a[keep], "right") - 1], s[keep], m[keep]))]
            k = keep[np.concatenate([[True], (m[keep][1:] != m[keep][:-1]) | (s[keep][1:] != s[keep][:-1])])] if len(keep) else keep  # least id of each in the chunk
            raw = data.tobytes()
            columns = [pa.array(m[k] % buckets), pa.array(m[k]), pa.array(s[k].view(np.int64)), pa.array([raw[x:y] for x, y in zip(a[k].tolist(), b[k].tolist())], pa.binary()), pa.array(ids[np.searchsorted(off, a[k], "right") - 1])]
            yield pa.RecordBatch.from_arrays(columns, ["bucket", "m", "s", "segment", "doc_id"])

    def sort_out(pdf: pd.DataFrame) -> pd.DataFrame:
        order = np.lexsort((pdf.s.to_numpy(), pdf.m.to_numpy()))
        m, t, ids = pdf.m.to_numpy()[order], pdf.s.to_numpy()[order], pdf.doc_id.to_numpy()[order]
        first = np.flatnonzero(np.concatenate([[True], (m[1:] != m[:-1]) | (t[1:] != t[:-1])]))
        own, m, t, texts = np.minimum.reduceat(ids, first), m[first], t[first], pdf.segment.to_numpy()[order[first]]
        windows = np.fromiter(map(len, texts), np.int64, len(texts)) - length + 1
        woff = np.concatenate([[0], np.cumsum(windows)])
        low, _ = least_ids(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum(windows + length - 1)]), own, length)
        keep = np.flatnonzero(np.minimum.reduceat(low, woff[:-1]) < own)
        starts = np.zeros(len(low), bool)
        starts[0], starts[1:] = True, low[1:] != low[:-1]
        starts[woff[:-1]] = True
        at = np.flatnonzero(starts)
        triple = np.stack([at - np.repeat(woff[:-1], windows)[at], np.diff(np.concatenate([at, [len(low)]])), low[at]], axis=1).astype("<i8")
        raw, edge = triple.tobytes(), 24 * np.searchsorted(at, woff)
        return pd.DataFrame({"m": m[keep], "s": t[keep], "runs": [raw[edge[i] : edge[i + 1]] for i in keep]})

    crossed = rows.mapInArrow(emit, "bucket long, m long, s long, segment binary, doc_id long").groupBy("bucket").applyInPandas(sort_out, "m long, s long, runs binary")
    known = distinct.where("low IS NOT NULL").join(crossed, ["m", "s"], "full").select("m", "s", F.coalesce("low", F.lit(NO_ID)).alias("low"), "runs")

    def ranges(batches):
        for batch in batches:
            ids, t, at, windows, low = (batch.column(k).to_numpy() for k in range(5))
            whole = ids > low
            part = np.flatnonzero(~whole)
            runs = batch.column(5).take(pa.array(part))
            sizes = np.array([len(r.as_buffer()) // 24 for r in runs], np.int64)
            r = np.frombuffer(b"".join(x.as_buffer() for x in runs), "<i8").reshape(-1, 3)
            who = np.repeat(part, sizes)
            ok = r[:, 2] < ids[who]
            who, r = who[ok], r[ok]
            rows_ = np.concatenate([np.flatnonzero(whole), who])
            first = np.concatenate([at[whole], at[who] + r[:, 0]])
            n = np.concatenate([windows[whole], r[:, 1]])
            yield pa.RecordBatch.from_arrays([pa.array(ids[rows_]), pa.array(t[rows_]), pa.array(first.astype(np.int32)), pa.array((first + n + length - 1).astype(np.int32))], ["doc_id", "t", "a", "b"])

    hits = met.join(known, ["m", "s"]).where("doc_id > low OR runs IS NOT NULL").select("doc_id", "t", "at", "windows", "low", "runs").mapInArrow(ranges, "doc_id long, t long, a int, b int")

    def united(batches):
        for batch in batches:
            out = []
            for spans in batch.column(2):
                a, b = spans.values.field(0).to_numpy(), spans.values.field(1).to_numpy()
                order = np.argsort(a, kind="stable")
                a, b = a[order], np.maximum.accumulate(b[order])
                opens = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1]]))
                out.append(np.stack([a[opens], b[np.concatenate([opens[1:] - 1, [len(b) - 1]])]], axis=1).ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int32()))], ["doc_id", "t", "spans"])

    found = hits.groupBy("doc_id", "t").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    spans = stored(found.mapInArrow(united, "doc_id long, t long, spans array<int>"), "spans")
    cut_bits = 24
    cut_table = context.broadcast(_bit_table(spans, "t", cut_bits))

    def pick(wanted: bool):
        def run(batches):
            for whole in batches:
                for at in range(0, whole.num_rows, ROWS):
                    batch = whole.slice(at, ROWS)
                    batch = batch.filter(_kept_rows(batch, copies.value))
                    yield batch.filter(pa.array(_in_table(cut_table.value, batch.column(2).to_numpy(), cut_bits) == wanted)).select([0, 1, 2])

        return run

    def packed(batches):
        for batch in pick(True)(batches):
            yield batch.set_column(1, "text", pa.array([zlib.compress((x or "").encode(), 1) for x in batch.column(1).to_pylist()], pa.binary()))

    def cut(batches):
        for batch in batches:
            n_bytes, n_removed, n_spans, kept = [], [], [], []
            for text, spans in zip(batch.column(1), batch.column(2).to_pylist()):
                raw, done, parts, gone_ = zlib.decompress(text.as_buffer()), 0, [], 0
                spans = spans or []
                for x, y in zip(spans[::2], spans[1::2]):
                    parts.append(raw[done:x])
                    done, gone_ = y, gone_ + y - x
                parts.append(raw[done:])
                n_bytes.append(len(raw)), n_removed.append(gone_), n_spans.append(len(spans) // 2), kept.append(b"".join(parts))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)], pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    touched = rows.mapInArrow(packed, "doc_id long, text binary, t long").join(spans, ["doc_id", "t"], "left").select("doc_id", "text", "spans")
    changed = touched.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    zero, size = F.lit(0).cast("long"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    whole = rows.mapInArrow(pick(False), "doc_id long, text string, t long").select("doc_id", size.alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("kept"))
    empty = gone.select("doc_id", size.alias("n_bytes"), size.alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit("").cast("binary").alias("kept"))
    return changed.union(whole).union(empty).withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    from .tables import table

    out = removed(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def digest(kept: bytes) -> str:
    return hashlib.sha256(kept).hexdigest()


ORACLE = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, k, substr(h, 2 * k + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, greatest(len(h) // 2 - 49, 0))) AS k FROM d)),
m AS (SELECT s, min(doc_id) AS low FROM w GROUP BY s),
hit AS (SELECT w.doc_id, w.k FROM w JOIN m USING (s) WHERE m.low < w.doc_id),
g AS (SELECT *, CASE WHEN k <= lag(k) OVER (PARTITION BY doc_id ORDER BY k) + 50 THEN 0 ELSE 1 END AS first FROM hit),
r AS (SELECT *, sum(first) OVER (PARTITION BY doc_id ORDER BY k) AS span FROM g),
spans AS (SELECT doc_id, span, min(k) AS a, max(k) + 50 AS b FROM r GROUP BY doc_id, span),
cuts AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS done FROM spans),
parts AS (SELECT d.doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * done + 1, 2 * (a - done)), '' ORDER BY a) AS kept, max(b) AS last FROM cuts JOIN d USING (doc_id) GROUP BY d.doc_id)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN parts USING (doc_id)
"""
