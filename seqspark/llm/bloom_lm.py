"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts.

Counting: each task counts the distinct words and word pairs of about 6 MB of training text at a time,
as hashes, and deals them by hash to segments, where counts are summed. A count ``c`` has the level
``1 + floor(2 * log2(c))``, and a filter entry is made for each of an n-gram's levels. Each segment has
its own bits, ``BITS`` for an entry, and is stored as a row, so the filter grows with the training text
and no n-gram is left out of it, whatever its count and the size of the input.

Scoring: texts are dealt by id to blocks of about 6 MB; each block asks the segments for its distinct
words and pairs once. The level of an n-gram is the number of probes of its segment's bits, level by
level, until one misses. Words have the probability (1 - u) * q(w) / sum(q), unknown ones share u, the
share of training tokens seen once. A pair has the probability l * q(h, w) / q(h) + (1 - l) * P(w);
quantised counts are rounded down for pairs and up for contexts, so that no context's probabilities sum
to more than one but for false hits. l depends on the level of h and is fitted by
expectation-maximisation, each text left out of its own counts: a token matters only by the levels of
its context, pair and word, so the tokens of all training texts are counted by these three, exactly,
and the rounds run over that table, whose size depends on the levels only.

The base score needs exact counts, which the segments answer together with the levels.

Defined results: a null or empty text is one end token; a text of any length is scored whole; repeated rows
give repeated rows with one score, rows without an id too; n-grams of equal counts have equal levels; without
training rows all probabilities are 1; an empty table gives no rows; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import ship_code, stored
from .textops import LOWER, SPACE, U64, chunks, mix64, pack_steps, unpack_steps, utf8, word_hashes

BITS, PROBES = 12, 6
LEVELS = 130
BATCH_BYTES = 6 << 20
SEGMENT_BYTES = 8 << 20
#: Of the number of segments, so that rows between batches and segments grow with the batches alone in small inputs;
#: in large ones no row is made for a segment that a batch has nothing for.
LEAST_BITS = 8
END, BEGIN = U64(0x51ED270B9F3C1A55), U64(0x2545F4914F6CDD1D)
FRACTION = 32  # bits kept of a pair's hash inside its segment


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each text's end included, and the offsets of the texts."""
    data, off = utf8(texts)
    parts, counts = [], [np.zeros(1, np.int64)]
    for i, j in chunks(off):
        w, n = word_hashes(LOWER[data[off[i] : off[j]]], off[i : j + 1] - off[i], SPACE)
        parts.append(np.insert(w, np.cumsum(n), END))
        counts.append(n + 1)
    return np.concatenate(parts) if parts else np.zeros(0, U64), np.cumsum(np.concatenate(counts))


def pairs(token: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the token before each token, and of the two together."""
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[off[:-1]] = BEGIN
    return before, mix64(before * U64(0x9E3779B97F4A7C15) + token)


def level_of(count: np.ndarray, least: int) -> np.ndarray:
    ok = count >= least
    return np.where(ok, 1 + np.floor(2 * np.log2(np.maximum(count, 1) / least) + 1e-9), 0).astype(np.int64)


def value_of(level: np.ndarray, least: int) -> np.ndarray:
    """Least count of a level; 0 of level 0."""
    return np.where(level > 0, least * 2.0 ** ((level - 1) / 2), 0.0)


def _width(bits: int) -> int:
    """Bytes of a hash that its segment does not tell."""
    return 8 - bits // 8


def _pack(words: np.ndarray, bits: int) -> bytes:
    return words.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : _width(bits)].tobytes()


def _unpack(segment: int, raw: bytes, bits: int) -> np.ndarray:
    out = np.zeros((len(raw) // _width(bits), 8), np.uint8)
    out[:, : _width(bits)] = np.frombuffer(raw, np.uint8).reshape(-1, _width(bits))
    return out.view("<u8").ravel() | U64(int(segment) << (64 - bits))


def fraction(h: np.ndarray, bits: int) -> np.ndarray:
    """What a segment knows of a pair's hash."""
    return (h << U64(bits)) >> U64(64 - FRACTION)


def _ranges(words: np.ndarray, two: np.ndarray, bits: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Segments that have any of the sorted hashes, and their words and pairs, with where they begin."""
    own = [(h >> U64(64 - bits)).astype(np.int32) for h in (words, two)]
    which = np.union1d(*own)
    return which, *[np.searchsorted(o, np.concatenate([which, [1 << bits]])) for o in own]


def _summed(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(h, kind="stable")
    h, n = h[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    return h[first], np.add.reduceat(n, first) if len(first) else n


COUNTED = "segment int, words binary, word_counts binary, once binary, more binary, more_counts binary"
MERGED = "segment int, words binary, word_counts binary, bits binary, n_tokens long, n_types long, q double, rare long"


def count(train: DataFrame, bits: int, filter_bits: int = BITS) -> DataFrame:
    """Exact word counts and the filter's bits by segment. ``train``: one text column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(parts):
            w, n = np.unique(np.concatenate([p[0] for p in parts]), return_counts=True)
            p, m = np.unique(np.concatenate([p[1] for p in parts]), return_counts=True)
            which, we, pe = _ranges(w, p, bits)
            rows = []
            for s, a, b, c, d in zip(which, we[:-1], we[1:], pe[:-1], pe[1:]):
                f, k = fraction(p[c:d], bits), m[c:d]
                rows.append((s, _pack(w[a:b], bits), n[a:b].astype(np.int64).tobytes(), pack_steps(f[k == 1]), pack_steps(f[k > 1]), k[k > 1].astype(np.int64).tobytes()))
            names = [x.split()[0] for x in COUNTED.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int32() if i == 0 else pa.binary()) for i, x in enumerate(zip(*rows))], names)

        held, size = [], 0
        for batch in batches:
            step = 512
            for at in range(0, batch.num_rows, step):
                part = batch.column(0).slice(at, step)
                t, off = tokens(part)
                held.append((t, pairs(t, off)[1]))
                size += part.nbytes
                if size >= BATCH_BYTES:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        segment = pdf.segment.iloc[0]
        w, n = _summed(_unpack(segment, b"".join(pdf.words), bits), np.frombuffer(b"".join(pdf.word_counts), np.int64))
        once, more = unpack_steps(pdf.once), unpack_steps(pdf.more)
        p, m = _summed(np.concatenate([once, more]), np.concatenate([np.ones(len(once), np.int64), np.frombuffer(b"".join(pdf.more_counts), np.int64)]))
        q = float((value_of(level_of(n, 1), 1) * 2**0.25).sum())
        return pd.DataFrame({"segment": [segment], "words": [_pack(w, bits)], "word_counts": [n.tobytes()], "bits": [_segment_bits(w, n, p.astype(U64), m, filter_bits).tobytes()], "n_tokens": [int(n.sum())], "n_types": [len(w)], "q": [q], "rare": [int((n == 1).sum())]})

    return train.mapInArrow(run, COUNTED).groupBy("segment").applyInPandas(merge, MERGED)


class Filter:
    """Bits of segments one after another; ``start``: first bit of each segment."""

    def __init__(self, words: np.ndarray, start: np.ndarray, bits: int):
        self.words, self.start, self.bits = words, start, bits

    def _hit(self, segment: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Places of the keys that all probes find."""
        size = (self.start[1:] - self.start[:-1])[segment].astype(U64)
        left = np.flatnonzero(size > U64(0))
        base, size = self.start[segment[left]], size[left]
        first, step = mix64(key[left]), mix64(key[left] ^ U64(0x94D049BB133111EB)) | U64(1)
        for _ in range(PROBES):
            at = base + (first % size).astype(np.int64)
            hit = np.flatnonzero((self.words[at >> 6] >> (at & 63).astype(U64)) & U64(1))
            left, base, size, first, step = left[hit], base[hit], size[hit], first[hit] + step[hit], step[hit]
        return left

    def level(self, hashes: np.ndarray, order: int) -> np.ndarray:
        return self.probe((hashes >> U64(64 - self.bits)).astype(np.int64), hashes if order == 1 else fraction(hashes, self.bits), order)

    def probe(self, segment: np.ndarray, item: np.ndarray, order: int) -> np.ndarray:
        """Probes of each n-gram, level by level, until one misses. ``item``: its hash, or a pair's fraction."""
        out = np.zeros(len(item), np.int64)
        if not len(self.words):
            return out
        left = np.arange(len(item))
        for level in range(1, LEVELS):
            left = left[self._hit(segment[left], entry_key(item[left], order, level))]
            if not len(left):
                break
            out[left] = level
        return out


def entry_key(item: np.ndarray, order: int, level: int | np.ndarray) -> np.ndarray:
    return mix64(item ^ U64(0xD6E8FEB86659FD93 if order == 1 else 0xADD0CB2CB32F7B26)) + np.atleast_1d(level).astype(U64) * U64(0xA0761D6478BD642F)


def _segment_bits(words: np.ndarray, word_counts: np.ndarray, pairs_: np.ndarray, pair_counts: np.ndarray, filter_bits: int = BITS) -> np.ndarray:
    keys = []
    for order, h, n in ((1, words, word_counts), (2, pairs_, pair_counts)):
        level = np.minimum(level_of(n, 1), LEVELS - 1)
        at = np.arange(level.sum()) - np.repeat(np.cumsum(level) - level, level)
        keys.append(entry_key(np.repeat(h, level), order, at + 1))
    key = np.concatenate(keys)
    size = -(-len(key) * filter_bits // 64) * 64
    bits = np.zeros(size, bool)
    if size:
        first, step = mix64(key), mix64(key ^ U64(0x94D049BB133111EB)) | U64(1)
        for i in range(PROBES):
            bits[((first + U64(i) * step) % U64(size)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little")


class Model:
    """Probabilities of tokens by the levels of their context, pair and word. ``table``: for texts at hand."""

    def __init__(self, table: Filter | None, unknown: float, total: float):
        self.table, self.unknown, self.total = table, unknown, total
        self.share = np.zeros(LEVELS)

    def of_levels(self, context: np.ndarray, pair: np.ndarray, word: np.ndarray, left_out: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """P(w) and the pair's share of its context."""
        one = np.where(word > 0, (1 - self.unknown) * value_of(word, 1) * 2**0.25 / max(self.total, 1.0), self.unknown)
        two = value_of(pair, 1)
        if left_out:
            two = np.where(two >= 2, two - 1, 0.0)
        return one, np.minimum(1.0, two / np.maximum(value_of(context + 1, 1), 1.0)) * (context > 0)

    def levels(self, token: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Levels of the context, pair and word of each token, by ``table``."""
        before, pair = pairs(token, off)
        return self.table.level(before, 1), self.table.level(pair, 2), self.table.level(token, 1)

    def parts(self, token: np.ndarray, off: np.ndarray, left_out: bool = False):
        """P(w), the pair's share of its context, and the context's level, of each token."""
        found = self.levels(token, off)
        return *self.of_levels(*found, left_out), found[0]

    def fit(self, texts: list[str | None]) -> None:
        """``fit_counts`` of texts at hand."""
        if texts:
            self.fit_counts(*np.unique(_code(*self.levels(*tokens(pa.array(texts, pa.large_string())))), return_counts=True))

    def fit_counts(self, code: np.ndarray, n: np.ndarray, rounds: int = 25) -> None:
        """Share of the pair model by the level of the context, each text left out of its own counts."""
        found = _levels(code)
        one, ratio = self.of_levels(*found, left_out=True)
        level, share = found[0], np.full(LEVELS, 0.1)
        total = np.bincount(level, n, LEVELS)
        for _ in range(rounds):
            a, b = share[level] * ratio, (1 - share[level]) * one
            share = (np.bincount(level, n * a / np.maximum(a + b, 1e-300), LEVELS) + 0.01) / (total + 10.0)
        self.share = share

    def log10(self, token: np.ndarray, off: np.ndarray) -> np.ndarray:
        return self.log10_of(*self.levels(token, off), off)

    def log10_of(self, context: np.ndarray, pair: np.ndarray, word: np.ndarray, off: np.ndarray) -> np.ndarray:
        if not self.total:
            return np.zeros(len(off) - 1)
        code, at = np.unique(_code(context, pair, word), return_inverse=True)
        found = _levels(code)
        (one, ratio), share = self.of_levels(*found), self.share[found[0]]
        return np.add.reduceat(np.log10(share * ratio + (1 - share) * one)[at], off[:-1])


def _code(context: np.ndarray, pair: np.ndarray, word: np.ndarray) -> np.ndarray:
    return (context * 256 + pair) * 256 + word


def _levels(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return code >> 16, (code >> 8) & 255, code & 255


def build(merged: DataFrame, bits: int, table: bool = True) -> tuple[Model, int, int]:
    """The model (without shares), tokens and types of training. ``merged``: a stored count().

    ``table``: bring the filter's bits of all segments here, for texts at hand.
    """
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_tokens", "n_types", "q", "rare")]
    total = merged.agg(*sums).first()
    unknown = max(total.rare, 0.5) / total.n_tokens if total.n_tokens else 1.0
    found = None
    if table:
        size, parts = np.zeros(1 << bits, np.int64), []
        for r in merged.select("segment", "bits").orderBy("segment").collect():
            size[r.segment] = 8 * len(r.bits)
            parts.append(bytes(r.bits))
        found = Filter(np.frombuffer(b"".join(parts), U64), np.concatenate([[0], np.cumsum(size)]), bits)
    return Model(found, min(unknown, 0.5), float(total.q)), total.n_tokens, total.n_types


def score(docs: DataFrame, is_train, id_col: str = "doc_id", text_col: str = "text", filter_bits: int = BITS) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs``.

    ``is_train``: boolean column over ``docs`` that marks the rows to learn from; ``filter_bits``: of the Bloom filter, for an entry.
    """
    spark = docs.sparkSession
    ship_code(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(is_train, F.lit(False)).alias("train"))
    n_bytes = rows.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8), F.lit(0))).first()[0]
    bits = max(LEAST_BITS, int(n_bytes // SEGMENT_BYTES).bit_length())
    merged = stored(count(rows.where("train").select("text"), bits, filter_bits), "counts")
    model, n, v = build(merged, bits, table=False)
    floor = np.log10(n + 0.5 * (v + 1))

    blocks = rows.select("doc_id", "text", "train", F.pmod(F.xxhash64("doc_id"), F.lit(int(n_bytes // BATCH_BYTES) + 1)).cast("int").alias("block"))

    def types_of(texts: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        """Distinct words and pairs."""
        words, two = [np.zeros(0, U64)], []
        for a in range(0, len(texts), 256):
            t, off = tokens(pa.array(texts.iloc[a : a + 256], pa.large_string()))
            words.append(np.unique(t))
            two.append(np.unique(pairs(t, off)[1]))
        return np.unique(np.concatenate(words)), np.unique(np.concatenate(two))

    def ask(pdf: pd.DataFrame) -> pd.DataFrame:
        words, two = types_of(pdf.text)
        which, we, pe = _ranges(words, two, bits)
        return pd.DataFrame({"segment": which, "block": pdf.block.iloc[0], "words": [_pack(words[a:b], bits) for a, b in zip(we[:-1], we[1:])], "pairs": [pack_steps(fraction(two[a:b], bits)) for a, b in zip(pe[:-1], pe[1:])]})

    def answer(asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if not len(asked):
            return pd.DataFrame({k: [] for k in ("block", "segment", "counts", "word_levels", "pair_levels")})
        segment = asked.segment.iloc[0]
        w = _unpack(segment, known.words.iloc[0] if len(known) else b"", bits)
        c = np.frombuffer(known.word_counts.iloc[0] if len(known) else b"", np.int64)
        own = np.frombuffer(known.bits.iloc[0] if len(known) else b"", U64)
        table = Filter(own, np.array([0, 64 * len(own)]), 0)
        asks = [_unpack(segment, raw, bits) for raw in asked.words], [unpack_steps([raw]) for raw in asked.pairs]
        (x, at), (y, back) = (np.unique(np.concatenate(part), return_inverse=True) for part in asks)  # of all blocks at once
        place = np.minimum(np.searchsorted(w, x), max(len(w) - 1, 0))
        found = (np.where(w[place] == x, c[place], 0) if len(w) else np.zeros(len(x), np.int64))[at]
        one, two = table.probe(np.zeros(len(x), np.int64), x, 1)[at].astype(np.uint8), table.probe(np.zeros(len(y), np.int64), y, 2)[back].astype(np.uint8)
        edges, ends = (np.concatenate([[0], np.cumsum([len(p) for p in part])]) for part in asks)
        cut = lambda values, where: [values[i:j].tobytes() for i, j in zip(where[:-1], where[1:])]
        return pd.DataFrame({"block": asked.block, "segment": asked.segment, "counts": [zlib.compress(raw, 1) for raw in cut(found, edges)], "word_levels": cut(one, edges), "pair_levels": cut(two, ends)})

    def look_up(texts: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        """Exact parts of each text's row, and the levels of its words, then of its pairs, a byte each."""
        if not len(texts):
            return pd.DataFrame({k: [] for k in ("doc_id", "train", "n_tokens", "n_known", "base_score", "levels")})
        answers = answers.sort_values("segment")
        counts = np.frombuffer(b"".join(map(zlib.decompress, answers.counts)), np.int64)
        one, two = (np.frombuffer(b"".join(answers[k]), np.uint8) for k in ("word_levels", "pair_levels"))
        words, kinds = types_of(texts.text)
        frames = []
        for a in range(0, len(texts), 256):
            part = texts.iloc[a : a + 256]
            t, off = tokens(pa.array(part.text, pa.large_string()))
            at = np.searchsorted(words, t)
            c = counts[at]
            word, pair = one[at], two[np.searchsorted(kinds, pairs(t, off)[1])]
            levels = [zlib.compress(word[i:j].tobytes() + pair[i:j].tobytes(), 1) for i, j in zip(off[:-1], off[1:])]
            frames.append(pd.DataFrame({"doc_id": part.doc_id, "train": part.train, "n_tokens": np.diff(off), "n_known": np.add.reduceat((c > 0).astype(np.int64), off[:-1]), "base_score": np.add.reduceat(np.log10(c + 0.5) - floor, off[:-1]), "levels": levels}))
        return pd.concat(frames)

    def levels_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Levels of the context, pair and word of all tokens, and the texts' offsets. A text's first token has no context."""
        raws = [np.frombuffer(zlib.decompress(x.as_buffer()), np.uint8).reshape(2, -1) for x in column]
        off = np.concatenate([[0], np.cumsum([x.shape[1] for x in raws])])
        word, pair = np.concatenate(raws, axis=1).astype(np.int64)
        context = np.concatenate([[0], word[:-1]])
        context[off[:-1]] = 0
        return context, pair, word, off

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                code, k = np.unique(_code(*levels_of(batch.column(0).slice(at, 256))[:3]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(k)], ["code", "n"])

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = levels_of(part.column(4))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(np.full(part.num_rows, n, np.int64)), part.column(3), pa.array(shared.value.log10_of(*found))], ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    asked = blocks.groupBy("block").applyInPandas(ask, "segment int, block int, words binary, pairs binary")
    answers = asked.groupBy("segment").cogroup(merged.select("segment", "words", "word_counts", "bits").groupBy("segment")).applyInPandas(answer, "block int, segment int, counts binary, word_levels binary, pair_levels binary")
    kind = dict(rows.dtypes)["doc_id"]
    looked = stored(blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(look_up, f"doc_id {kind}, train boolean, n_tokens long, n_known long, base_score double, levels binary"), "levels")
    tallied = looked.where("train").select("levels").mapInArrow(tally, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()  # LEVELS ** 3 rows at most
    if tallied.num_rows:
        model.fit_counts(tallied["code"].to_numpy(), tallied["n"].to_numpy())
    shared = spark.sparkContext.broadcast(model)
    return looked.select("doc_id", "n_tokens", "n_known", "base_score", "levels").mapInArrow(rate, f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op1_lm_scoring(spark, sf_dir: str) -> DataFrame:
    from .tables import table

    held_out = lambda: F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 1, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, ~held_out()).select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
