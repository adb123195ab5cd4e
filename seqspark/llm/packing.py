"""Packing of token sequences by reciprocal-capacity (harmonic) classes.

A piece of ``s`` ids belongs to class ``j = capacity // s``: a bin holds exactly ``j`` pieces of the
class, so that each worker fills the bins of each class on its own, by counting. Documents may be
cut, so a piece that would leave more than ``waste`` of its class's bins empty is cut to the largest
exact reciprocal ``capacity // j`` below it and its rest is classed again. Bins that are not full when
a worker ends are poured, in order, into whole sequences; what remains below one sequence is laid
out in sequences of power-of-two lengths, which need no padding.

Defined results: a null or empty text is the end id alone; a text of any length is cut into whole
sequences and a rest; pieces of equal length are packed in the order they come; repeated rows are packed
once each, rows without an id too; an empty table gives no rows; columns other than the id and the text
are ignored, whatever their names.
"""

from __future__ import annotations

import ctypes
import gc
import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import ship_code
from .textops import chunks, utf8

CAPACITY = 4096
END_ID = 2
#: Distinct words whose ids a task remembers; it starts afresh beyond that (speed only).
CACHE_WORDS = 1_000_000
#: Text encoded at a time; a longer text stands alone.
CHUNK_BYTES = 2 << 20

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


#: Normalisation and splitting (as in the tokenizer's file) under which words between spaces have ids of
#: their own, whatever stands around them. Texts are encoded whole by any other tokenizer.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
#: Letters of Latin-1 and marks after them: two of SPLIT's parts, with the same letters after NORMALIZERS.
LETTERS_MARKS = re.compile(r"([A-Za-zªµºÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]+)")


#: What NORMALIZERS leave as it is and SPLIT as one part.
BARE = re.compile(r"[a-zß-öø-ÿ]+")


def _plain(text: str) -> bool:
    """Latin-1 text without special tokens: lower case before or after normalisation is the same."""
    if "<|" in text:
        return False
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class WordTokenizer:
    """Ids of texts. Words between spaces, and letters and marks in them, are encoded once where the rules allow it.

    ``ids`` holds the ids of all parts met so far one after another, ``edge`` where each part ends.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        rules = json.loads(self.tokenizer.to_str())
        parts = ((rules.get(k) or {}).get(x) or [] for k, x in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers")))
        normal, split = parts
        self.by_word = normal == NORMALIZERS and SPLIT in split[:1] and len(split) == 2 and split[1].get("use_regex") is False
        if self.by_word:
            self.bare = Tokenizer.from_str(json.dumps(rules | {"normalizer": None, "pre_tokenizer": split[1]}))
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.edge = np.zeros(0, "<u4"), np.zeros(1, np.int64)

    def _add(self, words: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words))))
        self.ids = np.concatenate([self.ids, ids])
        self.edge = np.concatenate([self.edge, self.edge[-1] + np.cumsum(size)])

    def _learn(self, new: list[str]) -> None:
        """Adds words, by the ids of their letters and marks."""
        split = [m.groups() if (m := LETTERS_MARKS.fullmatch(word)) else (word, "") for word in new]
        fresh = {x for pair in split for x in pair}.difference(self.known)
        bare = [x for x in fresh if BARE.fullmatch(x)]
        for tokenizer, parts in ((self.bare, bare), (self.tokenizer, list(fresh.difference(bare)))):
            for at in range(0, len(parts), 20_000):
                part = parts[at : at + 20_000]
                got = [e.ids for e in tokenizer.encode_batch_fast(part, add_special_tokens=False)]
                size = np.fromiter(map(len, got), np.int64, len(got))
                self._add(part, np.fromiter(chain.from_iterable(got), "<u4", size.sum()), size)
        split = [pair for pair in split if pair[1]]
        which = np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), np.int64, 2 * len(split))
        ids, edge = _gather(self.ids, self.edge, which)
        self._add([a + b for a, b in split], ids, np.diff(edge[::2]))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (little-endian uint32), and where each text's ids begin and end among them."""
        if not self.by_word:
            got = [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
            return np.array([i for ids in got for i in ids], "<u4"), np.concatenate([[0], np.cumsum([len(ids) for ids in got], dtype=np.int64)])
        if len(self.known) > CACHE_WORDS:
            self._forget()
        low = pa.array([(t.lower() if _plain(t) else t).replace("\n", " ") for t in texts], pa.large_string())
        split = pc.split_pattern(low, " ")
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        if new := [w for w in words if w not in self.known]:
            collecting = gc.isenabled()
            gc.disable()  # many small objects at once, none of them in cycles
            self._learn(new)
            if collecting:
                gc.enable()
        which = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        ids, edge = _gather(self.ids, self.edge, which[coded.indices.to_numpy()])
        return ids, edge[split.offsets.to_numpy()]


def _gather(ids: np.ndarray, edge: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parts ``which`` of ``ids`` (part k: from edge[k] to edge[k + 1]) one after another, and their edges."""
    size = np.diff(edge)[which]
    out = np.concatenate([[0], np.cumsum(size)])
    return ids[np.repeat(edge[which] - out[:-1], size) + np.arange(out[-1])], out


def pieces(total: int, capacity: int, waste: float) -> list[int]:
    """Lengths of the pieces into which ``total`` ids are cut, in order."""
    out = [capacity] * (total // capacity)
    rest = total % capacity
    while rest:
        j = capacity // rest
        if capacity - j * rest <= waste * capacity:
            out.append(rest)
            break
        size = capacity // (j + 1)
        out.append(size)
        rest -= size
    return out


class Bins:
    """Harmonic bins of one worker. A piece is (doc_id, start, bytes of ids, doc_tokens)."""

    def __init__(self, first: int, capacity: int, waste: float):
        self.next, self.capacity, self.waste = first, capacity, waste
        self.open: dict[int, list[tuple]] = {}

    def _emit(self, members: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for doc_id, start, ids, tokens in members:
            n = len(ids) // 4
            yield doc_id, start, n, zlib.crc32(ids), tokens, self.next, offset
            offset += n
        self.next += 1

    def add(self, doc_id, ids: bytes) -> Iterator[tuple]:
        total, start = len(ids) // 4, 0
        for n in pieces(total, self.capacity, self.waste):
            j = self.capacity // n
            members = self.open.setdefault(j, [])
            members.append((doc_id, start, ids[4 * start : 4 * (start + n)], total))
            start += n
            if len(members) == j:
                yield from self._emit(self.open.pop(j))

    def close(self) -> Iterator[tuple]:
        """Pour the bins that are not full; at most one for each class."""
        rest = [p for j in sorted(self.open) for p in self.open[j]]
        total = sum(len(p[2]) // 4 for p in rest)
        sizes = [self.capacity] * (total // self.capacity)
        sizes += [1 << b for b in range(self.capacity.bit_length() - 1, -1, -1) if (total % self.capacity) >> b & 1]
        at = 0
        for size in sizes:
            members = []
            while size:
                doc_id, start, ids, tokens = rest[at]
                n = min(size, len(ids) // 4)
                members.append((doc_id, start, ids[: 4 * n], tokens))
                size -= n
                if 4 * n == len(ids):
                    at += 1
                else:
                    rest[at] = (doc_id, start + n, ids[4 * n :], tokens)
            yield from self._emit(members)
        self.open = {}


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, waste: float = 0.02, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: where it comes from, its ids' CRC-32, its sequence and its place there.

    No shuffle: bins are filled inside each input partition and sequence ids start at
    ``partition << 32``, so a lost task repeats with the same result.
    """
    ship_code(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, end = WordTokenizer(tokenizer_path), np.array([end_id], dtype="<u4").tobytes()
        context = TaskContext.get()
        bins = Bins((context.partitionId() if context else 0) << 32, capacity, waste)
        names = [x.split()[0] for x in SCHEMA.split(", ")]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for i, j in chunks(utf8(texts)[1], CHUNK_BYTES):
                rows = []
                got, edge = tokenizer.encode([t or "" for t in texts.slice(i, j - i).to_pylist()])
                for doc_id, a, b in zip(ids[i:j], edge[:-1].tolist(), edge[1:].tolist()):
                    rows += bins.add(doc_id, got[a:b].tobytes() + end)
                if rows:
                    yield out(rows)
        yield out(list(bins.close()))
        del tokenizer
        pa.default_memory_pool().release_unused()  # the worker goes on to other tasks
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


def sequences(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Used ids, pieces and padding of each sequence (none at a power of two)."""
    used = packed.groupBy("sequence_id").agg(F.sum("length").alias("used"), F.count("*").alias("n_pieces"))
    exact = F.expr("bit_count(used) = 1")
    return used.withColumn("padding", F.when(exact, 0).otherwise(F.lit(capacity) - F.col("used")).cast("long"))


def op7_harmonic_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .tables import table

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
