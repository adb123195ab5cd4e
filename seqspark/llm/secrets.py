"""Secret scan: fixed rules, widened by probabilistic automata inferred from labelled credentials.

Credentials found by the rules in all documents, of each kind the ``SAMPLE_VALUES`` distinct values of
least hash, are the labelled strings; ordinary words come from about ``SAMPLE_DOCS`` documents, chosen by hash. For each kind their prefix tree is
folded by merging states whose outgoing and ending frequencies agree within Hoeffding's bound, which
leaves a small probabilistic automaton. Every run of the credentials' alphabet in all texts, from the length of the shortest
labelled credential (or ``CANDIDATE``) up, is a candidate, whatever it is made of, and is scored: its log-likelihood for each automaton less that
for ordinary words (the likeliest of their shapes: digits, digits with marks, letters, mixed), for each character. Candidates above ``threshold``
are added to the spans of the rules, which stay as they are; the automata run over all candidates of a batch at once.

Defined results: null and empty texts have no spans; texts of any length are scanned whole; spans of different kinds
may overlap; of equally likely kinds the first of ``KINDS`` is given; repeated rows give repeated rows; without any labelled
credential nothing is added; an empty table gives no rows; other columns are ignored (``redact`` passes them on).
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import ship_code, stored
from .textops import chunks, utf8, words

KINDS = ("assign", "access", "hex")
#: Fixed patterns of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Bytes that a credential may have; full stops at its end are the sentence's.
ALPHABET = np.zeros(256, bool)
ALPHABET[[c for c in range(128) if chr(c).isalnum() or chr(c) in "+/_.=-"]] = True

#: Candidates are at least as long as the shortest labelled credential or as this.
CANDIDATE = 16
SAMPLE_DOCS = 2_000
SAMPLE_VALUES = 2_000
THRESHOLD = 0.35
#: Log-probability of a symbol that a state never met.
UNSEEN = -9.0

Span = tuple[str, int, int]
SPANS = "spans array<struct<kind:string,start:bigint,end:bigint,base:boolean>>"


def base_spans(text: str) -> list[tuple[Span, str]]:
    """(kind, start, end) and credential of each match of the rules, by start, then kind."""
    out = [(("assign", m.start(), m.end()), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(("access", m.start(), m.end()), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(("hex", m.start(), m.end()), m[0]) for m in HEX.finditer(text)]
    out.sort(key=lambda x: (x[0][1], KINDS.index(x[0][0])))
    return out


def _symbol(c: str) -> str:
    if c in "0123456789":
        return "9"
    if c in "abcdef":
        return "a"
    if "a" <= c <= "z":
        return "z"
    if "A" <= c <= "F":
        return "A"
    return "Z" if "A" <= c <= "Z" else c


#: Characters of each symbol, over which the symbol's probability is spread.
WIDTH = {"9": 10, "a": 6, "z": 20, "A": 6, "Z": 20}
SYMBOLS = {chr(i): _symbol(chr(i)) for i in range(128)}


def symbols(value: str) -> list[str]:
    return [SYMBOLS.get(c, c) for c in value]


class Automaton:
    """Probabilistic automaton from a prefix tree by merging compatible states (red-blue order)."""

    def __init__(self, values: Iterable[str], alpha: float = 0.05):
        self.count, self.end, self.next = [0], [0], [{}]
        for v in values:
            self._insert(symbols(v))
        self.alpha = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge_all()
        self._normalise()

    def _insert(self, word: list[str]) -> None:
        state = 0
        self.count[0] += 1
        for s in word:
            if s not in self.next[state]:
                self.next[state][s] = (len(self.count), 0)
                self.count.append(0)
                self.end.append(0)
                self.next.append({})
            to, n = self.next[state][s]
            self.next[state][s] = (to, n + 1)
            state = to
            self.count[state] += 1
        self.end[state] += 1

    def _differ(self, x: int, n: int, y: int, m: int) -> bool:
        return abs(x / n - y / m) > self.alpha * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self.count[a], self.count[b]
            if not n or not m:
                continue
            if self._differ(self.end[a], n, self.end[b], m):
                return False
            for s in self.next[a].keys() | self.next[b].keys():
                to_a, x = self.next[a].get(s, (None, 0))
                to_b, y = self.next[b].get(s, (None, 0))
                if self._differ(x, n, y, m):
                    return False
                if to_a is not None and to_b is not None and to_a != to_b:
                    todo.append((to_a, to_b))
        return True

    def _fold(self, red: int, blue: int) -> None:
        """Add the tree under ``blue`` to ``red``; blue states are roots of trees still."""
        todo = [(red, blue)]
        while todo:
            r, b = todo.pop()
            self.count[r] += self.count[b]
            self.end[r] += self.end[b]
            for s, (to, n) in self.next[b].items():
                if s in self.next[r]:
                    old, k = self.next[r][s]
                    self.next[r][s] = (old, k + n)
                    todo.append((old, to))
                else:
                    self.next[r][s] = (to, n)

    def _merge_all(self) -> None:
        red = [0]
        while True:
            member = set(red)
            blue = [(r, s, to) for r in red for s, (to, _) in sorted(self.next[r].items()) if to not in member]
            if not blue:
                break
            r, s, b = max(blue, key=lambda x: (self.count[x[2]], -x[2]))
            for q in red:
                if self._compatible(q, b):
                    self.next[r][s] = (q, self.next[r][s][1])
                    self._fold(q, b)
                    break
            else:
                red.append(b)
        self.states = red

    def _normalise(self) -> None:
        self.log, at = [], {q: i for i, q in enumerate(self.states)}
        for q in self.states:
            total = sum(n for _, n in self.next[q].values()) + self.end[q] + 1
            self.log.append({s: (at[to], math.log(n / total / WIDTH.get(s, 1))) for s, (to, n) in self.next[q].items()})
            self.log[-1][""] = (0, math.log((self.end[q] + 0.5) / total))
        del self.count, self.end, self.next

    def log_likelihood(self, value: str) -> float:
        """Of the value and its end; a symbol new to a state costs ``UNSEEN`` and stays there."""
        state, total = 0, 0.0
        for s in symbols(value):
            step = self.log[state].get(s)
            if step is None:
                total += UNSEEN
                continue
            state, total = step[0], total + step[1]
        return total + self.log[state][""][1]


#: Symbols by number, and the number of each byte of the alphabet.
NUMBERED = ["9", "a", "z", "A", "Z", *"+/_.=-"]
NUMBER = np.array([NUMBERED.index(SYMBOLS[chr(c)]) if ALPHABET[c] else 0 for c in range(256)])
#: Shapes of ordinary words: of digits, of digits and marks, of letters and marks, of all.
SHAPES = ({"9"}, {"9", *"+/_.=-"}, set(NUMBERED) - {"9"}, set(NUMBERED))


class Model:
    """Automata by kind, and the log-probabilities of symbols in ordinary words by the words' shape, as tables."""

    def __init__(self, values: dict[str, list[str]], ordinary: Iterable[str]):
        self.shortest = min([CANDIDATE, *(len(x) for v in values.values() for x in v)])
        self.automata = {k: Automaton(v) for k, v in values.items() if v}
        self.tables = [self._table(a) for a in self.automata.values()]
        wide = np.array([WIDTH.get(x, 1) for x in NUMBERED])
        counts, ends = np.tile(wide.astype(float), (len(SHAPES), 1)), np.ones(len(SHAPES))
        for w in ordinary:
            found = [NUMBERED.index(x) for x in symbols(w) if x in NUMBERED]
            shape = self._shape({NUMBERED[i] for i in found})
            np.add.at(counts[shape], found, 1)
            ends[shape] += 1
        allowed = np.array([[x in shape for x in NUMBERED] for shape in SHAPES])
        counts = np.where(allowed, counts, 0)
        total = counts.sum(axis=1) + ends
        with np.errstate(divide="ignore"):
            self.plain = np.log(counts / total[:, None] / wide)
        self.plain_end = np.log(ends / total) + np.log(ends / ends.sum())

    @staticmethod
    def _shape(found: set[str]) -> int:
        return next(i for i, shape in enumerate(SHAPES) if found <= shape)

    @staticmethod
    def _table(automaton: Automaton) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Next state and log-probability by state and symbol, and log-probability of an end."""
        n = len(automaton.states)
        to = np.repeat(np.arange(n, dtype=np.int32)[:, None], len(NUMBERED), axis=1)
        log = np.full(to.shape, UNSEEN)
        for q, steps in enumerate(automaton.log):
            for i, x in enumerate(NUMBERED):
                if x in steps:
                    to[q, i], log[q, i] = steps[x]
        return to, log, np.array([steps[""][1] for steps in automaton.log])

    def scores(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the likeliest kind of each span of bytes, and its log-likelihood ratio to ordinary words for each character."""
        order = np.argsort(-size, kind="stable")  # the longest first, so that those still running come first
        at, n = start[order], size[order]
        left = np.searchsorted(-n, -np.arange(n.max(initial=0)), "left")  # spans longer than 0, 1, ...
        state = np.zeros((len(self.tables), len(at)), np.int32)
        total = np.zeros((len(self.tables), len(at)))
        plain = np.zeros((len(SHAPES), len(at)))
        for k, m in enumerate(left.tolist()):
            x = NUMBER[data[at[:m] + k]]
            plain[:, :m] += self.plain[:, x]
            for i, (to, log, _) in enumerate(self.tables):
                total[i, :m] += log[state[i, :m], x]
                state[i, :m] = to[state[i, :m], x]
        for i, (_, _, end) in enumerate(self.tables):
            total[i] += end[state[i]]
        kind = total.argmax(axis=0)
        ratio = (total[kind, np.arange(len(at))] - (plain + self.plain_end[:, None]).max(axis=0)) / np.maximum(n, 1)
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return kind[back], ratio[back]


def added_spans(texts: pa.Array, base: list[list[Span]], model: Model, threshold: float) -> list[list[Span]]:
    """Spans of each text that score above the threshold and overlap none of ``base``."""
    out: list[list[Span]] = [[] for _ in range(len(texts))]
    if not model.automata:
        return out
    data, off = utf8(texts)
    kinds = list(model.automata)
    for i, j in chunks(off):
        part = data[off[i] : off[j]]
        if not len(part):
            continue
        edge = off[i : j + 1] - off[i]
        start, end, _ = words(part, edge, ~ALPHABET)
        for _ in range(3):
            end = end - ((part[end - 1] == ord(".")) & (end - start > 1))
        long = end - start >= model.shortest
        start, end = start[long], end[long]
        kind, score = model.scores(part, start, end - start)
        for k in np.flatnonzero(score >= threshold).tolist():
            doc = int(np.searchsorted(edge, start[k], "right")) - 1
            before = part[edge[doc] : start[k]]
            a = int(len(before) - np.count_nonzero((before & 0xC0) == 0x80))  # code points
            b = a + int(end[k] - start[k])
            if not any(s < b and a < e for _, s, e in base[i + doc]):
                out[i + doc].append((kinds[kind[k]], a, b))
    return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS, sample_values: int = SAMPLE_VALUES) -> Model:
    """Automata from the credentials of all documents, ``sample_values`` of each kind, and words of about ``sample_docs`` documents."""
    ship_code(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, sampled in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = base_spans(text or "")
                rows += [(kind, value) for (kind, _, _), value in found]
                if sampled and text and not found:
                    rows += [("word", w) for w in set(text.split())]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], ["kind", "value"])

    share = min(1.0, sample_docs / max(1, docs.count()))
    sampled = F.pmod(F.xxhash64(id_col, text_col), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1)
    found = stored(docs.select(text_col, sampled.alias("sampled")).mapInArrow(run, "kind string, value string").distinct(), "labels")
    words = found.where("kind = 'word'").orderBy(F.xxhash64("value"), "value").limit(sample_values).collect()
    labelled = [r for k in KINDS for r in found.where(F.col("kind") == k).orderBy(F.xxhash64("kind", "value"), "value").limit(sample_values).collect()]
    values = {k: sorted(r.value for r in labelled if r.kind == k) for k in KINDS}
    return Model(values, sorted(r.value for r in words))


def scan(docs: DataFrame, model: Model | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: its id and all its spans, with the flag ``base``."""
    ship_code(docs.sparkSession)
    model = model or fit(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                base = [[s for s, _ in base_spans(text)] if text else [] for text in part.column(1).to_pylist()]
                more = added_spans(part.column(1), base, model, threshold)
                spans = [[{"kind": k, "start": s, "end": e, "base": ours is x} for ours in (x, y) for k, s, e in ours] for x, y in zip(base, more)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(spans, kinds)], ["doc_id", "spans"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = T.StructType([rows.schema["doc_id"], *T.StructType.fromDDL(SPANS).fields])
    return rows.mapInArrow(run, schema)


def _joined(spans):
    order = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.when(s["kind"] == "assign", 0).when(s["kind"] == "access", 1).otherwise(2).alias("k"), s["kind"].alias("kind"), s["end"].alias("end")))
    return F.array_join(F.transform(F.array_sort(order), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(scanned: DataFrame) -> DataFrame:
    base = F.filter("spans", lambda s: s["base"])
    count = lambda k: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == k))).cast("long").alias(f"n_{k}")
    return scanned.select("doc_id", *map(count, KINDS), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]", model: Model | None = None) -> DataFrame:
    """``docs`` with the text of every found span replaced by ``mark`` and n_chars counted anew."""
    ship_code(docs.sparkSession)
    model = model or fit(docs)
    names, schema = docs.columns, docs.schema
    at, n_chars = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for first in range(0, batch.num_rows, 512):
                part = batch.column(at).slice(first, 512)
                given = part.to_pylist()
                base = [[s for s, _ in base_spans(text)] if text else [] for text in given]
                for text, spans in zip(given, map(list.__add__, base, added_spans(part, base, model, THRESHOLD))):
                    if text:
                        out, done = [], 0
                        for _, s, e in sorted(spans, key=lambda x: x[1:]):
                            if e > done:
                                if s >= done:
                                    out += [text[done:s], mark]
                                done = e
                        text = "".join(out) + text[done:]
                    texts.append(text)
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            if n_chars is not None:
                columns[n_chars] = pa.array([None if t is None else len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, schema)


def op8_secret_scan(spark, sf_dir: str) -> DataFrame:
    from .tables import table

    return digest(scan(table(spark, sf_dir, "documents").select("doc_id", "text")))


def spans_digest(spans: Iterable[Span]) -> str:
    """The digest of spans in plain Python, for tests."""
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0])))).encode()).hexdigest()
