import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from seqspark.llm import bloom_lm as B

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tok(t):
    return [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]


def brute(rows, train):
    c = Counter(w for (i, t), ok in zip(rows, train) if ok for w in tok(t))
    n, v = sum(c.values()), len(c)
    return [(i, len(tok(t)), sum(c[w] > 0 for w in tok(t)), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tok(t))) for i, t in rows]


def test_query_on_given_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = {w[0]: w for w in brute(rows, [zlib.crc32(str(i).encode()) % 5 != 1 for i, _ in rows])}
    got = B.op1_lm_scoring(spark, sf).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.doc_id, r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:4]
        assert abs(r.base_score - want[r.doc_id][4]) < 1e-6 * abs(want[r.doc_id][4])
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1) and r.score <= 0
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "The the é"), (3, "The the é"), (4, "x " * 60_000), (None, "new words"), (5, "the x the x")]
    docs = spark.createDataFrame([(*r, 1, True) for r in rows], "doc_id long, text string, block int, train boolean").repartition(3)
    got = B.score(docs, F.col("doc_id") < 5).collect()
    want = brute(rows, [i is not None and i < 5 for i, _ in rows])
    key = lambda r: str(r[:4])
    assert [tuple(r)[:4] for r in sorted(got, key=key)] == [w[:4] for w in sorted(want, key=key)]
    assert all(abs(r.base_score - w[4]) < 1e-6 * max(1, abs(w[4])) for r, w in zip(sorted(got, key=key), sorted(want, key=key)))
    none = B.score(docs, F.lit(False)).collect()
    assert {(r.base_score, r.score, r.train_tokens) for r in none} == {(0.0, 0.0, 0)}
    assert B.score(docs.limit(0), F.lit(True)).count() == 0


def test_probabilities_sum_to_at_most_one(spark):
    rng = np.random.default_rng(7)
    texts = [" ".join(f"w{min(int(x), 80)}" for x in rng.zipf(1.5, 60)) for _ in range(80)]
    merged = B.stored(B.count(spark.createDataFrame([(t,) for t in texts], "text string"), 4), "t")
    model, n, v = B.build(merged, 4)
    model.fit(texts)
    exact = Counter(w for t in texts for w in tok(t))
    assert (n, v) == (sum(exact.values()), len(exact))
    vocabulary = sorted({w for w in exact if w})
    for first in vocabulary[:10]:
        t, off = B.tokens(pa.array([f"{first} {w}" for w in vocabulary]))
        second = B.tokens(pa.array([f"{first} zzz"]))
        one, ratio, level = model.parts(t, off)
        share = model.share[level]
        p = (share * ratio + (1 - share) * one)[1::3].sum() + (share * ratio + (1 - share) * one)[2]
        assert p < 1.05 and math.isfinite(model.log10(*second)[0])
    levels = model.table.level(np.array([B.tokens(pa.array([w]))[0][0] for w in vocabulary]), 1)
    want = B.level_of(np.array([exact[w] for w in vocabulary]), 1)
    assert (levels >= want).all() and (levels == want).mean() > 0.95


def test_pairs_seen_once_have_a_level_and_all_texts_set_the_shares(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{min(int(x), 500)}" for x in rng.zipf(1.4, 12)) for _ in range(3000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    merged = B.stored(B.count(docs.select("text"), B.LEAST_BITS), "t")  # score()'s layout of so small a table: equal false hits
    model, _, _ = B.build(merged, B.LEAST_BITS)
    t, off = B.tokens(pa.array(texts))
    kinds, n = np.unique(B.pairs(t, off)[1], return_counts=True)
    levels = model.table.level(kinds, 2)
    assert (n == 1).any() and (levels >= B.level_of(n, 1)).all() and (levels == B.level_of(n, 1)).mean() > 0.95
    model.fit(texts)
    want = model.log10(t, off)
    got = {r.doc_id: r.score for r in B.score(docs, F.lit(True)).collect()}
    assert all(abs(got[i] - w) < 1e-6 * max(1, abs(w)) for i, w in enumerate(want))


def test_score_against_a_model_of_exact_counts(spark):
    rng = np.random.default_rng(11)
    texts = [" ".join(f"w{min(int(x), 300)}" for x in rng.zipf(1.5, int(rng.integers(0, 20)))) for _ in range(400)] + [None, "w1 never seen"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    train = [i % 5 != 1 for i in range(len(texts))]
    one, two = Counter(), Counter()
    for text, ok in zip(texts, train):
        if ok:
            one.update(tok(text))
            two.update(zip(["<s>", *tok(text)], tok(text)))
    level = lambda n: 1 + math.floor(2 * math.log2(n) + 1e-9) if n else 0
    value = lambda k: 2 ** ((k - 1) / 2) if k else 0.0
    unknown = min(max(sum(n == 1 for n in one.values()), 0.5) / sum(one.values()), 0.5)
    total = sum(value(level(n)) * 2**0.25 for n in one.values())

    def parts(a, b, left_out=False):
        w, c, pair = level(one[b]), level(one.get(a, 0)), value(level(two[a, b]))
        p = (1 - unknown) * value(w) * 2**0.25 / total if w else unknown
        pair = (pair - 1 if pair >= 2 else 0.0) if left_out else pair
        return c, p, min(1.0, pair / value(c + 1)) if c else 0.0

    events = Counter(parts(a, b, True) for text, ok in zip(texts, train) if ok for a, b in zip(["<s>", *tok(text)], tok(text)))
    share = dict.fromkeys({c for c, _, _ in events}, 0.1)
    for _ in range(25):
        got = dict.fromkeys(share, 0.0)
        for (c, p, r), n in events.items():
            got[c] += n * share[c] * r / max(share[c] * r + (1 - share[c]) * p, 1e-300)
        share = {c: (got[c] + 0.01) / (sum(n for (k, _, _), n in events.items() if k == c) + 10.0) for c in share}

    def score(text):
        found = [parts(a, b) for a, b in zip(["<s>", *tok(text)], tok(text))]
        return sum(math.log10(share.get(c, 0.0) * r + (1 - share.get(c, 0.0)) * p) for c, p, r in found)

    for r in B.score(docs, F.expr("doc_id % 5 <> 1"), filter_bits=400).collect():  # hardly any false hits
        assert abs(r.score - score(texts[r.doc_id])) < 1e-6 * max(1, abs(r.score)), r.doc_id
