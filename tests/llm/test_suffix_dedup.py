import random

import numpy as np

from seqspark.llm import suffix_dedup as S


def brute(rows, length=50):
    least = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            if i is not None and i < least.get(w, 1 << 60):
                least[w] = i
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - length + 1):
            if least.get(b[k : k + length], 1 << 60) < (1 << 59 if i is None else i):
                gone[k : k + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])
        out.append((i, len(b), int(gone.sum()), int((gone[:-1] & ~np.concatenate([[False], gone[:-2]]) if len(b) else gone[:-1]).sum()), S.digest(kept)))
    return sorted(out, key=str)


def test_transform_is_the_sorted_order():
    rng = random.Random(1)
    strings = [bytes(rng.choice(b"ab\x00") for _ in range(rng.randrange(0, 12))) for _ in range(60)]
    off = np.concatenate([[0], np.cumsum([len(s) for s in strings])])
    suffixes = sorted(((s[k:], i, s[k - 1] + 1 if k else 0) for i, s in enumerate(strings) for k in range(len(s) + 1)), key=lambda x: x[0])
    got, common = S.transform(np.frombuffer(b"".join(strings), np.uint8), off, 5)
    share = lambda a, b: next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
    texts = [x[0] for x in suffixes]
    assert common.tolist() == [0] + [min(5, share(a, b)) for a, b in zip(texts, texts[1:])]
    by = {}
    for text, _, c in suffixes:
        by.setdefault(text, []).append(c)
    at = 0
    for text in sorted(by):
        assert sorted(got[at : at + len(by[text])].tolist()) == sorted(by[text])
        at += len(by[text])


def test_equal_windows_have_equal_keys():
    rng = random.Random(4)
    core = bytes(rng.choice(b"abcd") for _ in range(120))
    texts = [bytes(rng.choice(b"abcd") for _ in range(rng.randrange(60))) + core[rng.randrange(40) : 60 + rng.randrange(60)] + b"ab" * rng.randrange(60) for _ in range(40)]
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    data = b"".join(texts)
    start, key, run = S.minimizers(np.frombuffer(data, np.uint8), off, 50)
    seen, keys = {}, {}
    for a, k, n in zip(start.tolist(), key.tolist(), run.tolist()):
        for w in range(a, a + n):
            assert w not in seen
            seen[w] = k
            assert keys.setdefault(data[w : w + 50], k) == k
    assert sorted(seen) == [w for a, b in zip(off[:-1].tolist(), off[1:].tolist()) for w in range(a, b - 49)]


def test_query_on_given_documents(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in S.op4_suffix_dedup(spark, sf).collect()), key=str)
    assert got == brute(rows) and sum(r[2] for r in got)


def test_edges(spark, monkeypatch):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abcdeé") for _ in range(n))
    a, b = word(200), word(90)
    rows = [(5, a), (3, "x" + a[20:120] + "y"), (9, b + a + b), (9, b + "!" + b), (7, None), (8, ""), (2, "z" * 400), (1, "z" * 60), (11, "z" * 49), (12, a[:49]), (13, a[:50]), (13, a[:50]), (None, a), (4, word(30_000)), (6, "ab" * 3000), (10, "ba" * 300)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, a int, spans int").repartition(3)
    result = lambda: sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, S.digest(bytes(r.kept))) for r in S.removed(docs).collect()), key=str)
    assert result() == brute(rows)
    monkeypatch.setattr(S, "HOT", 2)
    assert result() == brute(rows)
    assert S.removed(docs.limit(0)).count() == 0
