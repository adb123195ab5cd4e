import hashlib
import re

import duckdb

from seqspark.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def tok(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items):
    wins = {}
    for i, t in items:
        w = tok(t)
        for s in range(max(len(w) - 9, 1) if w else 0):
            wins.setdefault(tuple(w[s : s + 10]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, ids = tok(t), set(), set()
        for n in {len(x) for x in wins}:
            for s in range(len(w) - n + 1):
                if (x := tuple(w[s : s + n])) in wins:
                    hit |= set(range(s, s + n))
                    ids |= wins[x]
        names = sorted(str(i) for i in ids if i is not None)
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_against_oracle_and_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    got = sorted((tuple(r) for r in D.op3_decontamination(spark, sf).collect()), key=str)
    read = lambda t: [tuple(r)[:2] for r in spark.read.parquet(f"{sf}/{t}.parquet").collect()]
    assert got == brute(read("documents"), read("benchmark")) and any(r[5] for r in got)
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    assert sorted(con.execute(D.ORACLE).fetchall(), key=str) == got


def test_edges(spark, monkeypatch):
    items = [(1, "Alpha beta gamma"), (2, ""), (3, None), (None, "lone word"), (4, " ".join(f"t{i}" for i in range(14))), (4, "alpha BETA gamma"), (5, "the " * 12), (6, "ÉTÉ été")]
    docs = [(1, None), (2, ""), (3, "x ALPHA-beta gamma, alpha beta gamma"), (3, "lone word"), (4, " ".join(f"t{i}" for i in range(3, 13))), (5, "the " * 30_000), (6, "lone wor d alpha beta"), (7, "Été ÉTÉ été")]
    a = spark.createDataFrame([(*d, 0, "x") for d in docs], "doc_id long, text string, n_words int, term string").repartition(3)
    b = spark.createDataFrame([(*i, "y") for i in items], "item_id long, text string, offset string")
    for limit in (D.BROADCAST_PHRASES, 0):
        monkeypatch.setattr(D, "BROADCAST_PHRASES", limit)
        assert sorted((tuple(r) for r in D.contamination(a, b).collect()), key=str) == brute(docs, items)
    assert D.contamination(a.limit(0), b).count() == 0
    assert {r.contaminated for r in D.contamination(a, b.limit(0)).collect()} == {False}


def test_proximity(spark, monkeypatch):
    docs = [(1, "gamma x alpha y beta"), (2, "alpha beta q q q q q q gamma"), (3, "alpha gamma"), (4, "beta gamma alpha"), (None, None), (5, "no x no go"), (6, "go x no no"), (7, "no go " * 4000)]
    items = [(1, "alpha beta gamma"), (2, "no no go"), (3, "lone"), (4, None)]
    a = spark.createDataFrame([(*d, "z") for d in docs], "doc_id long, text string, k string").repartition(2)
    b = spark.createDataFrame(items, "item_id long, text string")

    def near(text, phrase, slop):
        w, n = tok(text), len(phrase) + slop
        return any(all(w[s : s + n].count(x) >= phrase.count(x) for x in phrase) for s in range(len(w)))

    for limit in (D.BROADCAST_PHRASES, 0):
        monkeypatch.setattr(D, "BROADCAST_PHRASES", limit)
        for slop in (0, 2):
            want = sorted((d, len(tok(t)), sum(near(t, tok(x), slop) for _, x in items if tok(x))) for d, t in docs if d)
            got = sorted((tuple(r) for r in D.proximity(a, b, slop).collect() if r.doc_id), key=str)
            assert got == want and (slop == 0 or want[0][2] == 1)
    assert D.proximity(a.limit(0), b).count() == 0


def test_proximity_query_finds_what_is_exact(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r.n_near for r in D.decontamination_proximity(spark, sf).collect()}
    exact = {r.doc_id: r.n_items for r in D.op3_decontamination(spark, sf).collect()}
    assert got.keys() == exact.keys() and all(got[k] >= exact[k] for k in got)


def test_one_common_term_and_a_long_text(spark, monkeypatch):
    docs = [(i, "the " * 30 + f"w{i} the end") for i in range(60)] + [(99, "the " * 100_000)]
    items = [(1, "the the the"), (2, "the end"), (3, "the")]
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(D, "BROADCAST_PHRASES", 0)
    assert sorted((tuple(r) for r in D.contamination(a, b).collect()), key=str) == brute(docs, items)
