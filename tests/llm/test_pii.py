import hashlib
import random
import re

from seqspark.llm import pii as P

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def ok(kind, v):
    d = [int(c) for c in v if c.isdigit()]
    if kind == "ip":
        return all(int(p) <= 255 for p in v.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d[::-1])) % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def brute(t):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in RULES.items() for m in re.finditer(p, t or "") if ok(k, m[0])]


def texts():
    rng = random.Random(11)
    parts = ["a@b.c", "_x@d.e", "a.b+c@d-e.f.g.", "@", "1.2.3.4", "5.6.7", ".300.1.1.1", "4111 1111-1111 1111", " 12", "-3", "--", "  ", "+49 (30) 123-45.67 ", "+1", "é", "\U0001f600", "﷐", "x y", "0", "4539578763621486", "(", "\n", "..", "00.07.1.9", "a@b..c"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 25))) for _ in range(1500)]


def test_rules_against_brute_force(spark):
    rows = [(i, t, 0) for i, t in enumerate([*texts(), None, "", "9" * 60_000, "a" * 60_000, "1-" * 30_000, "a@" + "b." * 20_000 + "c", "dup a@b.c", "dup a@b.c"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans int").repartition(4)
    found = P.stored(P.proposals(docs), "t")
    for r in found.collect():
        got = [f"{s.kind}:{s.start}:{s.end}" for s in r.spans if s.base]
        assert got == brute(rows[r.doc_id][1]), rows[r.doc_id]


def test_query_on_given_documents(spark):
    sf = "/root/testdata/sf0.01"
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = P.op6_pii(spark, sf).collect()
    assert len(got) == len(text)
    more = 0
    for r in got:
        want = brute(text[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k) for w in want) for k in P.KINDS]
        spans = r.spans.split(",") if r.spans else []
        assert set(want) <= set(spans)
        more += len(spans) - len(want)
    assert more < 0.02 * len(got)


def test_adds_learned_spans_only(spark):
    rng = random.Random(5)
    rows = [(i, f"please call my phone +49 30 {rng.randrange(10**6, 10**7)} today") for i in range(200)]
    rows += [(200 + i, f"write to my mail ann{i}@site{i}.com now") for i in range(100)]
    rows += [(900, "my phone is (030) 123 4567, call"), (901, "mail: ann [at] site [dot] com please"), (902, "pages 12 and 30 of the text"), (903, None)]
    got = {r.doc_id: r.spans for r in P.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == 304 and not got[902] and not got[903]
    assert [s.kind for s in got[900]] == ["phone"] and [s.kind for s in got[901]] == ["email"]
    none = spark.createDataFrame([], "doc_id long, text string")
    assert P.find(none).count() == 0
