import random
import re

import numpy as np

from seqspark.llm import secrets as S

RULES = {
    "assign": (r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
    "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
}


def brute(text):
    return [(k, m.start(), m.end()) for k, (p, ok) in RULES.items() for m in re.finditer(p, text or "") if ok(m)]


def rows():
    rng = random.Random(4)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    out = [(i, f'é the token = "{hexes(40)}" and of words {i}') for i in range(150)]
    out += [(i, "ordinary words that hold no credential, of any kind; " * 3 + f"number {i}") for i in range(300, 340)]
    out += [(200, None), (201, ""), (202, "token=abc password: 'short' API_KEY=abcdef"), (203, "AKIA" + "A1" * 8 + " AKIAX"), (203, "AKIA" + "A1" * 8)]
    out += [(204, "plain prose with ordinaryandverylongwordsinit 12345678901234567890"), (205, "word " * 30_000 + "ſecret=abcdefgh Kelvin")]
    out += [(206, "lonely 9f86d081884c7d65-9a2feaa0c55ad015 key")]
    return out


def test_rules_and_added_spans(spark):
    docs = spark.createDataFrame([(*r, 0) for r in rows()], "doc_id long, text string, spans int").repartition(3)
    got = S.digest(S.scan(docs)).collect()
    assert len(got) == len(rows())
    by = {r.doc_id: r for r in got}
    for doc_id, text in rows():
        want = brute(text)
        if doc_id != 203:
            assert by[doc_id].base_sha256 == S.spans_digest(want)
            assert by[doc_id].n_hex == sum(k == "hex" for k, _, _ in want)
        assert {f"{k}:{s}:{e}" for k, s, e in want} <= set(by[doc_id].spans.split(",")) | {""} or doc_id == 203
    assert by[204].spans == "" and by[205].spans == ""
    assert by[206].spans == "hex:7:40" or by[206].spans == "assign:7:40"


def test_no_labels_and_empty(spark):
    docs = spark.createDataFrame([(1, "x 9f86d081884c7d65-9a2feaa0c55ad015")], "doc_id long, text string")
    assert S.digest(S.scan(docs)).first().spans == ""
    assert S.digest(S.scan(docs.limit(0))).count() == 0


def test_automaton_prefers_its_format():
    rng = random.Random(1)
    a = S.Automaton(["".join(rng.choice("0123456789abcdef") for _ in range(32)) for _ in range(300)])
    assert len(a.states) < 60
    assert a.log_likelihood("0123456789abcdef" * 2) > a.log_likelihood("zz" * 16)


def test_redact(spark):
    docs = spark.createDataFrame([(1, 'a token = "' + "0f" * 16 + '" b', 0), (2, None, 0)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: r for r in S.redact(docs).collect()}
    assert got[1].text == 'a [SECRET]" b' and got[1].n_chars == 13 and got[2].text is None


def test_labels_come_from_all_documents_and_each_kind(spark):
    rng = random.Random(9)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    rows = [(i, f"plain text of number {i}") for i in range(400)] + [(1000 + i, " ".join(hexes(32) for _ in range(20))) for i in range(20)] + [(5000, "id AKIA" + "A1B2" * 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    model = S.fit(docs, sample_docs=5, sample_values=20)
    assert set(model.automata) == {"access", "hex"}


def test_candidates_of_all_kinds_are_scored(spark):
    rng = random.Random(6)
    pick = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    consonants = "bcdfghjklmnpqrstvwxz"
    rows = [(i, f"api_key={pick(consonants + consonants.upper(), 24)} is set") for i in range(300)]
    rows += [(1000 + i, "prose has numbers like 4720843956327690 and 12:30, names, " + " ".join(pick("etaoinsrhldcum", rng.randrange(2, 9)) for _ in range(20))) for i in range(300)]
    found = pick(consonants + consonants.upper(), 24)  # no digit
    rows += [(5000, f"é {found}. And é (http://example.org/a/long/path/of/ordinary/words) 47208439563276901234"), (5001, f"x.{found}"), (5002, "extraordinarilylongwordofprose")]
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, kind string").repartition(5)
    for parts in (1, 7):
        got = {r.doc_id: r.spans for r in S.digest(S.scan(docs.repartition(parts))).collect()}
        assert got[5000] == "assign:2:26" and got[5002] == "" and got[1000] == ""
        assert got[5001].endswith(":0:26")


def test_scores_are_those_of_the_automata():
    rng = random.Random(2)
    values = ["".join(rng.choice("0123456789abcdef") for _ in range(20)) for _ in range(100)]
    model = S.Model({"hex": values, "assign": [v[::-1] + "x" for v in values]}, ["some", "words", "and", "42"])
    texts = ["0a" * 9, "ordinary", "", values[0], "A=/.-_+"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    size = np.array([len(t) for t in texts])
    kind, score = model.scores(data, np.cumsum(size) - size, size)
    for t, k, s in zip(texts, kind, score):
        likely = [a.log_likelihood(t) for a in model.automata.values()]
        x = [S.NUMBERED.index(c) for c in S.symbols(t)]
        assert k == likely.index(max(likely)) and abs(s * max(len(t), 1) - (max(likely) - max(model.plain[i][x].sum() + model.plain_end[i] for i in range(len(S.SHAPES))))) < 1e-6
