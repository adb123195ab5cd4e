import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from seqspark.llm.graph import components
from seqspark.llm.minhash import _cells, near_duplicates, op9_minhash_near_dedup, shingle_sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, size=3, percent=85):
    sets = {}
    for i, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    least = {i: i for i in sets}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    by = {}
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    for i in sets:
        seen = {}
        for x in sets[i]:
            for j in by[x]:
                if j < i:
                    seen[j] = seen.get(j, 0) + 1
        for j, both in seen.items():
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                least[b] = a
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_given_documents_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    got = op9_minhash_near_dedup(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(want)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_chains_edges_and_ties(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(9999)}" for _ in range(120)]
    rows, words = [], list(base)
    for i in range(40):  # neighbours alike, far ends not
        rows.append((100 - i, " ".join(words)))
        words[(3 * i) % 120] = f"x{i}"
    rows += [(200, None), (201, ""), (202, " \t\n"), (203, "One two"), (204, "one TWO"), (205, "two one"), (206, " ".join(base) + " tail"), (207, "z " * 50_000), (208, "z z z z")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, component int, node int").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs, 3, 0.85).collect()}
    assert got == brute(rows)
    assert near_duplicates(docs.limit(0)).count() == 0


def test_rows_of_a_large_family_do_not_grow_with_its_square(spark):
    for outside in (1, 100):
        rows = [(7, i, 7 if i >= outside else 9_000 + i, b"s" * 640, b"h" * 1600) for i in range(8192)]
        members = spark.createDataFrame(rows, "family long, node long, component long, sig binary, hashes binary")
        dealt, keys = _cells(members, members.selectExpr("family", "component", "octet_length(hashes) + 640 AS bytes"))
        assert dealt.count() <= 8192 + 17 * outside
        meets = dealt.where("asks").select(*keys, F.col("node").alias("x")).join(dealt.where("NOT asks").select(*keys, "node"), keys)
        assert meets.select("x", "node").distinct().count() == 8192 * outside


def test_hot_buckets_stay_connected(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(300):  # one family of near copies, and a second that shares most bands with none
        own = list(words)
        own[rng.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(own)))
        rows.append((1000 + i, " ".join(f"v{k}" if k != i % 100 else f"y{i}" for k in range(100))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs, 3, 0.85).collect()}
    assert got == brute(rows)


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 50), (60, 70), (70, 60)], "u long, v long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(31)}, 60: 60, 70: 60}


def test_few_words_alone_in_a_chunk():
    for n in range(7):
        texts = pa.array([" ".join(f"w{k}" for k in range(n))])
        for size in (3, 5):
            assert [len(h) for _, _, h, _ in shingle_sets(texts, size)] == [min(n, 1) if n < size else n - size + 1]
