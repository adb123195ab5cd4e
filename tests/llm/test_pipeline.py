import re
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline as C
from seqspark.llm.tables import CLEANUP, stored
from test_decontaminate import brute as contaminated
from test_minhash import brute as near
from test_secrets import brute as secret_spans


def test_each_stage_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    first = spark.read.parquet(f"{sf}/documents.parquet")
    extra = [(100_000, None, "en", "s", 0), (100_001, "12 34 !!", "en", "s", 8), (None, "that the of and is with for this was", "en", "s", 3)]
    docs = stored(first.union(spark.createDataFrame(extra, first.schema)), "in")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    names = [n for n, _ in C.STAGES]
    assert len(names) == 5
    kept = {}
    for name, stage in C.STAGES:
        before = docs.collect()
        docs = stored(stage(spark, docs, sf), name)
        after = docs.collect()
        kept[name] = len(after)
        if name == "language_id":
            assert {r.doc_id for r in before} - {r.doc_id for r in after} >= {100_000, 100_001}
            assert len(after) >= 0.97 * (len(before) - 2)
        if name == "near_dedup":
            groups = near([(r.doc_id, r.text) for r in before if r.doc_id is not None], 5, 80)
            assert sorted(r.doc_id for r in after if r.doc_id is not None) == sorted(i for i, (_, c) in groups.items() if i == c)
        if name == "decontamination":
            bad = {r[0] for r in contaminated([(r.doc_id, r.text) for r in before], items) if r[5]}
            assert bad and {r.doc_id for r in before} - {r.doc_id for r in after} == bad
        if name == "secret_scan":
            old = {r.doc_id: r.text for r in before}
            for r in after:
                if not secret_spans(old[r.doc_id]):
                    assert r.text == old[r.doc_id]
                assert not secret_spans(r.text) and r.n_chars == len(r.text) or not secret_spans(old[r.doc_id])
                assert re.sub(r"\[SECRET\]", "", r.text) != "" or not r.text
        if name != "packing":
            assert docs.columns == first.columns
    assert {r.doc_id for r in before} == {r.doc_id for r in after}


def test_empty_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in C.STAGES:
        docs = stored(stage(spark, docs, sf), "empty")
        assert docs.count() == 0


def test_rows_are_judged_by_row_not_by_id(spark):
    sf = "/root/testdata/sf0.001"
    shape = "doc_id long, text string, n_chars long"
    passage = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").first().text
    texts = [" ".join(f"{k}w{i}" for i in range(60)) for k in "abc"]
    near_b = texts[1] + " tail"
    rows = [(1, texts[0]), (None, texts[0]), (None, texts[1]), (None, near_b), (7, texts[2]), (7, texts[0] + " tail"), (8, None), (8, None), (None, "")]
    docs = stored(spark.createDataFrame([(*r, 0) for r in rows], shape).repartition(3), "in")
    got = [(r.doc_id, r.text) for r in C.near_dedup(spark, docs, sf).collect()]
    assert sum(r in got for r in [(None, texts[1]), (None, near_b)]) == 1
    assert {*got} - {(None, texts[1]), (None, near_b)} == {(1, texts[0]), (7, texts[2]), (8, None), (None, "")}
    assert len(got) == 5
    rows = [(None, "x " + passage), (None, "clean words"), (5, passage + " y"), (5, "other clean words")]
    docs = stored(spark.createDataFrame([(*r, 0) for r in rows], shape), "in")
    got = {(r.doc_id, r.text) for r in C.decontaminated(spark, docs, sf).collect()}
    assert got == {(None, "clean words"), (5, "other clean words")}


def test_columns_of_any_name_and_type_pass(spark):
    sf = "/root/testdata/sf0.001"
    texts = ["the that of and is with for this was and the dog " * 4, "der die das und ist nicht mit für ein der Hund " * 4, None, "", ""]
    shape = "doc_id long, text string, lang string, score double, rejected boolean, _letters string, _row_key string, c0 map<string,int>, term string, n_chars long"
    rows = [(i, t, "en", 0.5, True, "x", "k", {"a": i % 4}, "t", 1) for i, t in enumerate(texts)] + [(4, "", "en", 0.5, True, "x", "k", {"a": 0}, "t", 1)]
    docs = stored(spark.createDataFrame(rows, shape).repartition(2), "in")
    left = {"language_id": [0, 1], "near_dedup": [0, 1, 2, 3, 4], "decontamination": [0, 1, 2, 3, 4, 4], "secret_scan": [0, 1, 2, 3, 4, 4]}
    for name, stage in C.STAGES[:-1]:
        got = stored(stage(spark, docs, sf), name)
        assert got.schema.simpleString() == docs.schema.simpleString()
        assert sorted(r.doc_id for r in got.collect()) == left[name], name
        assert {(r.score, r.rejected, r._letters, r._row_key, r.c0["a"] == r.doc_id % 4) for r in got.collect()} == {(0.5, True, "x", "k", True)}
    assert {r.doc_id for r in C.packed(spark, docs, sf).collect()} == {0, 1, 2, 3, 4}


def test_rows_go_to_workers_in_bounded_batches(spark):
    """By rows alone, a partition of texts was one batch (40 MB here)."""
    import pyarrow as pa

    docs = spark.range(0, 2000, 1, 1).selectExpr("id AS doc_id", "repeat(concat('the word ', id, ' '), 1500) AS text", "'en' AS lang")
    spark.conf.unset(C.BATCH_CONF)
    try:
        C.without_secrets(spark, docs, "")
        sizes = docs.select("text").mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes], "rows": [b.num_rows]}) for b in batches), "n long, rows long").collect()
        assert sum(r.rows for r in sizes) == 2000
        assert max(r.n for r in sizes) <= 2 * C.BATCH_BYTES
        spark.conf.set(C.BATCH_CONF, 1 << 20)
        C.without_secrets(spark, docs, "")
        assert spark.conf.get(C.BATCH_CONF) == str(1 << 20)  # a setting of the session's own stays
    finally:
        spark.conf.unset(C.BATCH_CONF)


def test_shuffle_files_of_a_stored_table_go_at_once(spark):
    """They stayed until the driver collected its garbage, and the next join's files came on top."""
    known = lambda: {k for k in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().keySet())}
    before = known()
    out = stored(spark.range(1000).selectExpr("id % 10 AS k").groupBy("k").count(), "shuffled")
    assert not known() - before
    assert out.count() == 10 and spark.conf.get(CLEANUP, None) is None
