import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from seqspark.llm import langid as L


def test_counts_stay_inside_documents():
    texts = ["abc", None, "ab", "", "c"]
    whole = L.counts(*L.utf8(pa.array(texts, pa.string())))
    alone = [L.counts(*L.utf8(pa.array([t], pa.string())))[0] for t in texts]
    assert (whole == np.stack(alone)).all() and whole.sum() == 6 + 3 + 1


def test_held_out_accuracy_on_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = L.op5_language_id(spark, "/root/testdata/sf0.01").toPandas()
    assert list(got.columns) == ["doc_id", "held_out", "lang_pred", "score", "rejected"]
    want = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert all(h == (zlib.crc32(str(d).encode()) % 4 == 2) for d, h in zip(got.doc_id, got.held_out))
    held = got[got.held_out]
    right = np.mean([want[r.doc_id] == r.lang_pred for r in held.itertuples()])
    assert right > 0.97, right
    assert got.score.between(0, 1).all() and got.rejected.mean() < 0.03


def test_edges(spark):
    en, de = "the cat and the dog with that of ", "der und die von mit einer schon "
    rows = [(i, (en if i % 2 else de) * (1 + i % 5), "en" if i % 2 else "de", True) for i in range(60)]
    rows += [(100, None, "en", True), (101, "", None, True), (102, "123 !!", "de", True), (103, en * 5000, None, True), (103, en, None, True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, rejected boolean")
    got = L.identify(docs, L.fit(docs)).toPandas()
    assert len(got) == len(rows) and list(got.columns) == ["doc_id", "text", "lang", "lang_pred", "score", "rejected"]
    by = dict(zip(got.doc_id, got.lang_pred))
    assert [by[i] for i in (100, 101, 102, 103, 0, 1)] == ["und", "und", "und", "en", "de", "en"]
    none = docs.where("lang = 'xx'")
    assert L.fit(none) is None
    assert {r.lang_pred for r in L.identify(docs, None).collect()} == {"und"}
    assert L.identify(none, L.fit(docs)).count() == 0
