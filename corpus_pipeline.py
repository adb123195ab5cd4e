"""Corpus pipeline: five stages from raw documents to packed token sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. Between stages the rows are written as Parquet and read again, so each stage starts
from what its predecessor kept.

A stage begins by removing the intermediate tables of the stage called before it, but for those that its own ``docs``
read: write a stage's rows before calling the next. It also bounds the rows that go to a Python worker at once, for the
session, unless ``spark.sql.execution.arrow.maxBytesPerBatch`` is set; a longer text is a batch of its own.

Defined results, of every stage: rows are judged one by one, whether their doc_id is null, unique or
shared; texts are taken whole, however long; an empty table gives no rows; columns besides doc_id, text
and (for the language) lang are passed on whatever their names and types, but by the last stage, which
ignores them. What a null, empty or repeated row becomes stands at the stage.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqspark.llm import decontaminate, langid, minhash, packing, secrets
from seqspark.llm.tables import recorded, remove, stored, table

#: No SQL expresses these stages; tests compare them with brute force.
ORACLE_SQL = None
#: Column of the key that decisions on rows are made by, inside a stage.
KEY = "_row_key"
#: Columns that stages read; others get plain names inside a stage.
OWN = ("doc_id", "text", "lang")
#: Bytes of an Arrow batch (results do not depend on it). A task holds a batch's vectors, its stream and the worker's copies
#: at once, outside the heap; by rows alone a whole partition of texts is one batch.
BATCH_BYTES = 4 << 20
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


_left: list[str] = []


def _stage(function):
    """Removes what the last stage left in the shared folder, and keeps the names of what this one writes there."""

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        remove(spark, _left, docs)
        if spark.conf.get(BATCH_CONF, None) is None:
            spark.conf.set(BATCH_CONF, BATCH_BYTES)  # stays: the stage's rows are computed after it has returned
        with recorded() as written:
            out = function(spark, docs, sf_dir)
        _left[:] = written
        return out

    return run_stage


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a stored key of each row: a doc_id may be null or stand in several rows.

    Other columns are called c0, c1, ..., so that no name clashes with an operator's own.
    """
    return stored(_renamed(docs).withColumn(KEY, F.monotonically_increasing_id()), "keyed")


def _renamed(docs: DataFrame) -> DataFrame:
    return docs.toDF(*[c if c in OWN else f"c{i}" for i, c in enumerate(docs.columns)])


def _by_key(keyed: DataFrame) -> DataFrame:
    """What operators see: the row's key as doc_id, and the text."""
    return keyed.select(F.col(KEY).alias("doc_id"), "text")


def _without(docs: DataFrame, keyed: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of ``keyed`` whose key is not a doc_id of ``found``, with the columns of ``docs``."""
    return keyed.join(found.select(F.col("doc_id").alias(KEY)), KEY, "left_anti").drop(KEY).toDF(*docs.columns)


@_stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters (null and empty ones among them), and those far from every language's centroids, go.

    Repeated rows are judged alike; a row without lang is judged by the centroids that the others give.
    """
    found = langid.identify(_renamed(docs), langid.fit(docs.select("doc_id", "text", "lang")))
    return found.where(~F.col("rejected")).drop("lang_pred", "score", "rejected").toDF(*docs.columns)


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the least id of each group of near duplicates stays; one without an id only where all are.

    Of repeated rows, and of rows of a group with the same id, one stays. Texts without words are near nothing.
    """
    keyed = _keyed(docs)
    found = minhash.near_duplicates(_by_key(keyed), minhash.SHINGLE_WORDS, minhash.SIMILARITY)
    groups = stored(found.join(keyed.select(F.col(KEY).alias("doc_id"), F.col("doc_id").alias("own")), "doc_id"), "groups")
    first = groups.groupBy("component_id").agg(F.min(F.struct(F.col("own").isNull(), "own", "doc_id")).getField("doc_id").alias("doc_id"))
    wordless = keyed.where(~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    wordless = wordless.select(F.col(KEY).alias("doc_id"), F.sha2(F.to_json(F.struct(*[c for c in keyed.columns if c != KEY])), 256).alias("row"))
    repeated = wordless.join(wordless.groupBy("row").agg(F.min("doc_id").alias("doc_id")), ["row", "doc_id"], "left_anti").select("doc_id")
    return _without(docs, keyed, groups.join(first, "doc_id", "left_anti").select("doc_id").union(repeated))


@_stage
def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a benchmark passage go, repeated ones each; null and empty texts have none and stay."""
    keyed = _keyed(docs)
    found = decontaminate.contamination(_by_key(keyed), table(spark, sf_dir, "benchmark"))
    return _without(docs, keyed, found.where("contaminated"))


@_stage
def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Credentials are replaced in the text by a mark; n_chars, if there, follows. No row goes, null texts stay null."""
    return secrets.redact(docs)


@_stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, by sequence; a null or empty text is its end id alone, repeated rows are packed once each."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminated),
    ("secret_scan", without_secrets),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
