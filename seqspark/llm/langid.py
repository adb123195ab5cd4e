"""Language identification by the nearest of several centroids per language.

A text is the unit vector of its hashed byte 1-, 2- and 3-grams, weighted sqrt(tf) * idf. Document
frequencies cover every training row. The vectors of a bounded sample of labelled rows (about
``SAMPLE_DOCS`` rows, shared evenly among languages) are clustered by spherical k-means into
``CENTROIDS`` centroids for each language. The language of the centroid with the greatest cosine is
predicted; a text farther from all of them than texts of its length ever are in training is rejected:
cosine below ``REJECT`` times the training median of its length class.

Defined results: a null text or one without a letter is ``und`` with score 0 and rejected; ties go to
the language first in order; texts of any length are read whole; repeated rows give repeated rows; without
training rows all is ``und``; an empty table gives no rows; other columns pass by untouched, but for those
named as the results, which replace them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .tables import ship_code
from .textops import LOWER, chunks, utf8

DIMS = 1 << 12
CENTROIDS = 4
SAMPLE_DOCS = 3_000
REJECT = 0.4
UND = "und"
#: Documents made into one dense count matrix at once.
ROWS = 128
#: Languages a model may have: its centroids, 64 KB a language, are broadcast.
MAX_LANGS = 2_000

#: Letters and bytes of other scripts stand for themselves, digits for one digit, the rest for a space.
SHAPE = LOWER.copy()
SHAPE[:128] = [c if chr(c).isalpha() else 48 if chr(c).isdigit() else 32 for c in SHAPE[:128]]


def counts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(documents, DIMS) counts of hashed 1-, 2- and 3-grams; no gram crosses documents."""
    n = len(off) - 1
    out = np.zeros(n * DIMS, np.int64)
    if len(data):
        x = SHAPE[data].astype(np.uint32)
        row = np.repeat(np.arange(n, dtype=np.int64) * DIMS, np.diff(off))
        left = np.repeat(off[1:], np.diff(off)) - np.arange(len(data))  # bytes to the document's end
        gram = x.copy()
        for size in (1, 2, 3):
            if size > 1:
                gram = gram[:-1] | (x[size - 1 :] << np.uint32(8 * (size - 1)))
            keep = left[: len(gram)] >= size
            bucket = ((gram + np.uint32(size << 28)) * np.uint32(2654435761)) >> np.uint32(20)
            out += np.bincount((row[: len(gram)] + bucket)[keep], minlength=n * DIMS)
    return out.reshape(n, DIMS)


def matrices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """Count matrices of consecutive documents."""
    data, off = utf8(texts)
    for i, j in chunks(off):
        for a in range(i, j, ROWS):
            b = min(a + ROWS, j)
            yield a, b, counts(data[off[a] : off[b]], off[a : b + 1] - off[a])


def vectors(x: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.sqrt(x, dtype=np.float32) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


def length_class(x: np.ndarray) -> np.ndarray:
    return np.log2(np.maximum(x.sum(axis=1), 1)).astype(int)


def cluster(v: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from the farthest-first rows."""
    picked = [0]
    near = v @ v[0]
    while len(picked) < min(k, len(v)):
        picked.append(int(near.argmin()))
        near = np.maximum(near, v @ v[picked[-1]])
    c = v[picked]
    for _ in range(rounds):
        own = (v @ c.T).argmax(axis=1)
        c = np.stack([v[own == i].sum(axis=0) if (own == i).any() else c[i] for i in range(len(c))])
        c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c.astype(np.float32)


class Model:
    def __init__(self, idf: np.ndarray, langs: list[str], centroids: np.ndarray, floor: dict[int, float]):
        self.idf, self.langs, self.centroids, self.floor = idf, langs, centroids, floor

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Centroid index, cosine and rejection of each row of counts."""
        cosine = vectors(x, self.idf) @ self.centroids.T
        best = cosine.argmax(axis=1)
        score = np.clip(cosine[np.arange(len(best)), best], 0.0, 1.0).astype(np.float64)
        floor = np.array([self.floor.get(c, 0.0) for c in length_class(x)])
        return best, score, score < floor


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(DIMS + 1, np.int64), 0
    for batch in batches:
        for _, _, x in matrices(batch.column(0)):
            df[:DIMS] += (x > 0).sum(axis=0)
            n += len(x)
    df[DIMS] = n
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMS + 1)), pa.array(df)], ["gram", "df"])


def fit(train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS, centroids: int = CENTROIDS) -> Model | None:
    """``train``: labelled rows only. None where there are none."""
    ship_code(train.sparkSession)
    rows = train.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    df = np.zeros(DIMS + 1)
    for r in rows.select("text").mapInArrow(_document_frequencies, "gram long, df long").groupBy("gram").agg(F.sum("df").alias("df")).collect():  # DIMS + 1 rows
        df[r.gram] = r.df
    if not df[DIMS]:
        return None
    idf = np.log((1 + df[DIMS]) / (1 + df[:DIMS])).astype(np.float32) + np.float32(0.1)
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))
    n_langs = sizes.count()
    if n_langs > MAX_LANGS:
        raise ValueError(f"{n_langs} languages; the model of at most {MAX_LANGS} fits in a worker")
    per = max(8, sample_docs // max(1, n_langs))
    sizes = F.broadcast(sizes)  # MAX_LANGS rows at most
    share = F.least(F.lit(1.0), F.lit(float(per)) / F.col("n"))
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20))
    sample = rows.join(sizes, "lang").where(place <= share * (1 << 20)).withColumn("place", place)
    first = F.row_number().over(Window.partitionBy("lang").orderBy("place", "doc_id"))
    sample = sample.withColumn("rank", first).where(F.col("rank") <= 2 * per).select("lang", "doc_id", "text")  # whatever repeats

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id")
        x = np.concatenate([m for _, _, m in matrices(pa.array(pdf.text, pa.large_string()))])
        x = x[x.sum(axis=1) > 0]
        if not len(x):
            return pd.DataFrame({"lang": [], "centroids": [], "lengths": [], "cosines": []})
        v = vectors(x, idf)
        c = cluster(v, centroids)
        near = (v @ c.T).max(axis=1)
        return pd.DataFrame({"lang": [pdf.lang.iloc[0]], "centroids": [c.tobytes()], "lengths": [length_class(x)], "cosines": [near.astype(float)]})

    got = sorted(sample.groupBy("lang").applyInPandas(group, "lang string, centroids binary, lengths array<long>, cosines array<double>").collect(), key=lambda r: r.lang)
    if not got:
        return None
    langs, matrix, by_length = [], [], {}
    for r in got:
        c = np.frombuffer(r.centroids, np.float32).reshape(-1, DIMS)
        matrix.append(c)
        langs += [r.lang] * len(c)
        for length, cosine in zip(r.lengths, r.cosines):
            by_length.setdefault(length, []).append(cosine)
    floor, last = {}, 0.0
    for length in range(0, 64):
        if len(by_length.get(length, [])) >= 8:
            last = REJECT * float(np.median(by_length[length]))
        floor[length] = last
    return Model(idf, langs, np.concatenate(matrix), floor)


PREDICTED = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])


def identify(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and rejected; columns of these names are replaced, all others kept."""
    ship_code(docs.sparkSession)
    kept = [c for c in docs.columns if c not in PREDICTED.names]
    rows = docs.select(*kept).toDF(*[f"c{i}" for i in range(len(kept))])
    rows = rows.withColumn("letters", F.coalesce(F.col(f"c{kept.index(text_col)}").rlike(r"\p{L}"), F.lit(False)))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # MAX_LANGS languages at most
    at, schema = kept.index(text_col), T.StructType([*docs.select(*kept).schema.fields, *PREDICTED.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            lang, score, rejected = np.full(n, UND, object), np.zeros(n), np.ones(n, bool)
            letters = batch.column(len(kept)).to_numpy(zero_copy_only=False).astype(bool)
            model = shared.value
            if model is not None:
                names = np.array(model.langs, object)
                for a, b, x in matrices(batch.column(at)):
                    best, s, r = model.predict(x)
                    ok = letters[a:b]
                    lang[a:b][ok], score[a:b][ok], rejected[a:b][ok] = names[best][ok], s[ok], r[ok]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], schema.names)

    return rows.mapInArrow(run, schema)


def is_held_out(id_col: str = "doc_id"):
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    from .tables import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(~F.coalesce(is_held_out(), F.lit(False))))
    return identify(docs.select("doc_id", "text", F.coalesce(is_held_out(), F.lit(False)).alias("held_out")), model).drop("text")
