"""Benchmark decontamination by a positional inverted index, in DataFrame operations.

One pass over the texts stores the index: a posting (document row, position, term) for every occurrence of a
term that some test phrase has, and one for each document itself. Counts of terms come from the index. A
phrase is then looked up from its rarest term: the postings of that term, moved back by its offset,
are the first places; they are intersected with the moved postings of the second rarest term, and what is left
with those of all others, by equi-joins on (row, term, position). What is left are the exact matches. For proximity
matches the postings of all words, repeated ones as often as they stand in the phrase, are looked for in any
order within the phrase's length plus a slop around the rarest.

The terms and the phrases are broadcast only when there are at most ``BROADCAST_PHRASES`` of them; beyond that they
are joined by term or phrase, and documents themselves stay out of these joins.

Defined results: null and wordless texts have no words and no hits; empty items have no phrases; items
without an id are matched but not listed; of equally rare terms the first in the phrase leads; texts of any length
are indexed whole; repeated rows give repeated rows; an empty benchmark leaves all clean; an empty table gives
no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import stored

WINDOW = 10
#: Words that may stand between a phrase's in a proximity match.
SLOP = 3
BROADCAST_PHRASES = 200_000
#: What is not in a word once A-Z are letters too.
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Leads each document's token array; no word has this character.
HEAD = "#"


def words(text: Column) -> Column:
    """Words of a text, A-Z in lower case and other letters as they are; [] for null."""
    small = lambda t: F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))
    return F.transform(F.array_remove(F.split(F.coalesce(text, F.lit("")), BREAK), ""), small)


def phrases_of(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct phrases (words, items): ``window`` consecutive words, or all words of a shorter item."""
    w = items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    return w.select("item_id", "w", F.explode(starts).alias("s")).select("item_id", F.slice("w", F.col("s"), window).alias("words")).groupBy("words").agg(F.collect_set("item_id").alias("items"))


class Index:
    """Stored postings (row_id, doc_id, n_words, position, t) of the terms of ``phrases``, and the phrases' members.

    Words have positions from 1; a posting at position 0 with t = -1 stands for each document.
    ``members``: (phrase, k, offset, t, rank), k: the phrase's length, rank 1: its rarest term in the index.
    """

    def __init__(self, docs: DataFrame, phrases: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
        phrases = stored(phrases.withColumn("phrase", F.monotonically_increasing_id()), "phrases")
        self.phrases = phrases.select("phrase", F.size("words").alias("k"), "items")
        terms = stored(phrases.select(F.explode("words").alias("term")).distinct().select("term", F.monotonically_increasing_id().alias("t")), "terms")
        self.few = max(phrases.count(), terms.count()) <= BROADCAST_PHRASES
        rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).alias("doc_id"), F.concat(F.array(F.lit(HEAD)), words(F.col(text_col))).alias("tokens"))
        if not self.few:
            rows = stored(rows, "rows")
        rows = rows.select("row_id", "doc_id", (F.size("tokens") - 1).alias("n_words"), "tokens")
        columns = ["row_id", "doc_id", "n_words", "position", "t"]
        each = rows.select("row_id", "doc_id", "n_words", F.posexplode("tokens").alias("position", "term"))
        if self.few:
            head = terms.sparkSession.range(1).select(F.lit(HEAD).alias("term"), F.lit(-1).cast("long").alias("t"))
            found = each.join(F.broadcast(terms.unionByName(head)), "term").select(columns)
        else:
            whole = rows.select("row_id", "doc_id", "n_words", F.lit(0).alias("position"), F.lit(-1).cast("long").alias("t"))
            found = each.where(F.col("position") > 0).join(terms, "term").select(columns).unionByName(whole)
        self.postings = stored(found, "postings")
        self.documents = self.postings.where("t = -1").select("row_id", "doc_id", "n_words")
        counts = self.postings.where("t >= 0").groupBy("t").agg(F.count("*").alias("n"))
        each = phrases.select("phrase", F.size("words").alias("k"), F.posexplode("words").alias("offset", "term")).join(terms, "term").join(counts, "t", "left")
        rank = F.row_number().over(Window.partitionBy("phrase").orderBy(F.coalesce("n", F.lit(0)), "offset"))
        self.members = stored(each.select("phrase", "k", "offset", "t", rank.alias("rank")), "members")

    def small(self, df: DataFrame) -> DataFrame:
        """``df``, a row or ten for each phrase, broadcast where the phrases are few."""
        return F.broadcast(df) if self.few else df

    def places(self) -> DataFrame:
        """(row_id, position, phrase, k, offset) of every posting of each phrase's rarest term."""
        rarest = self.members.where("rank = 1").drop("rank")
        return self.postings.where("t >= 0").join(self.small(rarest), "t").select("row_id", "position", "phrase", "k", "offset")

    def _narrowed(self, starts: DataFrame, ranks: str) -> DataFrame:
        """``starts`` (row_id, start, phrase, k) with a posting at its place for each term of these ranks."""
        wanted = starts.join(self.small(self.members.where(ranks).select("phrase", "offset", "t")), "phrase")
        wanted = wanted.select("row_id", "t", (F.col("start") + F.col("offset")).alias("position"), "start", "phrase", "k")
        return wanted.join(self.postings.where("t >= 0").select("row_id", "t", "position"), ["row_id", "t", "position"])

    def exact(self) -> DataFrame:
        """(row_id, start, phrase, k) of the phrases' occurrences."""
        first = stored(self.places().select("row_id", (F.col("position") - F.col("offset")).alias("start"), "phrase", "k").where("start >= 1"), "places")
        columns = ["row_id", "start", "phrase", "k"]
        second = stored(self._narrowed(first.where("k >= 2"), "rank = 2").select(columns).unionByName(first.where("k = 1")), "places")
        rest = self._narrowed(second.where("k >= 3"), "rank >= 3").groupBy(columns).agg(F.count("*").alias("n")).where("n = k - 2")
        return rest.select(columns).unionByName(second.where("k <= 2"))

    def near(self, slop: int, window: int = WINDOW) -> DataFrame:
        """(row_id, position, phrase, k) of rarest terms with all words of their phrase within k + ``slop`` words, in any order."""
        wide = window + slop
        reach = F.col("k") + slop
        bucket = lambda c: F.floor(F.col(c) / wide)
        postings = self.postings.where("t >= 0").select("row_id", "t", F.col("position").alias("at")).withColumn("b", bucket("at"))

        def around(places: DataFrame, members: DataFrame) -> DataFrame:
            spread = places.withColumn("b", F.explode(F.array(*[bucket("position") + d for d in (-1, 0, 1)])))
            return spread.join(self.small(members), "phrase").join(postings, ["row_id", "t", "b"]).where(F.abs(F.col("at") - F.col("position")) < reach)

        keys = ["row_id", "position", "phrase", "k"]
        places = stored(self.places().select(keys), "places")
        second = around(places.where("k >= 2"), self.members.where("rank = 2").select("phrase", "t")).select(keys).distinct()
        left = stored(second.unionByName(places.where("k = 1")), "places")
        needs = self.members.groupBy("phrase", "t").agg(F.count("*").alias("m"))
        found = around(left, needs.drop("m")).groupBy(keys).agg(F.collect_list(F.struct("at", "t")).alias("found"))  # 2 * wide postings at most
        found = found.join(self.small(needs.groupBy("phrase").agg(F.collect_list(F.struct("t", "m")).alias("needs"))), "phrase")
        firsts = F.sequence(F.col("position") - reach + 1, F.col("position"))
        enough = lambda s: F.forall("needs", lambda x: F.size(F.filter("found", lambda y: (y["t"] == x["t"]) & (y["at"] >= s) & (y["at"] < s + reach))) >= x["m"])
        return found.where(F.exists(firsts, enough)).select(keys)


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row of ``docs``."""
    index = Index(docs, phrases_of(items, window))
    found = index.exact().join(index.small(index.phrases.select("phrase", "items")), "phrase")
    hit = found.groupBy("row_id").agg(F.collect_set(F.struct(F.col("start").alias("s"), (F.col("start") + F.col("k")).alias("e"))).alias("hits"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    step = lambda acc, h: F.struct((acc["n"] + F.greatest(F.lit(0), h["e"] - F.greatest(h["s"], acc["e"]))).cast("long").alias("n"), F.greatest(acc["e"], h["e"]).alias("e"))
    n_hit = F.aggregate(F.array_sort("hits"), F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("e")), step)["n"]
    hit = hit.select("row_id", n_hit.alias("n_hit"), F.array_sort("items").alias("items"))
    none = F.array().cast("array<string>")
    out = index.documents.join(hit, "row_id", "left").withColumn("n_hit", F.coalesce("n_hit", F.lit(0).cast("long"))).withColumn("items", F.coalesce("items", none))
    return out.select("doc_id", F.col("n_words").cast("long").alias("n_words"), "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def proximity(docs: DataFrame, items: DataFrame, slop: int = SLOP, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words and n_near (items with a phrase near together) of every row of ``docs``."""
    index = Index(docs, phrases_of(items, window))
    found = index.near(slop, window).select("row_id", "phrase").distinct().join(index.small(index.phrases.select("phrase", "items")), "phrase")
    near = found.groupBy("row_id").agg(F.size(F.array_distinct(F.flatten(F.collect_set("items")))).cast("long").alias("n_near"))
    return index.documents.join(near, "row_id", "left").select("doc_id", F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"))


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    from .tables import table

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def decontamination_proximity(spark, sf_dir: str) -> DataFrame:
    from .tables import table

    return proximity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
iw AS (SELECT item_id, least(len(w), 10) AS n, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: w[i:i + least(len(w), 10) - 1])) AS win FROM b WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM iw),
pos AS (SELECT doc_id, w, n, unnest(range(1, greatest(len(w) - n + 2, 1))) AS i FROM d, lens),
hits AS (SELECT DISTINCT p.doc_id, p.i, p.n, iw.item_id FROM (SELECT doc_id, i, n, w[i:i + n - 1] AS win FROM pos) p JOIN iw ON p.n = iw.n AND p.win = iw.win),
covered AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS ids FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""
