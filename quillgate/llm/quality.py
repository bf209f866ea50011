"""Quality rules: a hashed n-gram log-likelihood ratio between trusted and raw texts.

Words and word pairs are hashed into ``buckets``.  Two multinomials over the buckets are
counted, one over the trusted texts, one over all texts; a text's score is the mean log
ratio of its n-grams, so it does not depend on the length.  Every text with a score of at
least ``threshold`` passes.  Rule features of each text stand beside the score.

The raw counts cover all documents; the trusted texts are a bounded sample of the labelled
rows (``most_trusted``, by hash order).  Only DataFrame operations are used.  Counting and
scoring sum partially before their shuffles, which carry a row for each bucket or document.

Defined results: a null or wordless text has zero features, fails the base rules and gets no
score (null).  Rows that repeat a ``doc_id`` are judged one by one.  Labels of one id combine
by minimum.  Without trusted texts every score is zero.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgate.llm.shared import bound, documents_of, table, written

_SPACES = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 17  #: also the bound of the broadcast weight table
    most_trusted: int = 20_000  #: bound of the trusted sample
    smoothing: float = 2.0  #: added to the counts of both sides, the raw ones scaled to the trusted size
    threshold: float = -0.15
    least_words: int = 50
    most_repeat_percent: int = 50


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), _SPACES, -1), lambda w: w != "")


def row_key() -> Column:
    return F.xxhash64(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))


def ngram_buckets(words: Column, buckets: int) -> Column:
    """One bucket for every word and one for every pair of neighbours."""

    def both(words: Column) -> Column:
        ones = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))
        twos = F.transform(words, lambda w, i: F.pmod(F.xxhash64(w, F.get(words, i + 1)), F.lit(buckets)).cast("int"))
        return F.concat(ones, F.slice(twos, 1, F.greatest(F.size(words) - 1, F.lit(0))))

    return bound(words, both)


def weights_of(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``(bucket, weight)``: log of the trusted share over the raw share, for every bucket in use."""
    trusted = (
        labels.select(F.col("doc_id").cast("bigint"), F.col("quality").cast("int"))
        .where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
        .where("quality = 1").join(documents_of(docs).select("doc_id"), "doc_id", "left_semi")  # labels of other tables take no place in the sample
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.most_trusted)
        .select("doc_id", F.lit(1).alias("trusted"))
    )
    # At most ``most_trusted`` pairs of numbers: the bound of this broadcast.
    marked = documents_of(docs).join(F.broadcast(trusted), "doc_id", "left").select("trusted", words_of(F.col("text")).alias("words"))
    grams = marked.select("trusted", F.explode(ngram_buckets(F.col("words"), settings.buckets)).alias("bucket"))
    counts = written(grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.count("trusted").alias("good")), "bucket-counts")
    total = counts.agg(F.coalesce(F.sum("raw"), F.lit(0)), F.coalesce(F.sum("good"), F.lit(0))).first()
    if not total[1]:
        return counts.select("bucket", F.lit(0.0).alias("weight"))
    scaled = F.col("raw") * F.lit(total[1] / total[0])  # a rare n-gram then says little on either side
    return counts.select("bucket", F.log((F.col("good") + settings.smoothing) / (scaled + settings.smoothing)).alias("weight"))


def scores_of(docs: DataFrame, weights: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``(row, score)``, one for each distinct row with words."""
    hashed = documents_of(docs).select(row_key().alias("row"), ngram_buckets(words_of(F.col("text")), settings.buckets).alias("buckets"))
    grams = hashed.select("row", F.explode("buckets").alias("bucket"))  # the row key is computed before, not for every n-gram
    # The weight table has at most ``buckets`` rows of 12 bytes, whatever the input.
    return grams.join(F.broadcast(weights), "bucket").groupBy("row").agg(F.avg("weight").alias("score"))


def repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more.

    Equal windows are neighbours once (hash, place) is sorted; the places of those that equal
    a neighbour, sorted again, cover ``min(3, distance to the next)`` words each.
    """

    def windows(words: Column) -> Column:
        every = F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
        return F.slice(every, 1, F.greatest(F.size(words) - 2, F.lit(0)))

    def covered(g: Column) -> Column:
        ordered = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = lambda s: F.filter(s, lambda x, k: (x["h"] == F.get(s, k + 1)["h"]) | (x["h"] == F.get(s, k - 1)["h"]))
        places = F.sort_array(F.transform(bound(ordered, twice), lambda x: x["i"]))
        widths = lambda at: F.transform(at, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - p, F.lit(3))))
        return F.aggregate(bound(places, widths), F.lit(0), lambda a, x: a + x)

    # Most texts repeat no window; a distinct count tells, and only the others are sorted.
    return bound(bound(words, windows), lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(covered(g)))


def base_features(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id, row, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed``."""
    text = F.coalesce("text", F.lit(""))
    rows = documents_of(docs).select(
        "doc_id", row_key().alias("row"), words_of(F.col("text")).alias("words"),
        F.filter(F.split(text, "\n", -1), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]"))).alias("lines"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
    )
    found = rows.select(
        "doc_id", "row", F.size("words").cast("bigint").alias("n_words"), F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        "n_symbols", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        repeated_words(F.col("words")).cast("bigint").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < settings.least_words) | (100 * F.col("n_repeat_words") > settings.most_repeat_percent * F.col("n_words"))
    return found.withColumn("base_failed", failed)


def judged(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The base features, ``score`` and ``kept``: one row for each row of ``docs``."""
    scores = scores_of(docs, weights_of(docs, labels, settings), settings)
    good = F.coalesce(F.col("score") >= settings.threshold, F.lit(False))
    return base_features(docs, settings).join(scores, "row", "left").withColumn("kept", ~F.col("base_failed") & good).drop("row")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
