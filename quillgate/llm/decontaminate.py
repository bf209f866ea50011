"""Benchmark decontamination on a distributed positional inverted index.

1. ``build_index`` stores a posting ``(term, doc, pos)`` for every training token that is a
   test term, as Parquet segments sorted by term (one for each scan task, no shuffle).
2. ``phrases_of`` cuts the test items into windows of consecutive words.
3. ``exact_matches`` takes the two rarest terms of every window, adjusts their posting lists
   by the terms' offsets and intersects them; what is left is a candidate start.
   ``proximity_matches`` does the same with a tolerance.
4. ``verified_hits`` compares the candidate's words with the whole text, so that a hash
   collision or a chance pair never counts, and marks the words of all true occurrences.

Everything is DataFrame operations.  Lists meet by (window, document, start), never by term
alone, and partial sums run before that shuffle, so a frequent term or passage spreads out.
The window table is broadcast only if Spark finds its stored size under its own threshold.

Defined results: a null or wordless text has no words and no hit; an item without words has
no window.  Rows that repeat a ``doc_id`` are judged one by one.  Repeated item ids count
once; a null item id counts as an item and is left out of the list of ids.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgate.llm.shared import ascii_lower, bound, carried, documents_of, fields, table, written

_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Settings:
    window: int = 10  #: words in a phrase
    anchors: int = 2  #: rarest terms whose posting lists are intersected


def words_of(text: Column) -> Column:
    """Runs of digits, letters and non-ASCII characters, A-Z lower-cased."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _BETWEEN, -1), lambda w: w != "")


def row_key() -> Column:
    """Stands for a document row; rows that share it by chance are told apart by their words."""
    return F.xxhash64(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))


def phrases_of(items: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``(item_id, phrase, words)``: every window, or the whole of a shorter item.

    ``phrase`` is a hash of the words: items that share a window share the phrase.
    """
    n = settings.window

    def cut(words: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1)))
        return F.transform(starts, lambda s: F.slice(words, s, F.lit(n)))

    each = items.select("item_id", F.explode(bound(words_of(F.col("text").cast("string")), cut)).alias("words")).where(F.size("words") > 0)
    return each.select("item_id", F.xxhash64("words").alias("phrase"), "words").distinct()


def build_index(docs: DataFrame, phrases: DataFrame) -> DataFrame:
    """Postings of all test terms over the whole texts."""
    terms = written(phrases.select(F.explode("words").alias("w")).select(F.xxhash64("w").alias("term")).distinct(), "terms")
    split = documents_of(docs).select(row_key().alias("doc"), words_of(F.col("text")).alias("all"))
    tokens = split.select("doc", F.posexplode("all").alias("pos", "w"))  # the row key is computed before, not for every token
    return written(tokens.select(F.xxhash64("w").alias("term"), "doc", "pos").join(terms, "term"), "postings", sort=["term"])


def anchors_of(phrases: DataFrame, index: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``(phrase, term, offset, n_anchors)``: the rarest terms of each phrase.

    A phrase with a term that no document has cannot occur and gets no anchor.
    """
    counts = index.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    each = (
        phrases.select("phrase", "words").dropDuplicates(["phrase"])
        .select("phrase", F.size("words").alias("length"), F.posexplode("words").alias("offset", "w"))
        .select("phrase", "length", "offset", F.xxhash64("w").alias("term"))
        .join(counts, "term")
    )
    of = W.partitionBy("phrase")  # a phrase has ``window`` rows
    ranked = each.withColumn("known", F.count(F.lit(1)).over(of)).withColumn("rank", F.row_number().over(of.orderBy("n", "offset")))
    return ranked.where((F.col("known") == F.col("length")) & (F.col("rank") <= settings.anchors)).select(
        "phrase", "term", "offset", F.least("length", F.lit(settings.anchors)).alias("n_anchors")
    )


def exact_matches(index: DataFrame, anchors: DataFrame) -> DataFrame:
    """``(doc, start, phrase)`` where all anchors of a phrase stand at their offsets."""
    lists = index.join(anchors, "term").select("phrase", "doc", "offset", (F.col("pos") - F.col("offset")).alias("start"), "n_anchors")
    # Equal rows share their ``doc`` and give equal postings: offsets are counted, not postings.
    met = lists.where("start >= 0").groupBy("phrase", "doc", "start").agg(F.count_distinct("offset").alias("n"), F.first("n_anchors").alias("n_anchors"))
    return met.where("n = n_anchors").select("doc", "start", "phrase")


def proximity_matches(index: DataFrame, anchors: DataFrame, slack: int) -> DataFrame:
    """``(doc, phrase, start)`` where the anchors stand at most ``slack`` words off their offsets.

    Starts fall into cells of ``slack + 1`` words; every posting enters its own cell and the
    one before, so two starts within the tolerance share a cell.  ``start`` is the least.
    """
    width = slack + 1
    lists = index.join(anchors, "term").select("phrase", "doc", "offset", (F.col("pos") - F.col("offset")).alias("start"), "n_anchors")
    cell = F.floor(F.col("start") / F.lit(width))
    cells = lists.withColumn("cell", F.explode(F.array(cell, cell - 1)))
    # A cell has at most two cells' starts for each anchor.
    met = cells.groupBy("phrase", "doc", "cell").agg(F.collect_set(F.struct("start", "offset")).alias("found"), F.first("n_anchors").alias("n"))

    def complete(first):
        near = F.filter("found", lambda f: f["start"].between(first["start"], first["start"] + slack))
        return F.size(F.array_distinct(F.transform(near, lambda f: f["offset"]))) == F.col("n")

    starts = F.transform(F.filter("found", complete), lambda f: f["start"])
    return met.select("doc", "phrase", F.explode(starts).alias("start")).distinct()


def verified_hits(docs: DataFrame, items: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``(doc, n_hit, items, n_items)`` for every row with a true occurrence; ``doc`` is its ``row_key``."""
    phrases = written(phrases_of(items, settings), "phrases")
    index = build_index(docs, phrases)
    anchors = written(anchors_of(phrases, index, settings), "anchors")
    found = exact_matches(index, anchors).join(phrases.select("phrase", "words").dropDuplicates(["phrase"]), "phrase")
    # A document's candidates are at most its own starts times the phrases that share anchors.
    candidates = written(found.groupBy("doc").agg(F.collect_list(F.struct("start", "phrase", "words")).alias("candidates")), "candidates")
    rows = documents_of(docs).select(row_key().alias("doc"), "text").join(candidates, "doc")
    met = bound(words_of(F.col("text")), lambda words: F.filter("candidates", lambda c: F.slice(words, c["start"] + 1, F.size(c["words"])) == c["words"]))
    spans = F.transform("met", lambda c: F.sequence(c["start"], c["start"] + F.size(c["words"]) - 1))
    hits = rows.select("doc", met.alias("met")).where("size(met) > 0").select(
        "doc", F.size(F.array_distinct(F.flatten(spans))).cast("bigint").alias("n_hit"),
        F.array_distinct(F.transform("met", lambda c: c["phrase"])).alias("phrases"),
    )
    named = hits.select("doc", "n_hit", F.explode("phrases").alias("phrase")).join(phrases.select("phrase", "item_id"), "phrase")
    return written(
        named.groupBy("doc").agg(
            F.max("n_hit").alias("n_hit"),
            F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"),
            (F.count_distinct("item_id") + F.max(F.col("item_id").isNull().cast("int"))).cast("bigint").alias("n_items"),
        ),
        "hits",
    )


def decontamination_report(docs: DataFrame, items: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items`` (ids sorted as strings): one row for each row of ``docs``."""
    hits = verified_hits(docs, items, settings)
    rows = documents_of(docs).select("doc_id", row_key().alias("doc"), F.size(words_of(F.col("text"))).cast("bigint").alias("n_words"))
    return rows.join(hits, "doc", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("bigint")).alias("n_items"), F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def clean_documents(docs: DataFrame, items: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no benchmark window."""
    hits = verified_hits(docs, items, settings).select(F.col("doc").alias("row"))
    return carried(docs).join(hits, "row", "left_anti").select(*fields(docs.columns))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP2_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS w
  FROM documents
), b AS (
  SELECT item_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS w
  FROM benchmark
), grams AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s : s + 9], ' ') AS g
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS s FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM grams), starts AS (
  SELECT r, n, s, array_to_string(w[s : s + n - 1], ' ') AS g
  FROM (SELECT r, n, w, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, sizes WHERE len(w) >= n)
), hits AS (
  SELECT r, s, starts.n, item_id FROM starts JOIN grams USING (n, g)
), covered AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(s, s + n - 1)) AS p FROM hits) GROUP BY r
), named AS (
  SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY r
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
"""
