"""Secret scans: candidates by shape, false positives removed by a random forest.

A candidate is a word whose core (the word without surrounding punctuation) is long enough
and holds a digit, or is longer still.  Its features:

* length, shares of digits, lower-case and upper-case letters, distinct characters
* character transitions: changes of character class, and the mean log probability of its
  character pairs under the corpus' own letters-only words
* dictionary coverage: the share of its characters in letter runs that the corpus knows as
  words of at least ``least_documents`` documents
* path and the word after it: smoothed log odds of true findings, from the labelled ones; for a
  labelled finding, from those of other folds, dealt by value, so that neither its own label nor
  that of a copy is a feature of it

An assignment in the same word (``token="..."``) is cut off before the features are computed.

Labels come from a table of findings ``(doc_id, at, label)``.  ``pattern_labels`` makes one
where nobody has reviewed findings: a value assigned to a credential's name is true, quoted or
not, with or without blanks; numbers, addresses and dictionary words are false; any other
candidate, and one that is both, has no label.  What these labels look at, the words before a
candidate and its quotes, is no feature.  The labels of documents that are held out never
reach the model.

Only DataFrame operations and Spark's own forest are used.  Dictionary, transition, path and
neighbour statistics cover all documents; the forest is fitted on at most ``most_findings``
labelled findings of each kind, by hash order.  Candidates carry no text, only their word,
so the later joins move a small table; hot words are summed before they are joined.

Defined results: a null, empty or wordless text has no candidate.  Rows that repeat a
``doc_id`` and text give equal findings once.  Without true or without false labels all
candidates get the smoothed share of true labels as their score; without true labels none is
a secret.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgate.llm.shared import bound, table, written

_SPACES = r"[\x20\x09-\x0D]+"
_EDGES = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"
_FEATURES = [
    "length", "digits", "lower", "upper", "distinct_chars", "class_changes", "pair_logp", "coverage", "path_odds", "right_odds",
]
#: Names that a credential is assigned to, for ``pattern_labels``.
CREDENTIAL_NAMES = ("token", "secret", "password", "passwd", "api_key", "apikey", "access_key", "private_key", "auth")
_ASSIGNED = "(?:" + "|".join(CREDENTIAL_NAMES) + r""")[\w.-]{0,40}["'`\])]{0,2}"""
_SIGN = "(?::=|=>|==?|:)"
#: Numbers, dates, times, IP addresses, mails.
_CLEAR = r"^[+-]?[0-9][0-9.,_:/-]*$|^[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}$|^[^@:/]+@[^@:/]+\.\p{L}{2,}$"


@dataclass(frozen=True)
class Settings:
    least_length: int = 12  #: with a digit
    least_plain_length: int = 20  #: without
    least_documents: int = 3  #: of a dictionary word
    most_findings: int = 10_000  #: labelled findings of each kind that the forest is fitted on
    trees: int = 40
    depth: int = 8
    smoothing: float = 1.0
    folds: int = 8  #: of the labelled findings, for the odds
    threshold: float = 0.5
    seed: int = 7


def candidates(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id, row, path, at, value, left1, left2, right1, bare, assigned``.

    ``bare`` is the value without a credential's name and sign in the same word; ``assigned``
    says that it is assigned to such a name, in this word or by the words before.
    """
    path = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    words = F.filter(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), _SPACES, -1), lambda w: w != "")
    n, plain = settings.least_length, settings.least_plain_length

    def found(words: Column) -> Column:
        long = F.filter(F.transform(words, lambda w, i: F.struct(i.alias("at"), w.alias("word"))), lambda x: F.char_length(x["word"]) >= n)
        cored = F.transform(long, lambda x: F.struct(
            x["at"].alias("at"), x["word"].alias("word"), F.regexp_replace(x["word"], _EDGES, "").alias("value"),
            F.get(words, x["at"] - 1).alias("left1"), F.get(words, x["at"] - 2).alias("left2"), F.get(words, x["at"] + 1).alias("right1"),
        ))
        return F.filter(cored, lambda x: (F.char_length(x["value"]) >= plain) | ((F.char_length(x["value"]) >= n) & F.rlike(x["value"], F.lit("[0-9]"))))

    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).alias("row"), path.alias("path"),
        bound(words, found).alias("all"),
    )
    return rows.select("doc_id", "row", "path", F.explode("all").alias("c")).select(
        "doc_id", "row", "path", "c.at", "c.value", "c.left1", "c.left2", "c.right1",
        F.coalesce(F.nullif(F.regexp_replace("c.value", f"(?i)^.*?{_ASSIGNED}{_SIGN}[\"'`]*", ""), F.lit("")), "c.value").alias("bare"),
        F.concat_ws(" ", "c.left2", "c.left1", "c.word").rlike(f"(?i){_ASSIGNED} ?{_SIGN} ?[^ ]+$").alias("assigned"),
    ).distinct()


def pattern_labels(found: DataFrame) -> DataFrame:
    """``doc_id, row, at, label`` of clear cases, a stand-in for reviewed findings."""
    plain = found.where(F.col("bare").rlike(r"^\p{Lu}?\p{Ll}+$")).groupBy("bare").agg(F.count_distinct("row").alias("n"))
    known = plain.where(F.col("n") >= Settings().least_documents).select("bare", F.lit(True).alias("is_word"))
    clear = F.col("bare").rlike(_CLEAR) | F.coalesce("is_word", F.lit(False))
    told = found.join(known, "bare", "left").where(F.col("assigned") != clear)
    return told.select("doc_id", "row", "at", F.col("assigned").cast("int").alias("label"))


def dictionary(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``(word, n)``: letters-only words, ASCII lower-cased, with the rows they occur in."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))), F.lit(r"\p{L}{3,}"), F.lit(0)))
    return docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= settings.least_documents)


def _pairs(word: Column) -> Column:
    """Pairs of neighbouring characters; anything but ASCII letters and digits is one class."""
    flat = F.regexp_replace(F.lower(word), "[^a-z0-9]", "_")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(flat) - 1, F.lit(1))), lambda i: F.substring(flat, i, F.lit(2)))


def _by_fold(labelled: DataFrame, key: str, settings: Settings) -> DataFrame:
    """For each key its true and its labelled findings, in every fold."""
    of = lambda i: F.col("fold") == i
    return labelled.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.array(*[F.count_if(of(i) & (F.col("label") == 1)) for i in range(settings.folds)]).alias(f"{key}_true"),
        F.array(*[F.count_if(of(i)) for i in range(settings.folds)]).alias(f"{key}_all"),
    )


def _odds(key: str, base: float, settings: Settings) -> Column:
    """Smoothed log odds of true findings by a key, relative to all; a labelled finding's own fold is left out."""

    def others(counts: str) -> Column:
        every = F.aggregate(counts, F.lit(0).cast("bigint"), lambda x, y: x + y)
        return every - F.when(F.col("label").isNotNull(), F.get(F.col(counts), F.col("fold"))).otherwise(F.lit(0))

    a, true = settings.smoothing, others(f"{key}_true")
    # shrunk to the base odds, so that a key seen once says little
    return F.log((true + a * base) / (others(f"{key}_all") - true + a) / F.lit(base))


def features(found: DataFrame, docs: DataFrame, labelled: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The candidates with all features; ``labelled`` has ``row, at, label``, labels of one finding combine by minimum."""
    told = labelled.groupBy("row", "at").agg(F.min("label").alias("label"))
    fold = F.pmod(F.xxhash64(F.lit(settings.seed), F.col("bare")), F.lit(settings.folds)).cast("int")
    found = written(found.join(told, ["row", "at"], "left").withColumn("fold", fold), "secret-labels")
    value = F.col("bare")
    share = lambda cls: F.regexp_count(value, F.lit(cls)) / F.char_length(value)
    kind = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, r"\p{Ll}+", "a"), r"\p{Lu}+", "A"), "[0-9]+", "9")
    base = found.select(
        "*", F.char_length(value).cast("double").alias("length"), share("[0-9]").alias("digits"), share(r"\p{Ll}").alias("lower"), share(r"\p{Lu}").alias("upper"),
        (F.size(F.array_distinct(F.split(value, ""))) / F.char_length(value)).alias("distinct_chars"),
        (F.char_length(kind) / F.char_length(value)).alias("class_changes"),
    )
    known = written(dictionary(docs, settings), "dictionary")
    a = settings.smoothing
    counts = known.select(F.explode(_pairs(F.col("word"))).alias("pair"), "n").groupBy("pair").agg(F.sum("n").alias("n"))
    from_first = counts.groupBy(F.substring("pair", 1, 1).alias("head")).agg(F.sum("n").alias("all"))
    pairs = counts.withColumn("head", F.substring("pair", 1, 1)).join(F.broadcast(from_first), "head").select(
        "pair", F.log((F.col("n") + a) / (F.col("all") + a * 37)).alias("logp")
    )  # 37 classes: at most 1,369 pairs, the bound of these broadcasts
    unseen = -10.0
    values = written(found.select("bare").distinct(), "secret-values")
    fluency = values.select("bare", F.explode(_pairs(value)).alias("pair")).join(F.broadcast(pairs), "pair", "left").groupBy("bare").agg(
        F.avg(F.coalesce("logp", F.lit(unseen))).alias("pair_logp")
    )
    runs = values.select("bare", F.explode(F.regexp_extract_all(F.lower(value), F.lit(r"\p{L}{3,}"), F.lit(0))).alias("word"))
    covered = runs.join(known.select("word"), "word").groupBy("bare").agg(F.sum(F.char_length("word")).alias("chars"))
    by_value = written(
        values.join(fluency, "bare", "left").join(covered, "bare", "left").select(
            "bare", "pair_logp", (F.coalesce("chars", F.lit(0)) / F.char_length("bare")).alias("coverage")
        ),
        "secret-value-features",
    )
    marked = found.where("label IS NOT NULL")
    total = marked.agg(F.coalesce(F.sum("label"), F.lit(0)), F.count("label")).first()
    odds = (total[0] + a) / (total[1] - total[0] + a)
    rights = written(_by_fold(marked, "right1", settings), "right-odds")
    paths = written(_by_fold(marked, "path", settings), "path-odds")
    wide = base.join(by_value, "bare").join(paths, "path", "left").join(rights, "right1", "left")
    wide = wide.withColumns({"path_odds": _odds("path", odds, settings), "right_odds": _odds("right1", odds, settings)})
    return wide.select("doc_id", "row", "at", "value", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in _FEATURES])


def scanned(docs: DataFrame, labels_of=pattern_labels, learn_from: Column | None = None, settings: Settings = Settings()) -> DataFrame:
    """``doc_id, at, value, score, is_secret``: every candidate of every text.

    ``labels_of`` maps candidates to labelled findings; ``learn_from`` says which of them
    the model may see (by ``doc_id``; all by default).
    """
    found = written(candidates(docs, settings), "secret-candidates")
    labels = labels_of(found)
    known = written(labels.where(learn_from) if learn_from is not None else labels, "secret-known")
    rows = written(features(found, docs, known, settings), "secret-features")
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row for each kind
    true, false = sizes.get(1, 0), sizes.get(0, 0)
    if not true or not false:
        score = F.lit((true + settings.smoothing) / (true + false + 2 * settings.smoothing))
        return rows.select("doc_id", "at", "value", score.alias("score"), (F.lit(true > 0) & (score >= settings.threshold)).alias("is_secret"))
    order = [F.xxhash64("row", "at"), F.col("row"), F.col("at")]
    sample = [known.where(F.col("label") == k).orderBy(*order).limit(settings.most_findings) for k in (0, 1)]
    # At most 2 * most_findings rows, sorted, in one task: the forest is the same on every run.
    fit_on = written(rows.join(sample[0].unionByName(sample[1]).select("row", "at", "label"), ["row", "at"]).select("row", "at", "label", *_FEATURES), "secret-fit")
    fit_on = fit_on.orderBy("row", "at").coalesce(1)
    gather = VectorAssembler(inputCols=_FEATURES, outputCol="features")
    forest = RandomForestClassifier(
        labelCol="label", featuresCol="features", numTrees=settings.trees, maxDepth=settings.depth, seed=settings.seed, cacheNodeIds=False
    ).fit(gather.transform(fit_on))
    score = vector_to_array("probability").getItem(1)
    return forest.transform(gather.transform(rows)).select("doc_id", "at", "value", score.alias("score"), (score >= settings.threshold).alias("is_secret"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    learn_from = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 != 2, F.lit(False))
    return scanned(table(spark, sf_dir, "documents"), learn_from=learn_from)
