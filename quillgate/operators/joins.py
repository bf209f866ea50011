"""Joins between the record tables, and the checks built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgate.functions.text import filled_question_id, is_blank
from quillgate.sources.settle import stored

# A key is hot when it holds at least this many rows.  Only the largest hot keys are
# listed, so what is broadcast has a fixed bound; a key beyond the list holds less than
# one part in MAX_HOT_KEYS of all rows and needs no spreading.
HOT_ROWS = 100_000
MAX_HOT_KEYS = 65_536
# Rows without a key are dealt over so many shares.
NULL_SHARES = 4096
# Hashes by which rows are counted before keys are.
KEY_HASHES = 65_536


def hot_keys(df: DataFrame, key: str, min_rows: int = HOT_ROWS) -> DataFrame:
    """``key, _copies`` of the largest keys."""
    return largest_keys(crowded_keys(df, key, min_rows).filter(F.col(key).isNotNull()), key, min_rows)


def crowded_keys(df: DataFrame, key: str, min_rows: int) -> DataFrame:
    """``key, _n`` of all keys with ``min_rows`` rows, and of some others; the null key counts like any.

    Rows are counted by a hash of their key first, a few rows for each task.  Only keys whose
    hash holds ``min_rows`` rows are counted themselves, so that in most tables no key is shuffled.
    """
    hashed = df.select(key, F.pmod(F.xxhash64(key), F.lit(KEY_HASHES)).cast("int").alias("_hash"))
    crowded = hashed.groupBy("_hash").agg(F.count("*").alias("_n")).filter(F.col("_n") >= min_rows).select("_hash")
    inside = hashed.join(F.broadcast(crowded), "_hash", "left_semi")
    return inside.groupBy(key).agg(F.count("*").alias("_n"))


def largest_keys(counts: DataFrame, key: str, min_rows: int = HOT_ROWS) -> DataFrame:
    """The same from counts ``(key, _n)`` that are known already."""
    largest = counts.filter(F.col("_n") >= min_rows).orderBy(F.desc("_n"), key).limit(MAX_HOT_KEYS)
    return largest.select(key, F.ceil(F.col("_n") / F.lit(min_rows)).cast("int").alias("_copies"))


def join_unique(left: DataFrame, right: DataFrame, key: str, how: str = "left", min_rows: int = HOT_ROWS,
                count_from: DataFrame | None = None, counts: DataFrame | None = None) -> DataFrame:
    """Join to a table with one row per key, spreading hot keys of the left side.

    A hot key is cut into salted shares and only its single row on the right is copied
    to each share, so the other keys cost nothing extra.  Hot keys are looked for at once; without
    any the join is one on the key alone, which uses how its sides are partitioned already.
    ``count_from`` is a cheaper table with the same keys to find the hot ones in, when ``left`` is
    costly to compute; ``counts`` are its rows for each key, null included, ``(key, _n)``, where they are known.
    """
    if counts is None:
        counts = crowded_keys(left if count_from is None else count_from, key, min_rows)
    large = stored(counts.filter(F.col("_n") >= min_rows), "hot-keys")
    if large.isEmpty():
        return left.join(right, key, how)
    hot = F.broadcast(largest_keys(large.filter(F.col(key).isNotNull()), key, min_rows))
    copies = F.coalesce(F.col("_copies"), F.lit(1))
    # The share follows from the row itself, so a task that is run again sends every row
    # to the same place.  Rows of other keys are not hashed.
    contents = [f.name for f in left.schema if "map<" not in f.dataType.simpleString()]
    # Rows without a key match nothing and go anywhere.
    share = (
        F.when(F.col(key).isNull(), F.pmod(F.xxhash64(*contents), F.lit(NULL_SHARES)))
        .when(copies > 1, F.pmod(F.xxhash64(*contents), copies)).otherwise(F.lit(0)).cast("int")
    )
    spread = (
        left.join(hot, key, "left")
        .withColumn("_salt", share)
        .drop("_copies")
    )
    copied = (
        right.join(hot, key, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), copies - 1)))
        .drop("_copies")
    )
    return spread.join(copied, [key, "_salt"], how).drop("_salt")


def not_done(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Items whose key has no result yet (rows without a key are kept)."""
    return items.join(done.select(key), key, "left_anti")


def uncovered(problems: DataFrame, pool: DataFrame, key: str = "qid") -> DataFrame:
    """Problems that have no pool."""
    return problems.join(pool.select(key), key, "left_anti")


def with_leak_flag(train: DataFrame, held_out: DataFrame, flag: str = "leaked") -> DataFrame:
    """``flag``: the question is marked for another split or also stands in the held-out set."""
    wrong_split = F.col("split").isNotNull() & (F.col("split") != "") & (F.col("split") != "train")
    ids = held_out.filter((F.col("qid") != "") | F.col("query").isNotNull()).select(
        filled_question_id("qid", "query").alias("qid")
    )
    marked = join_unique(train, ids.distinct().withColumn("_held", F.lit(True)), "qid")
    return marked.withColumn(flag, F.coalesce(wrong_split | F.col("_held"), F.lit(False))).drop("_held")


def leaked_questions(train: DataFrame, held_out: DataFrame) -> DataFrame:
    """Training questions that are marked for another split or also stand in the held-out set."""
    return with_leak_flag(train, held_out, "_leaked").filter("_leaked").drop("_leaked")


def without_pool(train: DataFrame, pool: DataFrame) -> DataFrame:
    """Training questions whose pool is missing or holds only blanks (``answers`` column)."""
    usable = pool.filter(F.exists("answers", lambda a: ~is_blank(a))).select("qid")
    return train.join(usable, "qid", "left_anti")


def without_long_pool(train: DataFrame, answers: DataFrame) -> DataFrame:
    """The same for a pool in long form, ``qid, answer``: no array for each question."""
    usable = answers.filter(~is_blank("answer")).select("qid").distinct()
    return train.join(usable, "qid", "left_anti")


def least_keys(df: DataFrame, n: int, key: str = "qid") -> DataFrame:
    """The ``n`` least different keys: the same sample in every run, kept by each task on its own."""
    return df.select(key).distinct().orderBy(key).limit(n)


def sample_keys(df: DataFrame, n: int, key: str = "qid") -> list[str]:
    """A few offending keys for an error text."""
    return [r[0] for r in least_keys(df, n, key).collect()]
