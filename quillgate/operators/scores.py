"""Judge observations, repeat scores and the score cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgate.functions.replies import judge_score
from quillgate.operators.dedup import first_per_key
from quillgate.operators.joins import join_unique


def observed_scores(replies: DataFrame, reply: str = "raw_reply") -> DataFrame:
    """Add ``score``; a reply that cannot be read is a failed repeat (null)."""
    return replies.withColumn("score", judge_score(reply))


def repeat_scores(observations: DataFrame, keys: str | list[str] = "key", score: str = "score") -> DataFrame:
    """``clean_score, sd, n`` per key over the repeats that succeeded.

    When all repeats failed the score is null with ``n`` 0, never 0.0.  The spread of a
    single repeat is 0.
    """
    keys = [keys] if isinstance(keys, str) else keys
    return observations.groupBy(*keys).agg(
        F.avg(score).alias("clean_score"),
        F.coalesce(F.stddev_samp(score), F.lit(0.0)).alias("sd"),
        F.count(score).alias("n"),
    )


def require_select_k(k: int, minimum: int = 16) -> int:
    """The calibration table holds for this many requested repeats; fewer are refused."""
    if k < minimum:
        raise ValueError(f"selection needs at least {minimum} repeats, got {k}")
    return k


def admitted_to_cache(scores: DataFrame, k: int, min_k: int) -> DataFrame:
    """Only scores with the full number of repeats are stored, and none below the minimum k."""
    if k < min_k:
        return scores.limit(0)
    return scores.filter((F.col("n") >= k) & F.col("clean_score").isNotNull())


def update_cache(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """Cache with new keys added; a key already stored keeps its value."""
    both = cache.select("*", F.lit(0).alias("_age")).unionByName(fresh.select(*cache.columns, F.lit(1).alias("_age")))
    return first_per_key(both, "key", F.struct("_age", "clean_score", "n")).drop("_age")


def requests_to_send(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct requests that the cache cannot answer."""
    return requests.dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")


def with_scores(requests: DataFrame, scores: DataFrame, key: str = "key",
                count_from: DataFrame | None = None) -> DataFrame:
    """Attach ``clean_score, sd, n``; a request without observations counts as failed.

    Many requests may share a key (the same text judged again), so the join spreads hot keys.
    """
    wanted = scores.select(F.col("key").alias(key), "clean_score", "sd", "n")
    return join_unique(requests, wanted, key, count_from=count_from).withColumn("n", F.coalesce("n", F.lit(0)))


def normalised(score: Column) -> Column:
    """Score of 0 to 10 as 0 to 1; a missing score counts as 0."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(score, F.lit(0.0)) / F.lit(10.0)))
