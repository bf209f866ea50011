"""Count, mean and spread that merge: later observations are added without reading earlier ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def moments(observations: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``n, mean, m2`` per key over the values that are there; ``m2`` is the sum of squared deviations."""
    return observations.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), (F.var_pop(value) * F.count(value)).alias("m2")
    )


def merged_moments(stored: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """The moments of both, one row per key; a key of one side stays as it is.

    The squared gap of the means is added to the deviations, so nothing large is subtracted
    from something large.  Keys are compared null-safely.
    """
    a, b = stored.alias("a"), more.alias("b")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    on = same[0]
    for condition in same[1:]:
        on = on & condition
    na, nb = F.coalesce("a.n", F.lit(0)), F.coalesce("b.n", F.lit(0))
    n, gap = na + nb, F.col("b.mean") - F.col("a.mean")
    both = (na > 0) & (nb > 0)
    found_a = F.col("a.n").isNotNull()
    mean = F.when(both, F.col("a.mean") + gap * nb / n).otherwise(F.coalesce("a.mean", "b.mean"))
    m2 = F.when(both, F.col("a.m2") + F.col("b.m2") + gap * gap * na * nb / n).otherwise(F.coalesce("a.m2", "b.m2"))
    return a.join(b, on, "full").select(
        *[F.when(found_a, F.col(f"a.{k}")).otherwise(F.col(f"b.{k}")).alias(k) for k in keys], n.alias("n"), mean.alias("mean"), m2.alias("m2")
    )


def scores_of_moments(state: DataFrame, keys: list[str]) -> DataFrame:
    """``clean_score, sd, n`` as ``repeat_scores`` gives them."""
    sd = F.when(F.col("n") > 1, F.sqrt(F.greatest(F.col("m2"), F.lit(0.0)) / (F.col("n") - 1))).otherwise(F.lit(0.0))
    return state.select(*keys, F.col("mean").alias("clean_score"), sd.alias("sd"), "n")


def variance_within(state: DataFrame) -> DataFrame:
    """Pooled variance of a value around its key's mean, and of the keys' means, from the moments."""
    several = F.col("n") > 1
    return state.agg(
        F.try_divide(F.sum(F.when(several, F.col("m2"))), F.sum(F.when(several, F.col("n") - 1))).alias("within"),
        F.var_samp("mean").alias("between"),
    )
