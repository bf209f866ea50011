"""Calibration of the judge from repeated observations of items with known dirt."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgate.operators.joins import join_unique
from quillgate.operators.ranking import running_totals
from quillgate.sources.settle import settled


def fit_tiers(observations: DataFrame, tier: str, score: str) -> DataFrame:
    """Mean and spread of the observed scores per tier."""
    return observations.groupBy(tier).agg(
        F.avg(score).alias("mean"),
        F.coalesce(F.stddev_samp(score), F.lit(0.0)).alias("sigma"),
        F.count(score).alias("n"),
    )


def variance_parts(observations: DataFrame, item: str, score: str) -> DataFrame:
    """One row: repeat noise within items, spread between items, mean repeats per item.

    The between part is the variance of the item means less the share of the repeat
    noise left in a mean, floored at 0.
    """
    items = observations.groupBy(item).agg(
        F.avg(score).alias("_m"), F.var_samp(score).alias("_v"), F.count(score).alias("_k")
    )
    parts = items.agg(
        F.avg("_v").alias("judge_var"), F.var_samp("_m").alias("means_var"), F.avg("_k").alias("k")
    )
    return parts.select(
        "k",
        "judge_var",
        F.greatest(F.col("means_var") - F.col("judge_var") / F.col("k"), F.lit(0.0)).alias("between_var"),
    )


def tier_separability(tiers: DataFrame, tier: str, n_sigma: float = 3.0, most_tiers: int = 1000) -> DataFrame:
    """Sigma distance of every pair of tiers.

    Tiers are hand-made dirt levels: a table of more than ``most_tiers`` is a wrong key and
    raises, so the pairs and what is broadcast are bounded.  The fit is computed once.
    """
    tiers = settled(tiers.select(tier, "mean", "sigma"))
    if tiers.limit(most_tiers + 1).count() > most_tiers:
        raise ValueError(f"more than {most_tiers} tiers in column {tier}")
    a = tiers.select(F.col(tier).alias("tier_a"), F.col("mean").alias("_ma"), F.col("sigma").alias("_sa"))
    b = tiers.select(F.col(tier).alias("tier_b"), F.col("mean").alias("_mb"), F.col("sigma").alias("_sb"))
    pairs = a.join(F.broadcast(b), F.col("tier_a") < F.col("tier_b"))
    distance = F.abs(F.col("_ma") - F.col("_mb")) / F.nullif(F.col("_sa") + F.col("_sb"), F.lit(0.0))
    return pairs.select(
        "tier_a", "tier_b", distance.alias("distance"),
        F.coalesce(distance > F.lit(n_sigma), F.lit(False)).alias("separable"),
    )


def rank_correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    """Spearman correlation as the correlation of average ranks.

    Equal (x, y) pairs are counted first, so a hot value is one row in the rank joins and
    the result is a weighted correlation over distinct pairs.
    """
    pairs = settled(df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(x, y).agg(F.count("*").alias("_w")))
    weights_x = pairs.groupBy(x).agg(F.sum("_w").alias("_ties"))
    weights_y = pairs.groupBy(y).agg(F.sum("_w").alias("_ties"))
    # A value may stand in a large share of the pairs.
    ranked = join_unique(pairs, _ranks_of(weights_x, x, "_rx"), x, how="inner")
    ranked = join_unique(ranked, _ranks_of(weights_y, y, "_ry"), y, how="inner", count_from=pairs)
    # Average ranks always have the mean (n + 1) / 2; centring keeps the sums exact enough at any size.
    middle = (pairs.agg(F.sum("_w").alias("_n")).scalar() + 1) / F.lit(2.0)
    w, dx, dy = F.col("_w"), F.col("_rx") - middle, F.col("_ry") - middle
    sums = ranked.agg(
        F.sum(w * dx * dy).alias("cov"), F.sum(w * dx * dx).alias("var_x"), F.sum(w * dy * dy).alias("var_y")
    )
    scale = F.sqrt(F.nullif(F.col("var_x") * F.col("var_y"), F.lit(0.0)))
    return sums.select((F.col("cov") / scale).alias("spearman"))


def _ranks_of(ties: DataFrame, column: str, out: str) -> DataFrame:
    """Average rank of each distinct value; the prefix sums run over distinct values only."""
    upto = running_totals(ties, [column], {"_upto": "_ties"})
    return upto.select(column, (F.col("_upto") - (F.col("_ties") - 1) / F.lit(2.0)).alias(out))
