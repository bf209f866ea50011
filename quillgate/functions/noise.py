"""Measurement noise of the judge: sigma lookup, separability, standard errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgate.functions.text import as_col
from quillgate.settings import NoiseSettings


def sigma_of_score(score: Column | str, noise: NoiseSettings) -> Column:
    """Standard deviation at a score: linear between tiers, flat outside them."""
    x = as_col(score).cast("double")
    tiers = noise.tiers
    ladder = F.when(x.isNull(), F.lit(None).cast("double")).when(x <= tiers[0][0], F.lit(tiers[0][1]))
    for (x0, y0), (x1, y1) in zip(tiers, tiers[1:]):
        if x1 == x0:
            ladder = ladder.when(x <= x1, F.lit(y1))
        else:
            ladder = ladder.when(x <= x1, F.lit(y0) + (x - F.lit(x0)) / F.lit(x1 - x0) * F.lit(y1 - y0))
    return ladder.otherwise(F.lit(tiers[-1][1]))


def sigma_distance(a: Column | str, b: Column | str, noise: NoiseSettings) -> Column:
    """Gap in units of the two error bands; null where both bands are zero wide."""
    gap = as_col(a) - as_col(b)
    return gap / F.nullif(sigma_of_score(a, noise) + sigma_of_score(b, noise), F.lit(0.0))


def clearly_cleaner(clean: Column | str, dirty: Column | str, noise: NoiseSettings, n_sigma: float) -> Column:
    """The two error bands do not touch.  Null scores are never separable."""
    gap = as_col(clean) - as_col(dirty)
    bands = sigma_of_score(clean, noise) + sigma_of_score(dirty, noise)
    return F.coalesce((gap > 0) & (gap > F.lit(float(n_sigma)) * bands), F.lit(False))


def mean_score_error(n_items: Column | str, k: Column | int, noise: NoiseSettings) -> Column:
    """Standard error of a mean over ``n_items`` with ``k`` repeats each."""
    repeats = k if isinstance(k, Column) else F.lit(k)
    spread = F.lit(noise.sigma_between ** 2) + F.lit(noise.sigma_judge ** 2) / F.greatest(repeats, F.lit(1))
    return F.sqrt(spread) / F.sqrt(F.greatest(as_col(n_items), F.lit(1)))


def true_gain_threshold(n_items: Column | str, k: Column | int, noise: NoiseSettings, n_sigma: float = 3.0) -> Column:
    return F.lit(float(n_sigma)) * mean_score_error(n_items, k, noise)


def rate_error(rate: Column | str, n_items: Column | str) -> Column:
    p = as_col(rate)
    return F.sqrt(p * (F.lit(1.0) - p) / F.greatest(as_col(n_items), F.lit(1)))
