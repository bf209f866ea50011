"""Lookups by equal keys where the condition itself is a prefix or a range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgate.operators.joins import HOT_ROWS, join_unique


def _prefixes(text: Column) -> Column:
    lengths = F.sequence(F.lit(0), F.char_length(text))
    return F.transform(lengths, lambda n: F.substring(text, F.lit(1), n))


def covered_dates(model: DataFrame, pool: DataFrame, key: str, date: str = "date") -> DataFrame:
    """``key, date, covered`` for every different date of a question.

    A date counts as known when it or a date of its pool is a coarser spelling, a prefix, of
    the other.  Both sides are expanded to their prefixes and meet by (question, prefix); they
    are a pair where the prefix is one side's whole date.  Repeated dates go in partial sums
    before the join, so a question with a third of all dates is its different spellings.
    Null dates are left out; a null question has no pool.
    """
    whole = F.col("_prefix") == F.col(date)
    asked = model.select(key, date).where(F.col(date).isNotNull()).distinct()
    known = (
        pool.select(key, date).where(F.col(date).isNotNull() & F.col(key).isNotNull()).distinct()
        .withColumn("_prefix", F.explode(_prefixes(F.col(date))))
        .groupBy(key, "_prefix").agg(F.max(whole).alias("_known"))
    )
    spread = asked.withColumn("_prefix", F.explode(_prefixes(F.col(date)))).withColumn("_whole", whole)
    met = spread.join(known, [key, "_prefix"], "left")
    hit = F.coalesce(F.col("_whole") | F.col("_known"), F.lit(False)) & F.col("_known").isNotNull()
    return met.groupBy(key, date).agg(F.max(hit).alias("covered"))


def sigma_by_judge(scores: DataFrame, tiers: DataFrame, judge: str = "judge", score: str = "score", min_rows: int = HOT_ROWS) -> DataFrame:
    """``scores`` with ``sigma``, interpolated between the tiers ``(judge, mean, sigma)`` of its judge.

    A judge's range is cut into as many equal cells as it has tiers, so its intervals lie in at
    most twice as many places; a score looks up the place (judge, cell) and the interval in it.
    Outside the tiers sigma is flat.  An unknown judge or a null score has a null sigma; equal
    means take the lower sigma on the left and the higher on the right.
    """
    tiers = tiers.select(F.col(judge), F.col("mean").cast("double"), F.col("sigma").cast("double")).where(F.col(judge).isNotNull())
    pair = F.struct("mean", "sigma")
    ends = tiers.groupBy(judge).agg(F.min(pair).alias("_from"), F.max(pair).alias("_to"), F.count(F.lit(1)).alias("_tiers"))
    width = F.nullif((F.col("_to.mean") - F.col("_from.mean")) / F.col("_tiers"), F.lit(0.0))
    ends = ends.select(judge, "_from", "_to", width.alias("_width"))

    def cell(x: Column) -> Column:
        return F.floor((x - F.col("_from.mean")) / F.col("_width"))

    in_order = Window.partitionBy(judge).orderBy("mean", "sigma")  # a judge's tiers are few
    steps = tiers.select(judge, pair.alias("a"), F.lead(pair).over(in_order).alias("b")).where("b.mean > a.mean").join(ends, judge)
    cells = steps.select(judge, "a", "b", F.explode(F.sequence(cell(F.col("a.mean")), cell(F.col("b.mean")))).alias("_cell"))
    places = cells.groupBy(F.struct(judge, "_cell").alias("_place")).agg(F.collect_list(F.struct("a", "b")).alias("_steps"))

    x = F.col(score).cast("double")
    framed = join_unique(scores, ends, judge, min_rows=min_rows)
    inside = (x > F.col("_from.mean")) & (x <= F.col("_to.mean"))
    placed = framed.withColumn("_place", F.when(inside, F.struct(F.col(judge), cell(x).alias("_cell"))))
    found = join_unique(placed, places, "_place", min_rows=min_rows)
    step = F.get(F.filter("_steps", lambda s: (x > s["a"]["mean"]) & (x <= s["b"]["mean"])), F.lit(0))
    a, b = step["a"], step["b"]
    between = a["sigma"] + (x - a["mean"]) / (b["mean"] - a["mean"]) * (b["sigma"] - a["sigma"])
    sigma = F.when(x <= F.col("_from.mean"), F.col("_from.sigma")).when(x > F.col("_to.mean"), F.col("_to.sigma")).otherwise(between)
    return found.withColumn("sigma", sigma).drop("_from", "_to", "_width", "_place", "_steps")
