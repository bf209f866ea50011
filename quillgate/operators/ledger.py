"""Token spend: totals, running cost and budget crossings."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgate.functions.text import as_col
from quillgate.operators.ranking import running_totals
from quillgate.settings import SpendSettings


def cost_of(in_tokens: Column | str, out_tokens: Column | str, prices: SpendSettings) -> Column:
    """Money for tokens, in exact decimal arithmetic."""

    def priced(tokens: Column | str, per_million: float) -> Column:
        count = F.coalesce(as_col(tokens), F.lit(0)).cast("decimal(20,0)")
        return count * F.lit(Decimal(str(per_million)))

    total = priced(in_tokens, prices.price_in_per_million) + priced(out_tokens, prices.price_out_per_million)
    return total * F.lit(Decimal("0.000001"))


def rounded_cost(in_tokens: Column | str, out_tokens: Column | str, prices: SpendSettings) -> Column:
    return F.round(cost_of(in_tokens, out_tokens, prices), 4).cast("double")


def usage_totals(usage: DataFrame, prices: SpendSettings, by: list[str] | None = None) -> DataFrame:
    """Calls, tokens, cache hits and money, over everything or per group.

    Money is derived from the summed tokens, so it does not depend on the order of rows.
    """
    sums = usage.groupBy(*(by or [])).agg(
        F.count_if(~F.coalesce("cache_hit", F.lit(False))).alias("calls"),
        F.coalesce(F.sum("in_tokens"), F.lit(0)).alias("in_tokens"),
        F.coalesce(F.sum("out_tokens"), F.lit(0)).alias("out_tokens"),
        F.count_if(F.coalesce("cache_hit", F.lit(False))).alias("cache_hits"),
    )
    spent = rounded_cost("in_tokens", "out_tokens", prices)
    out = sums.withColumn("yuan", spent).withColumn("budget_yuan", F.lit(prices.budget))
    share = F.col("yuan") / F.lit(prices.budget) if prices.budget > 0 else F.lit(0.0)
    return out.withColumn("pct", share)


def budget_flags(spent: Column, prices: SpendSettings) -> tuple[Column, Column]:
    """(warn, over) for a running total; both false when the budget is off."""
    if prices.budget <= 0:
        return F.lit(False), F.lit(False)
    return spent >= F.lit(prices.warn_fraction * prices.budget), spent >= F.lit(prices.budget)


def running_spend(usage: DataFrame, order: list[str], prices: SpendSettings, partitions: int | None = None) -> DataFrame:
    """Running tokens and cost in log order, with the warn and over flags of each row."""
    totals = running_totals(usage, order, {"in_so_far": "in_tokens", "out_so_far": "out_tokens"}, partitions)
    flagged = totals.withColumn("yuan_so_far", rounded_cost("in_so_far", "out_so_far", prices))
    warn, over = budget_flags(F.col("yuan_so_far"), prices)
    return flagged.withColumns({"warn": warn, "over": over})


def crossing_row(spend: DataFrame, order: list[str], flag: str) -> DataFrame:
    """The first row of the log at which a flag is raised."""
    row = F.struct(*spend.columns)
    return spend.filter(F.col(flag)).agg(F.min_by(row, F.struct(*order)).alias("_r")).filter(
        F.col("_r").isNotNull()
    ).select("_r.*")
