"""Candidate sets: long and nested form, gates, best of K."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgate.functions.facts import FactPack, ZH_FACTS, drift_facts, extract_facts
from quillgate.functions.style import StylePack, ZH_STYLE, has_trace
from quillgate.functions.tags import parse_tolerant
from quillgate.functions.text import is_blank
from quillgate.sources.settle import stored


def explode_candidates(rollouts: DataFrame, candidates: str = "candidates") -> DataFrame:
    """One row per candidate with its position ``cand_idx`` and ``text``; prompt columns repeat."""
    others = [c for c in rollouts.columns if c != candidates]
    return rollouts.select(*others, F.posexplode(candidates).alias("cand_idx", "text"))


def aligned_candidates(prompts: DataFrame, completions: DataFrame, position: str = "position") -> DataFrame:
    """Completions with the columns of their prompt and ``cand_idx``: K in a row belong to one prompt.

    Both tables number their rows from 0 in ``position``.  K is the number of completions for each
    prompt; tables that do not divide, or whose numbers have gaps or repeats, are an error,
    because a completion would be held against another question's answers.
    """
    counted = []
    for name, table in (("prompts", prompts), ("completions", completions)):
        seen = table.agg(F.count(F.lit(1)).alias("n"), F.min(position).alias("lo"), F.max(position).alias("hi"), F.count(position).alias("there")).first()
        if seen.n and (seen.there, seen.lo, seen.hi) != (seen.n, 0, seen.n - 1):
            raise ValueError(f"{name}: positions are not 0 to {seen.n - 1}")
        counted.append(seen.n)
    n_prompts, n = counted
    if (n % n_prompts if n_prompts else n):
        raise ValueError(f"{n} completions do not divide by {n_prompts} prompts")
    k = max(1, n // n_prompts) if n_prompts else 1
    # A repeated position leaves a gap elsewhere, so every completion must find one prompt.
    numbered = completions.select(
        F.floor(F.col(position) / k).cast("bigint").alias("_prompt"), (F.col(position) % k).cast("bigint").alias("cand_idx"), *[c for c in completions.columns if c != position]
    )
    once = prompts.groupBy(F.col(position).cast("bigint").alias("_prompt")).agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in prompts.columns if c != position])
    told = numbered.join(once, "_prompt", "left")
    sound = F.when(F.col("_n") == 1, F.col("_prompt")).otherwise(F.raise_error(F.lit("a completion has no prompt, or two")).cast("bigint"))
    return told.select(sound.alias(position), "cand_idx", *[c for c in told.columns if c not in ("_prompt", "_n", "cand_idx")])


def nest_in_order(rows: DataFrame, keys: list[str], index: str, value: str, out: str) -> DataFrame:
    """One row per key with its values as an array in index order.

    For tables that a trainer or a file wants nested; everything else works on the long form.
    """
    grouped = rows.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), F.col(value).alias("v")))).alias("_items")
    )
    return grouped.select(*keys, F.transform("_items", lambda x: x["v"]).alias(out))


def best_of(df: DataFrame, key: str, score: str, index: str, keep: list[str]) -> DataFrame:
    """Per key the row with the highest score; the smaller index wins ties, null scores are out.

    Partially aggregated, so it needs no window over a key's candidates.
    """
    row = F.struct(F.col(index), F.col(score), *[F.col(c) for c in keep])
    order = F.struct(F.col(score), (-F.col(index)).alias("_first"))
    return (
        df.filter(F.col(score).isNotNull())
        .groupBy(key)
        .agg(F.max_by(row, order).alias("_best"))
        .select(key, "_best.*")
    )


def read_candidates(candidates: DataFrame, facts: FactPack = ZH_FACTS, style: StylePack = ZH_STYLE) -> DataFrame:
    """Candidates that pass the gates their own ``text`` decides, with ``think`` and the ``answer_facts``.

    Cheapest first: a non-blank think and answer (a blank answer is in no pool), no style trace.
    """
    kept = [c for c in candidates.columns if c != "text"]
    think, answer = F.col("_p.think"), F.col("_p.answer")
    parsed = candidates.withColumn("_p", parse_tolerant("text"))
    passed = F.when(think == "", False).when(is_blank(answer), False).otherwise(~has_trace(think, style))
    return parsed.filter(passed).select(*kept, think.alias("think"), extract_facts(answer, facts).alias("answer_facts"))


def inside_pool(read: DataFrame) -> DataFrame:
    """Read candidates whose answer brings no fact that ``pool_facts`` lacks; written, so no gate is computed twice."""
    in_pool = F.size(drift_facts(F.col("answer_facts"), F.col("pool_facts"))) == 0
    return stored(read.filter(in_pool).drop("answer_facts", "pool_facts"), "gated")


def gated_candidates(candidates: DataFrame, facts: FactPack = ZH_FACTS, style: StylePack = ZH_STYLE) -> DataFrame:
    """Candidates that pass the deterministic gates, with their ``think``; expects ``text`` and ``pool_facts``."""
    return inside_pool(read_candidates(candidates, facts, style))


def group_advantage(rewards: DataFrame, key: str = "qid", reward: str = "reward", ddof: int = 1) -> DataFrame:
    """Add ``advantage``: (reward - mean) / std within a group; 0 when the group has no spread.

    The group statistics are aggregated first and joined back, so a hot group is never
    collected into one window.
    """
    from quillgate.operators.joins import join_unique

    spread = F.stddev_samp(reward) if ddof == 1 else F.stddev_pop(reward)
    # One narrow row for each group; it also tells which groups are large.
    stats = stored(rewards.groupBy(key).agg(F.avg(reward).alias("_mean"), spread.alias("_std"), F.count("*").alias("_n")), "groups")
    scaled = (F.col(reward) - F.col("_mean")) / F.col("_std")
    no_spread = F.col("_std").isNull() | (F.col("_std") == 0.0)
    return (
        join_unique(rewards, stats.drop("_n"), key, counts=stats.select(key, "_n"))
        .withColumn("advantage", F.when(no_spread, F.lit(0.0)).otherwise(scaled))
        .drop("_mean", "_std")
    )
