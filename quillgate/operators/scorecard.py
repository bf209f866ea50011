"""Per-row evaluation, the scorecard of a run, and run-against-run comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgate.functions.facts import FactPack, ZH_FACTS, extract_facts, pool_verdict
from quillgate.functions.noise import mean_score_error, true_gain_threshold
from quillgate.functions.style import StylePack, ZH_STYLE, has_trace, trace_report
from quillgate.functions.tags import format_defaults
from quillgate.functions.text import filled_question_id, is_blank, text_or_empty
from quillgate.operators.pools import pool_targets
from quillgate.settings import GateSettings, NoiseSettings


def score_rows(inference: DataFrame, pool: DataFrame, scores: DataFrame, facts: FactPack = ZH_FACTS,
               style: StylePack = ZH_STYLE) -> DataFrame:
    """Score every inference row.

    ``pool`` is one of the forms of ``pool_targets``; ``scores`` has ``qid, clean_score, n``.
    A question without a pool answers is reported as ``no_pool`` and leaves the denominator.
    Facts of a pool are read once per question, before the join.
    """
    keyed = inference.withColumn("qid", filled_question_id("qid", "query"))
    targets = pool_targets(pool, facts).withColumnRenamed("facts", "_pool")
    # Scores grow with the rows: they are never broadcast, however small their file looks to the planner.
    judged = scores.select("qid", F.col("clean_score"), F.col("n").alias("clean_n")).hint("merge")
    rows = keyed.join(targets, "qid", "left").join(judged, "qid", "left")
    think, answer = text_or_empty("think"), text_or_empty("answer")
    ok, reason = format_defaults(think, answer, F.col("format_ok"), F.col("format_reason"))
    rows = rows.withColumns(
        {
            "_report": trace_report("think", style, ("has_rag_style", "n")),
            "_facts": extract_facts(answer, facts),
            "_ok": ok,
            "_reason": reason,
            "_forced": ~ok | is_blank(think),
        }
    )
    no_pool = F.col("_pool").isNull()
    told = ("in_pool", "comparable", "reason", "drift_facts")
    rows = rows.withColumn("_verdict", F.when(~no_pool, pool_verdict(answer, F.col("_facts"), F.col("_pool"), told)))
    verdict = F.col("_verdict")
    return rows.select(
        "qid",
        "query",
        "clean_score",
        F.coalesce("clean_n", F.lit(0)).alias("clean_n"),
        F.col("_report.has_rag_style").alias("has_rag_style"),
        F.col("_report.n").alias("n_traces"),
        (~F.col("_forced") & ~F.col("_report.has_rag_style")).alias("rule_pass"),
        F.col("_forced").alias("rule_forced_failure"),
        F.col("_ok").alias("format_ok"),
        F.col("_reason").alias("format_reason"),
        is_blank(think).alias("empty_think"),
        is_blank(answer).alias("empty_answer"),
        F.when(~no_pool, verdict["in_pool"]).alias("in_pool"),
        F.when(no_pool, False).otherwise(verdict["comparable"]).alias("answer_comparable"),
        F.when(no_pool, "no_pool").otherwise(verdict["reason"]).alias("answer_reason"),
        F.when(no_pool, F.array().cast("array<string>")).otherwise(verdict["drift_facts"]).alias("drift_facts"),
        no_pool.alias("no_pool"),
    )


def _share(hits: Column, of: Column) -> Column:
    return F.round(hits / F.greatest(of, F.lit(1)), 4)


def scorecard(scored: DataFrame, tag: str, gates: GateSettings, noise: NoiseSettings) -> DataFrame:
    """One row per run.  Failed judge rows count in ``n`` but not in the mean.

    Rows are first counted per failure reason; the reasons are a handful of fixed texts,
    so the second step merges a few partial rows.
    """
    ok = F.coalesce("format_ok", F.lit(False))
    pooled = ~F.coalesce("no_pool", F.lit(False))
    comparable = pooled & F.coalesce("answer_comparable", F.lit(True))
    valid = F.when((F.col("clean_n") > 0) & F.col("clean_score").isNotNull(), F.col("clean_score"))
    partial = scored.groupBy(
        F.when(~ok, F.coalesce(F.nullif(F.col("format_reason"), F.lit("")), F.lit("unknown"))).alias("_reason")
    ).agg(
        F.count("*").alias("n"),
        F.count(valid).alias("n_valid"),
        F.sum(valid).alias("clean_sum"),
        F.count_if(F.col("rule_pass")).alias("n_rule"),
        F.count_if(pooled).alias("n_pool"),
        F.count_if(pooled & F.col("in_pool")).alias("n_in"),
        F.count_if(comparable).alias("n_comparable"),
        F.count_if(comparable & F.col("in_pool")).alias("n_in_comparable"),
        F.count_if(F.col("answer_reason") == "empty_answer").alias("n_empty"),
    )
    failed = F.col("_reason").isNotNull()
    total = partial.agg(
        *[
            F.coalesce(F.sum(c), F.lit(0)).alias(c)
            for c in ("n", "n_valid", "n_rule", "n_pool", "n_in", "n_comparable", "n_in_comparable", "n_empty")
        ],
        F.sum("clean_sum").alias("clean_sum"),
        F.coalesce(F.sum(F.when(failed, F.col("n"))), F.lit(0)).alias("n_failed"),
        F.map_from_entries(
            F.array_sort(F.collect_list(F.when(failed, F.struct("_reason", "n"))))
        ).alias("format_failure_reasons"),
    )
    n = F.col("n")
    k = gates.k_eval
    return total.select(
        F.lit(tag).alias("tag"),
        "n",
        F.col("n_valid").alias("n_valid_judge"),
        "n_pool",
        (n - F.col("n_pool")).alias("n_no_pool"),
        F.col("n_comparable").alias("n_answer_comparable"),
        (F.col("n_pool") - F.col("n_comparable")).alias("n_answer_uncomparable"),
        F.col("n_empty").alias("n_empty_answer"),
        F.col("n_failed").alias("n_format_failure"),
        _share(n - F.col("n_failed"), n).alias("format_pass_rate"),
        "format_failure_reasons",
        F.round(F.col("clean_sum") / F.nullif(F.col("n_valid"), F.lit(0)), 4).alias("clean_mean"),
        _share(F.col("n_rule"), n).alias("rule_pass_rate"),
        _share(F.col("n_in"), F.col("n_pool")).alias("in_pool_rate"),
        _share(F.col("n_in_comparable"), F.col("n_comparable")).alias("in_pool_comparable_rate"),
        F.round(mean_score_error(n, k, noise), 4).alias("se"),
        F.round(true_gain_threshold(n, k, noise), 4).alias("true_gain_threshold"),
        F.lit(k).alias("k_eval"),
    )


def scorecard_without_format_failures(scored: DataFrame, tag: str, gates: GateSettings,
                                      noise: NoiseSettings) -> DataFrame:
    return scorecard(scored.filter(F.col("format_ok")), tag, gates, noise)


def compare_runs(cards: DataFrame, before: str, after: str, noise: NoiseSettings) -> DataFrame:
    """Two scorecards side by side; the clean score only counts as changed beyond the noise threshold.

    ``cards`` holds one row per tag; the two wanted rows are put into one by conditional
    aggregation.
    """
    wanted = ("n", "k_eval", "clean_mean", "rule_pass_rate", "in_pool_rate")
    picked = cards.filter(F.col("tag").isin(before, after)).agg(
        *[F.max(F.when(F.col("tag") == t, F.col(c))).alias(f"{side}_{c}")
          for side, t in (("before", before), ("after", after)) for c in wanted]
    )
    delta = F.col("after_clean_mean") - F.col("before_clean_mean")
    threshold = true_gain_threshold(F.col("after_n"), F.col("after_k_eval"), noise)
    return picked.select(
        F.lit(before).alias("tag_before"),
        F.lit(after).alias("tag_after"),
        F.col("after_n").alias("n"),
        F.col("before_clean_mean").alias("clean_before"),
        F.col("after_clean_mean").alias("clean_after"),
        F.round(delta, 4).alias("clean_delta"),
        F.round(threshold, 4).alias("threshold"),
        F.when(delta > threshold, "up").when(delta < -threshold, "down").otherwise("tie").alias("verdict"),
        F.round(F.col("after_rule_pass_rate") - F.col("before_rule_pass_rate"), 4).alias("rule_pass_delta"),
        F.round(F.col("after_in_pool_rate") - F.col("before_in_pool_rate"), 4).alias("in_pool_delta"),
    )


def check_stage_gate(card: DataFrame, gates: GateSettings) -> None:
    """Refuse to go on when the in-pool rate fell below the floor (reads the one-row scorecard)."""
    low = card.filter(F.col("in_pool_rate") < gates.in_pool_floor).select("tag", "in_pool_rate").take(1)
    if low:
        raise ValueError(f"{low[0][0]}: in-pool rate {low[0][1]:.4f} is below {gates.in_pool_floor}")


def style_rate(texts: DataFrame, column: str, style: StylePack = ZH_STYLE) -> DataFrame:
    """How many texts carry a surface trace."""
    hit = has_trace(column, style)
    return texts.agg(F.count("*").alias("n"), F.count_if(hit).alias("n_traced"))
