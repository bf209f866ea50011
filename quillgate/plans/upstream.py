"""From the raw corpus to splits, problem sets, answer pools and rollouts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgate.functions.replies import DEFAULT_PROMPTS, PromptPack, system_prompt_for
from quillgate.functions.tags import parse_diagnostic, parse_tolerant
from quillgate.functions.text import filled_question_id, first_non_empty, is_blank, question_id, stripped, text_or_empty
from quillgate.operators.candidates import nest_in_order
from quillgate.operators.dedup import first_per_key
from quillgate.operators.joins import not_done
from quillgate.operators.ranking import fixed_count_split
from quillgate.settings import SplitSettings


def generation_requests(items: DataFrame, system, temperature: float, top_p: float, max_tokens: int,
                        n: int = 1) -> DataFrame:
    """Request rows for the generation service; ``n`` samples share one prompt."""
    return items.select(
        filled_question_id("qid", "query").alias("qid") if "qid" in items.columns else question_id("query").alias("qid"),
        system.alias("system"),
        text_or_empty("user_prompt").alias("user"),
        F.lit(temperature).alias("temperature"),
        F.lit(top_p).alias("top_p"),
        F.lit(max_tokens).alias("max_tokens"),
        F.lit(n).alias("n"),
    )


def base_requests(corpus: DataFrame, done: DataFrame, prompts: PromptPack = DEFAULT_PROMPTS, left=not_done) -> DataFrame:
    """Greedy requests to the base model for questions that have no output yet.

    ``left`` finds them: ``not_done``, or ``resume.remaining`` where most of a large corpus is settled by a key filter.
    """
    todo = left(corpus, done, "query")
    return generation_requests(todo, F.lit(prompts.retrieval_system), 0.0, 1.0, 1536)


def base_outputs(corpus: DataFrame, replies: DataFrame) -> DataFrame:
    """Corpus with the base model's raw reply and its parsed parts; ``replies`` has ``query, raw``."""
    joined = corpus.join(replies, "query").withColumn("_p", parse_tolerant("raw"))
    return joined.select(
        "query",
        text_or_empty("user_prompt").alias("user_prompt"),
        "raw",
        F.col("_p.think").alias("reasoning"),
        F.col("_p.answer").alias("answer"),
    )


def empty_answer_count(outputs: DataFrame, column: str = "answer") -> DataFrame:
    return outputs.agg(F.count("*").alias("n"), F.count_if(is_blank(column)).alias("n_empty_answer"))


def clean_questions(outputs: DataFrame, order: str) -> DataFrame:
    """Trimmed rows with prompt and answer, first of each question kept.

    Blank rows go before the duplicates are decided, so a later good copy can survive.
    """
    trimmed = outputs.select(
        question_id("query").alias("qid"),
        "query",
        stripped("user_prompt").alias("user_prompt"),
        stripped("answer").alias("answer"),
        stripped("reasoning").alias("reasoning"),
        order,
    ).filter((F.col("user_prompt") != "") & (F.col("answer") != ""))
    return first_per_key(trimmed, "qid", order).drop(order)


def split_questions(outputs: DataFrame, order: str, settings: SplitSettings) -> DataFrame:
    """Labelled questions; fails when too few remain to hold out ``n_eval`` of them."""
    rows = clean_questions(outputs, order)
    n = rows.count()
    if n <= settings.n_eval:
        raise ValueError(f"{n} usable questions are not enough to hold out {settings.n_eval}")
    return fixed_count_split(rows, "qid", settings.n_eval, settings.split_seed)


def problems(questions: DataFrame, split: str | None = None) -> DataFrame:
    """Problem set of all questions or of one split."""
    chosen = questions if split is None else questions.filter(F.col("split") == split)
    return chosen.select("qid", "split", "query", "user_prompt", F.col("answer").alias("gold_answer"))


def answer_pool(problem_set: DataFrame, replies: DataFrame) -> DataFrame:
    """Pools from generation replies ``(qid, sample_idx, reply)``.

    ``sample_idx`` 0 is the greedy reply, the others are samples in order.  Problems
    without a greedy reply get no pool.
    """
    parsed = replies.withColumn("_p", parse_tolerant("reply"))
    greedy = parsed.filter(F.col("sample_idx") == 0).select(
        "qid", F.col("_p.think").alias("canonical_think"), F.col("_p.answer").alias("canonical_answer")
    )
    samples = nest_in_order(
        parsed.filter(F.col("sample_idx") > 0).select("qid", "sample_idx", F.col("_p.answer").alias("answer")),
        ["qid"], "sample_idx", "answer", "pool_answers",
    )
    return (
        problem_set.join(greedy, "qid")
        .join(samples, "qid", "left")
        .withColumn("pool_answers", F.coalesce("pool_answers", F.array().cast("array<string>")))
    )


def rollouts(problem_set: DataFrame, replies: DataFrame) -> DataFrame:
    """Candidate sets from replies ``(qid, sample_idx, reply)``; questions without replies are dropped."""
    named = problem_set.withColumn("qid", filled_question_id("qid", "query"))
    nested = nest_in_order(replies, ["qid"], "sample_idx", "reply", "candidates")
    fallback = [c for c in ("gold_answer", "answer") if c in problem_set.columns]
    return named.join(nested, "qid").select(
        "qid", "query", text_or_empty("user_prompt").alias("user_prompt"),
        first_non_empty(*fallback).alias("gold_answer"), "candidates",
    )


def evaluation_requests(questions: DataFrame, model: str, base_model: str,
                        prompts: PromptPack = DEFAULT_PROMPTS) -> DataFrame:
    """Greedy requests for the held-out set; the model name decides the system prompt."""
    return generation_requests(questions, system_prompt_for(F.lit(model), base_model, prompts), 0.0, 1.0, 1536)


def inference_rows(questions: DataFrame, replies: DataFrame) -> DataFrame:
    """Held-out questions with diagnostically parsed replies ``(qid, reply)``."""
    joined = questions.join(replies, "qid").withColumn("_p", parse_diagnostic("reply"))
    return joined.select(
        "qid", "query", text_or_empty("user_prompt").alias("user_prompt"),
        text_or_empty("answer").alias("gold_answer"), F.col("reply").alias("gen_text"),
        F.col("_p.think").alias("think"), F.col("_p.answer").alias("answer"),
        F.col("_p.format_ok").alias("format_ok"), F.col("_p.format_reason").alias("format_reason"),
    )
