"""Selection of training rows and their final shapes.

The answer of every row is the base model's own text; only the reasoning differs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgate.functions.facts import (
    FactPack,
    ZH_FACTS,
    anchor_text,
    extract_facts,
    merged_pool,
    no_facts,
    pool_is_trainable,
    pool_text,
)
from quillgate.functions.noise import clearly_cleaner, sigma_distance
from quillgate.functions.replies import DEFAULT_PROMPTS, PromptPack, clipped, judge_prompt, rewrite_prompt, score_key
from quillgate.functions.style import StylePack, ZH_STYLE, has_trace
from quillgate.functions.tags import references_of, wrap_completion
from quillgate.functions.text import as_col, filled_question_id, first_non_empty, strip, stripped, text_or_empty
from quillgate.operators.candidates import best_of, explode_candidates, gated_candidates, inside_pool, read_candidates
from quillgate.operators.joins import join_unique, with_leak_flag
from quillgate.operators.observed import Check, stored_if_sound
from quillgate.operators.pools import pool_targets
from quillgate.operators.ranking import gather_until, hold_out_every, shuffled_limit
from quillgate.operators.scores import require_select_k, with_scores
from quillgate.settings import DEFAULTS, Settings
from quillgate.sources.settle import stored

# ---------------------------------------------------------------- row shapes


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def _prompt_messages(user_prompt: Column | str, prompts: PromptPack) -> list[Column]:
    return [
        _message("system", F.lit(prompts.neutral_system)),
        _message("user", text_or_empty(user_prompt)),
    ]


def sft_rows(chosen: DataFrame, think: str, prompts: PromptPack = DEFAULT_PROMPTS) -> DataFrame:
    turns = [*_prompt_messages("user_prompt", prompts), _message("assistant", wrap_completion(think, "answer"))]
    return chosen.select(F.array(*turns).alias("messages"), "query")


def pair_rows(chosen: DataFrame, prompts: PromptPack = DEFAULT_PROMPTS) -> DataFrame:
    """Chosen in the last message, rejected beside it, both with the same answer."""
    turns = [
        *_prompt_messages("user_prompt", prompts),
        _message("assistant", wrap_completion("best_think", "answer")),
    ]
    return chosen.select(
        F.array(*turns).alias("messages"),
        wrap_completion("base_think", "answer").alias("rejected_response"),
        "query",
        F.struct("score_clean", "score_base").alias("meta"),
    )


def prompt_rows(rows: DataFrame, prompts: PromptPack = DEFAULT_PROMPTS) -> DataFrame:
    """Online prompts: no assistant turn; the pool travels along as JSON."""
    return rows.select(
        F.array(*_prompt_messages("user_prompt", prompts)).alias("messages"),
        "qid", "query", "user_prompt", "gold_answer",
        F.to_json("answers").alias("v1_answers_json"),
        F.size("answers").alias("pool_size"),
    )


# ---------------------------------------------------------------- best of K


def _base_side(train: DataFrame, pool: DataFrame, settings: Settings, facts: FactPack) -> DataFrame:
    """Per question: base reasoning, locked answer and the facts of its pool, read once."""
    targets = pool_targets(pool, facts).withColumnRenamed("facts", "pool_facts")
    base = train.select("qid", stripped("answer").alias("answer"), stripped("reasoning").alias("base_think"))
    return base.join(targets, "qid", "full_outer")


def survivors(rollouts: DataFrame, train: DataFrame, pool: DataFrame, settings: Settings = DEFAULTS,
              facts: FactPack = ZH_FACTS, style: StylePack = ZH_STYLE) -> DataFrame:
    """Candidates that pass the deterministic gates, with the score keys of their screening.

    The pool and the base row are joined to the question before its candidates are
    exploded: one shuffle on ``qid`` for all of them.  Questions without base reasoning
    are out.  ``train`` and ``pool`` are unique by ``qid``.
    """
    asked = rollouts.select(
        filled_question_id("qid", "query").alias("qid"), "query", "user_prompt", "candidates"
    )
    joined = _with_base(asked.join(_base_side(train, pool, settings, facts), "qid", "left"))
    return _keyed(gated_candidates(explode_candidates(joined), facts, style), settings)


def long_survivors(candidates: DataFrame, train: DataFrame, pool: DataFrame, settings: Settings = DEFAULTS,
                   facts: FactPack = ZH_FACTS, style: StylePack = ZH_STYLE) -> DataFrame:
    """The same for candidates in long form ``(qid, query, user_prompt, cand_idx, text)``.

    A question may have any number of candidates: hot ones are spread in the join.  Texts are read
    before the join, which moves only candidates that their own text does not stop; the questions'
    side of it is written first.
    """
    asked = candidates.select(
        filled_question_id("qid", "query").alias("qid"), "query", "user_prompt", "cand_idx", "text"
    )
    targets = stored(pool_targets(pool, facts), "pool-facts")
    base = stored(_base_side(train, targets, settings, facts), "base")
    read = read_candidates(asked, facts, style)
    return _keyed(inside_pool(_with_base(join_unique(read, base, "qid", count_from=asked.select("qid")))), settings)


def _with_base(joined: DataFrame) -> DataFrame:
    """Drop questions without base reasoning; a missing pool holds no facts."""
    return (
        joined.withColumn("pool_facts", F.coalesce("pool_facts", no_facts()))
        .withColumn("references", references_of("user_prompt"))
        .filter(F.coalesce("base_think", F.lit("")) != "")
    )


def _keyed(gated: DataFrame, settings: Settings) -> DataFrame:
    """Survivors with their score keys, which are made of their texts whenever they are read."""
    version, gates = settings.spend.cache_version, settings.gates
    screen_key = score_key(version, "references", "think", gates.k_screen)
    return gated.withColumns({"screen_key": screen_key, **_select_keys(settings)})


def _select_keys(settings: Settings) -> dict[str, Column]:
    version, gates = settings.spend.cache_version, settings.gates
    k_select = require_select_k(gates.k_select, gates.min_select_k)
    return {
        "select_key": score_key(version, "references", "think", k_select),
        "base_key": score_key(version, "references", "base_think", k_select),
    }


def screened(kept: DataFrame, screen_scores: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """The best surviving candidate of every question by its screening score.

    Scores meet the candidates' keys alone; the texts of the best are fetched afterwards, and
    ``select_key`` and ``base_key`` are made of them again rather than moved.
    """
    scored = with_scores(kept.select("qid", "cand_idx", "screen_key"), screen_scores, "screen_key")
    best = stored(best_of(scored, "qid", "clean_score", "cand_idx", []), "best").select(
        F.col("qid").alias("_qid"), F.col("cand_idx").alias("_idx"), F.col("clean_score").alias("screen_score"))
    texts = kept.select("qid", "cand_idx", "query", "user_prompt", "references", "answer", "base_think", "think")
    mine = F.col("qid").eqNullSafe(F.col("_qid")) & F.col("cand_idx").eqNullSafe(F.col("_idx"))
    # Of candidates that repeat a place one counts, as one score did.
    rows = texts.join(best, mine).drop("_qid", "_idx").dropDuplicates(["qid", "cand_idx"])
    others = [c for c in texts.columns if c not in ("qid", "cand_idx")]
    return rows.select("qid", "cand_idx", "screen_score", *others).withColumns(_select_keys(settings))


def survivor_counts(kept: DataFrame) -> DataFrame:
    return kept.groupBy("qid").agg(F.count("*").alias("n_survivors"))


def _found_scores(rows: DataFrame, scores: DataFrame, keys: dict[str, Column | str]) -> DataFrame:
    """``qid`` and the scores of several keys per question, named by ``keys``, with one join over
    ``(qid, side, key)`` rows."""
    sides = [F.struct(F.lit(i).alias("side"), as_col(k).alias("key")) for i, k in enumerate(keys.values())]
    long = rows.select("qid", F.explode(F.array(*sides)).alias("_r")).select("qid", "_r.*")
    return with_scores(long, scores).groupBy("qid").agg(
        *[F.max(F.when(F.col("side") == i, F.col("clean_score"))).alias(name) for i, name in enumerate(keys)]
    )


def _paired_scores(rows: DataFrame, scores: DataFrame, clean_key: str, base_key: str, names: tuple[str, str]) -> DataFrame:
    """Attach the scores of two keys per question."""
    return rows.join(_found_scores(rows, scores, dict(zip(names, (clean_key, base_key)))), "qid", "left")


def confirmed(best: DataFrame, select_scores: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Confirm the screened candidate against the base reasoning with full repeats.

    ``selected`` needs the error bands of both scores to be apart; ``sigma_bucket`` is 3
    for pairs that even pass three sigmas, 2 for the others that were selected.
    """
    both = _paired_scores(best, select_scores, "select_key", "base_key", ("score_clean", "score_base"))
    n_sigma, noise = settings.gates.n_sigma, settings.noise
    scored = F.col("score_clean").isNotNull() & F.col("score_base").isNotNull()
    return both.select(
        "qid", "query", "user_prompt", "answer", "base_think",
        F.when(scored, F.col("think")).alias("best_think"),
        F.when(scored, F.col("score_clean")).alias("score_clean"),
        F.when(scored, F.col("score_base")).alias("score_base"),
        clearly_cleaner("score_clean", "score_base", noise, n_sigma).alias("selected"),
        F.when(clearly_cleaner("score_clean", "score_base", noise, 3.0), 3)
        .when(clearly_cleaner("score_clean", "score_base", noise, n_sigma), 2).alias("sigma_bucket"),
        sigma_distance("score_clean", "score_base", noise).alias("sigma_distance"),
    )


def every_question(rollouts: DataFrame, outcome: DataFrame, train: DataFrame, kept: DataFrame) -> DataFrame:
    """One result row per rollout question, also for those that produced nothing."""
    base = train.select("qid", stripped("answer").alias("answer"), stripped("reasoning").alias("base_think"))
    asked = rollouts.select(filled_question_id("qid", "query").alias("qid"), "query", "user_prompt")
    picked = outcome.select("qid", "best_think", "score_clean", "score_base", "selected", "sigma_bucket")
    return (
        asked.join(base, "qid", "left")
        .join(picked, "qid", "left")
        .join(survivor_counts(kept), "qid", "left")
        .withColumns(
            {
                "answer": F.coalesce("answer", F.lit("")),
                "base_think": F.coalesce("base_think", F.lit("")),
                "selected": F.coalesce("selected", F.lit(False)),
                "n_survivors": F.coalesce("n_survivors", F.lit(0)),
            }
        )
    )


def judge_requests(rows: DataFrame, key: str, think: str, k: int, prompts: PromptPack = DEFAULT_PROMPTS,
                   settings: Settings = DEFAULTS) -> DataFrame:
    """Distinct judge requests for one text column of keyed rows."""
    return rows.select(
        F.col(key).alias("key"),
        F.lit(prompts.judge_system).alias("system"),
        judge_prompt("references", think, prompts, settings.clip).alias("user"),
        F.lit(k).alias("k"),
    ).dropDuplicates(["key"])


# ---------------------------------------------------------------- rewrites


def rewrite_requests(train: DataFrame, pool: DataFrame, settings: Settings = DEFAULTS,
                     prompts: PromptPack = DEFAULT_PROMPTS, facts: FactPack = ZH_FACTS) -> DataFrame:
    """Requests for a fresh reasoning: question, references, and the locked conclusion as an anchor."""
    anchors = pool_targets(pool, facts).select("qid", anchor_text(F.col("facts")).alias("_anchor"))
    fallback = clipped(stripped("answer"), settings.clip.anchor_fallback)
    return train.join(anchors, "qid", "left").select(
        "qid",
        F.lit(prompts.rewrite_system).alias("system"),
        rewrite_prompt(
            "query", references_of("user_prompt"), first_non_empty("_anchor", fallback), prompts, settings.clip
        ).alias("user"),
        F.lit(0.6).alias("temperature"), F.lit(0.9).alias("top_p"), F.lit(2048).alias("max_tokens"), F.lit(1).alias("n"),
    )


# The kinds of facts that the gate of a rewrite compares.
_GATED = ("polarity",)


def rewrite_gates(train: DataFrame, pool: DataFrame, rewrites: DataFrame, settings: Settings = DEFAULTS,
                  facts: FactPack = ZH_FACTS, style: StylePack = ZH_STYLE) -> DataFrame:
    """Rewrites with their deterministic gates and score keys; ``rewrites`` has ``qid, natural``.

    The fact gate compares polarity only: answer, base reasoning and pool together allow
    what the rewrite may conclude.  A question with no polarity at all passes.
    """
    version, gates = settings.spend.cache_version, settings.gates
    k_select = require_select_k(gates.k_select, gates.min_select_k)
    joined = (
        train.select("qid", "query", "user_prompt", "answer", "reasoning")
        .join(pool_targets(pool, facts, _GATED).select("qid", F.col("facts.polarity").alias("_pooled")), "qid", "left")
        .join(rewrites.select("qid", strip("natural").alias("natural")), "qid", "left")
        .withColumn("references", references_of("user_prompt"))
        .withColumn("base_think", stripped("reasoning"))
    )
    written = F.col("natural").isNotNull()
    read = joined.withColumn("rule_ok", written & ~has_trace("natural", style)).withColumns(
        {
            "_own": extract_facts(pool_text(F.array("answer", "reasoning")), facts, kinds=_GATED),
            "_written": extract_facts(F.when(F.col("rule_ok"), F.col("natural")), facts, kinds=_GATED),
        }
    )
    allowed = F.array_union("_own.polarity", F.coalesce("_pooled", F.array().cast("array<string>")))
    wrote = F.col("_written.polarity")
    facts_ok = F.col("rule_ok") & ((F.size(allowed) == 0) | (F.size(F.array_except(wrote, allowed)) == 0))
    # Written without the keys, which are made of the texts whenever they are read.
    told = ("qid", "query", "user_prompt", "answer", "natural", "base_think", "references", "rule_ok", "facts_ok")
    gated = stored(read.withColumn("facts_ok", facts_ok).select(*told), "rewritten")
    return gated.select(
        *told,
        score_key(version, "references", "natural", gates.k_screen).alias("screen_key"),
        score_key(version, "references", "base_think", gates.k_screen).alias("screen_base_key"),
        score_key(version, "references", "natural", k_select).alias("select_key"),
        score_key(version, "references", "base_think", k_select).alias("base_key"),
    )


def rewrite_screen(gated: DataFrame, screen_scores: DataFrame) -> DataFrame:
    """Rewrites that passed the gates and whose quick score beats the base reasoning."""
    both = _paired_scores(
        gated.filter("facts_ok"), screen_scores, "screen_key", "screen_base_key", ("quick_clean", "quick_base")
    )
    return both.filter(F.col("quick_clean") > F.col("quick_base"))


def rewrite_results(gated: DataFrame, screen_scores: DataFrame, select_scores: DataFrame,
                    settings: Settings = DEFAULTS) -> DataFrame:
    """Selection result of every rewrite, with the scores of those that got that far.

    Both waves' scores meet the rewrites in one join, each under its wave; those of the second
    count only for rewrites that pass the first (``rewrite_screen``).
    """

    def of(wave: int, key: str) -> Column:
        return F.concat(F.lit(f"{wave}:"), F.col(key))

    both = reduce(DataFrame.unionByName, [
        s.select(of(i, "key").alias("key"), "clean_score", "sd", "n") for i, s in enumerate((screen_scores, select_scores))
    ])
    keys = {
        "quick_clean": of(0, "screen_key"), "quick_base": of(0, "screen_base_key"),
        "_full_clean": of(1, "select_key"), "_full_base": of(1, "base_key"),
    }
    passed = F.col("quick_clean") > F.col("quick_base")
    scored = _found_scores(gated.filter("facts_ok"), both, keys).select(
        "qid", F.when(passed, F.col("_full_clean")).alias("score_clean"), F.when(passed, F.col("_full_base")).alias("score_base")
    )
    rows = gated.join(scored, "qid", "left")
    return rows.select(
        "qid", "query", "user_prompt", "answer", "natural",
        "rule_ok", "facts_ok", "score_clean", "score_base",
        clearly_cleaner("score_clean", "score_base", settings.noise, settings.gates.n_sigma).alias("selected"),
    )


def selection_funnel(results: DataFrame) -> DataFrame:
    """How many rewrites each gate stopped."""
    written = F.coalesce("natural", F.lit("")) != ""
    return results.agg(
        F.count_if(written).alias("n_rewritten"),
        F.count_if(written & ~F.col("rule_ok")).alias("n_rule_blocked"),
        F.count_if(F.col("rule_ok") & ~F.col("facts_ok")).alias("n_facts_blocked"),
        F.count_if(F.col("facts_ok") & F.col("score_clean").isNull()).alias("n_screened"),
        F.count_if(F.col("selected")).alias("n_eligible"),
    )


def until_target(results: DataFrame, target: int, settings: Settings = DEFAULTS) -> DataFrame:
    """Selected rows of the seeded-order chunks up to the one that reaches ``target`` of them."""
    split = settings.split
    return gather_until(results, "qid", "selected", target, split.gather_chunk, split.gather_seed).filter("selected")


def sft_train_and_eval(results: DataFrame, settings: Settings = DEFAULTS,
                       prompts: PromptPack = DEFAULT_PROMPTS) -> tuple[DataFrame, DataFrame]:
    """Selected rewrites as rows, every N-th question (in qid order) held out."""
    eligible = hold_out_every(results.filter("selected"), "qid", settings.targets.sft_eval_fraction)
    return (
        sft_rows(eligible.filter(~F.col("held_out")), "natural", prompts),
        sft_rows(eligible.filter("held_out"), "natural", prompts),
    )


# ---------------------------------------------------------------- online prompts


def merged_pools(pool: DataFrame, facts: FactPack = ZH_FACTS) -> DataFrame:
    """Canonical, gold and sampled answers of a question, and whether they hold any fact."""
    merged = pool.select(
        "qid", F.col("canonical_answer"), merged_pool("canonical_answer", "gold_answer", "pool_answers").alias("answers")
    )
    return merged.withColumn("trainable", pool_is_trainable(extract_facts(pool_text("answers"), facts)))


def marked_prompts(train: DataFrame, pool: DataFrame, held_out: DataFrame, facts: FactPack = ZH_FACTS) -> DataFrame:
    """Training questions with their merged pool and the flags ``leaked``, ``missing`` and ``kept``.

    A question has one pool; of several rows the trainable one counts.
    """
    gold = [c for c in ("gold_answer", "answer") if c in train.columns]
    usable = F.size("answers") > 0
    best = merged_pools(pool, facts).groupBy("qid").agg(
        F.max(F.struct("trainable", usable.alias("usable"), "answers", "canonical_answer")).alias("_pool")
    )
    found = with_leak_flag(train, held_out).join(best, "qid", "left")
    return found.select(
        "qid", text_or_empty("query").alias("query"), text_or_empty("user_prompt").alias("user_prompt"),
        first_non_empty(*gold, "_pool.canonical_answer").alias("gold_answer"), F.col("_pool.answers").alias("answers"), "leaked",
        (~F.coalesce("_pool.usable", F.lit(False))).alias("missing"), F.coalesce("_pool.trainable", F.lit(False)).alias("kept"),
    )


PROMPT_CHECKS = [
    Check("leaked", "training prompts contain held-out questions", 5),
    Check("missing", "training prompts without an answer pool", 8),
]


def online_prompts(train: DataFrame, pool: DataFrame, held_out: DataFrame, seed: int | None = 42, limit: int = 0,
                   prompts: PromptPack = DEFAULT_PROMPTS, facts: FactPack = ZH_FACTS) -> DataFrame:
    """Online prompt rows of trainable questions.

    A leaked question, a question without a pool, and an empty result are errors, checked
    in that order; questions whose pool holds no fact are left out.  The checks are counted by
    the job that writes the rows.
    """
    asked = train.withColumn("qid", filled_question_id("qid", "query"))
    if limit:
        asked = shuffled_limit(asked, "qid", limit, seed or 0)
    rows, seen = stored_if_sound(marked_prompts(asked, pool, held_out, facts), PROMPT_CHECKS, "qid", kept="kept")
    if not seen["kept"]:
        raise ValueError("no training prompt is left: no pool holds a comparable fact")
    return prompt_rows(rows.filter("kept").drop("leaked", "missing", "kept"), prompts)


def untrainable(train: DataFrame, pool: DataFrame, facts: FactPack = ZH_FACTS) -> DataFrame:
    """Questions left out because their pool holds no fact."""
    return train.join(merged_pools(pool, facts).filter(~F.col("trainable") & (F.size("answers") > 0)), "qid", "left_semi")
