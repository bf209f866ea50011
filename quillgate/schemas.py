"""Declared schemas of the tables that flow between the stages."""

from __future__ import annotations

from pyspark.sql.types import StructType

MESSAGES = "messages array<struct<role:string,content:string>>"

_DDL: dict[str, str] = {
    "raw_corpus": "query string, user_prompt string",
    "base_outputs": "query string, user_prompt string, raw string, reasoning string, answer string",
    "questions": "qid string, query string, user_prompt string, answer string, reasoning string, split string",
    "problems": "qid string, split string, query string, user_prompt string, gold_answer string",
    "answer_pool": (
        "qid string, split string, query string, user_prompt string, gold_answer string, "
        "canonical_think string, canonical_answer string, pool_answers array<string>"
    ),
    "rollouts": "qid string, query string, user_prompt string, gold_answer string, candidates array<string>",
    "sft_rows": f"{MESSAGES}, query string",
    "pair_rows": (
        f"{MESSAGES}, rejected_response string, query string, meta struct<score_clean:double,score_base:double>"
    ),
    "prompt_rows": (
        f"{MESSAGES}, qid string, query string, user_prompt string, gold_answer string, "
        "v1_answers_json string, pool_size int"
    ),
    "inference": (
        "qid string, query string, user_prompt string, gold_answer string, gen_text string, "
        "think string, answer string, format_ok boolean, format_reason string"
    ),
    "scores": (
        "qid string, query string, clean_score double, clean_n bigint, has_rag_style boolean, n_traces int, "
        "rule_pass boolean, rule_forced_failure boolean, format_ok boolean, format_reason string, "
        "empty_think boolean, empty_answer boolean, in_pool boolean, answer_comparable boolean, "
        "answer_reason string, drift_facts array<string>, no_pool boolean"
    ),
    "judge_observations": "key string, rep int, raw_reply string",
    "score_cache": "key string, clean_score double, sd double, n bigint",
    "generation_replies": "qid string, sample_idx int, reply string",
    "usage_log": (
        "seq bigint, ts timestamp, stage string, in_tokens bigint, out_tokens bigint, cache_hit boolean"
    ),
}


def schema(table: str) -> StructType:
    return StructType.fromDDL(_DDL[table])


def ddl(table: str) -> str:
    return _DDL[table]
