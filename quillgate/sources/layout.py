"""Names and places of the tables of one run."""

from __future__ import annotations

from dataclasses import dataclass

# Table name to its place under the run folder.
TABLES = {
    "base_outputs": "00_base_outputs",
    "train": "01_train",
    "eval": "01_eval",
    "problems_all": "01_problems_all",
    "problems_train": "01_problems_train",
    "answer_pool": "02_answer_pool",
    "sft_train": "10_sft_train",
    "sft_eval": "10_sft_eval",
    "rft_samples": "20_rft_samples",
    "rft_train": "21_rft_train",
    "dpo_rollout": "30_dpo_rollout",
    "dpo_pairs": "31_dpo_pairs",
    "grpo_prompts": "40_grpo_prompts",
    "score_cache": "judge_score_cache",
    "usage_log": "judge_usage",
}


@dataclass(frozen=True)
class Layout:
    root: str

    def table(self, name: str) -> str:
        return f"{self.root}/{TABLES[name]}"

    def progress(self, stage: str) -> str:
        return f"{self.root}/progress_{stage}"

    def evaluation(self, tag: str) -> dict[str, str]:
        base = f"{self.root}/eval/{tag}"
        return {part: f"{base}_{part}" for part in ("infer", "scores", "report", "summary")}
