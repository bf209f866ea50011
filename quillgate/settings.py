"""Typed defaults for every stage.

All values are plain numbers a caller may override; nothing is read from the
environment.  The numbers are fixed values that results depend on.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class SplitSettings:
    n_eval: int = 500
    split_seed: int = 42
    gather_seed: int = 42
    gather_chunk: int = 48


@dataclass(frozen=True)
class GateSettings:
    n_sigma: float = 2.0
    k_screen: int = 2
    k_select: int = 16
    k_eval: int = 3
    in_pool_floor: float = 0.85
    min_select_k: int = 16


@dataclass(frozen=True)
class NoiseSettings:
    """Calibration tiers (mean, sigma) from dirty to clean, plus the two noise terms."""

    tiers: tuple[tuple[float, float], ...] = (
        (0.00, 0.00),
        (0.03, 0.06),
        (1.84, 0.17),
        (2.64, 0.60),
        (4.64, 1.63),
        (7.34, 1.85),
    )
    sigma_judge: float = 0.74
    sigma_between: float = 1.02

    def __post_init__(self):
        means = [m for m, _ in self.tiers]
        if not means or means != sorted(means):
            raise ValueError("calibration tiers must be listed with ascending means")


@dataclass(frozen=True)
class RewardSettings:
    format_fail: float = -4.0
    answer_out_of_pool: float = -3.0
    answer_not_comparable: float = -2.0
    rule_fail_base: float = 0.50
    rule_pass_base: float = 1.00
    rule_pass_judge_weight: float = 0.40
    think_min_chars: int = 40
    think_max_chars: int = 2200
    strict_tags: bool = True
    judge_required: bool = True
    # (characters per gram, repeats that trigger, deduction)
    repeat_rules: tuple[tuple[int, int, float], ...] = ((8, 5, 0.35), (12, 4, 0.35), (20, 3, 0.25))
    repeat_cap: float = 0.8
    repeat_min_chars: int = 80
    length_rate_per_1k: float = 0.3
    length_cap: float = 0.6


@dataclass(frozen=True)
class SpendSettings:
    price_in_per_million: float = 6.5
    price_out_per_million: float = 27.0
    budget: float = 0.0
    warn_fraction: float = 0.8
    cache_min_k: int = 16
    cache_version: str = "judge_v1"


@dataclass(frozen=True)
class TargetSettings:
    sft: int = 700
    rft: int = 200
    dpo: int = 900
    sft_eval_fraction: float = 0.10


@dataclass(frozen=True)
class ClipSettings:
    """Character limits applied before text enters a request; none unless a deployment sets them."""

    judge_reference: int | None = None
    judge_think: int | None = None
    rewrite_reference: int | None = None
    rewrite_query: int | None = None
    anchor_fallback: int | None = None


@dataclass(frozen=True)
class Settings:
    split: SplitSettings = field(default_factory=SplitSettings)
    gates: GateSettings = field(default_factory=GateSettings)
    noise: NoiseSettings = field(default_factory=NoiseSettings)
    reward: RewardSettings = field(default_factory=RewardSettings)
    spend: SpendSettings = field(default_factory=SpendSettings)
    targets: TargetSettings = field(default_factory=TargetSettings)
    clip: ClipSettings = field(default_factory=ClipSettings)


DEFAULTS = Settings()
