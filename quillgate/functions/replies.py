"""Request texts for the judge, the rewriter and the generator, and the judge's replies.

Models are never called from an executor: requests and replies are tables.
The prompt texts are parameters; the defaults ask for the same things in plain words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgate.functions.text import as_col, text_or_empty
from quillgate.settings import ClipSettings


@dataclass(frozen=True)
class PromptPack:
    """Prompts of a deployment.  Templates name their slots in braces."""

    retrieval_system: str = (
        "你是问答助手。请先阅读题目附带的参考问答对，再据此作答。"
        "推理写在 <think> </think> 中，答复写在 <answer> </answer> 中。"
    )
    neutral_system: str = (
        "你是税务助手。结论与数字只能来自已知资料，不得臆测；"
        "把依据融进自己的推导，不要罗列资料编号或检索字样。"
        "推理写在 <think> </think> 中，答复写在 <answer> </answer> 中。"
    )
    rewrite_system: str = (
        "从问题出发自己推导到给定结论，只输出第一人称的思考过程；"
        "数字与口径只当判断条件使用，不复述依据，不出现检索字样，不新增事实。"
    )
    rewrite_template: str = "【用户问题】\n{query}\n\n【事实依据】\n{reference}\n\n【结论与数字】\n{anchor}\n"
    judge_system: str = "给一段 think 打 0 到 10 的干净分：换词复述参考资料越少分越高。只输出 JSON。"
    judge_template: str = (
        "【参考资料】\n{reference}\n\n【think】\n{think}\n\n"
        '只输出 JSON：{"clean_score": 0到10的数字, "n_copied_est": 复述句数, "reason": "理由"}'
    )


DEFAULT_PROMPTS = PromptPack()


def system_prompt_for(model: Column | str, base_model: str, prompts: PromptPack) -> Column:
    """The base model (or no name at all) gets the retrieval prompt, every other one the neutral prompt."""
    name = as_col(model)
    plain = name.isNull() | name.isin("", base_model)
    return F.when(plain, prompts.retrieval_system).otherwise(prompts.neutral_system)


def fill_template(template: str, **slots: Column) -> Column:
    """Put columns into the braces of a template in a single left-to-right pass.

    Texts that themselves contain a slot name are left as they are.
    """
    pieces: list[Column] = []
    rest = template
    while True:
        found = [(rest.index("{%s}" % n), n) for n in slots if "{%s}" % n in rest]
        if not found:
            pieces.append(F.lit(rest))
            return F.concat(*pieces)
        at, name = min(found)
        pieces += [F.lit(rest[:at]), slots[name]]
        rest = rest[at + len(name) + 2:]


def clipped(value: Column | str, limit: int | None) -> Column:
    """The text, cut only if a caller asks for it."""
    return text_or_empty(value) if limit is None else F.substring(text_or_empty(value), 1, limit)


def judge_prompt(references: Column | str, think: Column | str, prompts: PromptPack, clip: ClipSettings) -> Column:
    return fill_template(
        prompts.judge_template,
        reference=clipped(references, clip.judge_reference),
        think=clipped(think, clip.judge_think),
    )


def rewrite_prompt(query: Column | str, references: Column | str, anchor: Column, prompts: PromptPack,
                   clip: ClipSettings) -> Column:
    return fill_template(
        prompts.rewrite_template,
        query=clipped(query, clip.rewrite_query),
        reference=clipped(references, clip.rewrite_reference),
        anchor=anchor,
    )


def score_key(version: str, references: Column | str, think: Column | str, k: Column | int) -> Column:
    """Cache key of a judged text: SHA-1 over version, references, think and k, each closed by NUL."""
    repeats = k if isinstance(k, Column) else F.lit(k)
    nul = F.lit("\x00")
    return F.sha1(
        F.concat(F.lit(version), nul, text_or_empty(references), nul, text_or_empty(think), nul,
                 repeats.cast("string"), nul)
    )


def judge_score(reply: Column | str) -> Column:
    """Score of one judge reply in [0, 10]; null when the reply holds none.

    The JSON object between the first and the last brace is read first; a bare
    ``"clean_score": number`` is the fallback.
    """
    text = text_or_empty(reply)
    body = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    # Of a repeated key the last value counts; true and false are numbers.
    read = F.from_json(body, "clean_score string")["clean_score"]
    strict = F.when(read == "true", 1.0).when(read == "false", 0.0).otherwise(read.try_cast("double"))
    loose = F.regexp_extract(text, r'(?U)"clean_score"\s*:\s*([0-9.]+)', 1).try_cast("double")
    score = F.coalesce(strict, loose)
    return F.when(score.isNotNull() & ~F.isnan(score), F.greatest(F.lit(0.0), F.least(F.lit(10.0), score)))
