"""Pieces of DuckDB SQL that state the operators' definitions independently of Spark."""

from __future__ import annotations

from quillgate.settings import DEFAULTS

# Polarity terms, longest first and stable within a length.
TERMS = ["不征税", "应纳税", "需缴纳", "不可以", "不需要", "不超过", "不属于",
         "免征", "免税", "应缴", "不得", "无需", "可以", "允许", "禁止", "超过", "属于"]

DATE = r"[0-9]{4}\s*年(?:\s*[0-9]{1,2}\s*月)?(?:\s*[0-9]{1,2}\s*日)?"
VALUES = [
    r"[0-9]+(?:\.[0-9]+)?\s*%",
    r"万分之[零一二三四五六七八九十百点0-9]+|千分之[零一二三四五六七八九十百点0-9]+",
    r"[0-9][0-9,]*(?:\.[0-9]+)?\s*(?:万元|亿元|万|亿|元)",
    r"[0-9]+\s*(?:个)?(?:日|天|个月|月|年|季度)",
]


def terms(text: str, words: list[str], mask: str = "　") -> str:
    """List of words found, every hit masked before the next word."""
    tests, masked = [], text
    for word in words:
        tests.append(f"CASE WHEN contains({masked}, '{word}') THEN '{word}' END")
        masked = f"replace({masked}, '{word}', '{mask}')"
    return f"list_sort(list_filter([{', '.join(tests)}], lambda x: x IS NOT NULL))"


def values(text: str) -> str:
    masked = f"regexp_replace({text}, '{DATE}', ' ', 'g')"
    found = ", ".join(f"regexp_extract_all({masked}, '{p}')" for p in VALUES)
    clean = "replace(replace(regexp_replace(x, '[\\s,]+', '', 'g'), '万元', '万'), '亿元', '亿')"
    return f"list_sort(list_distinct(list_transform(flatten([{found}]), lambda x: {clean})))"


def dates(text: str) -> str:
    return (
        f"list_sort(list_distinct(list_transform(regexp_extract_all({text}, '{DATE}'), "
        "lambda x: regexp_replace(x, '\\s+', '', 'g'))))"
    )


def facts(text: str, prefix: str) -> str:
    t = f"translate({text}, '，：', ',:')"
    return f"{terms(t, TERMS)} AS {prefix}_pol, {values(t)} AS {prefix}_val, {dates(t)} AS {prefix}_date"


# Expects m_pol/m_val/m_date and p_pol/p_val/p_date.
DRIFT = (
    "list_sort(flatten([list_filter(m_pol, lambda x: NOT list_contains(p_pol, x)), "
    "list_filter(m_val, lambda x: NOT list_contains(p_val, x)), "
    "list_filter(m_date, lambda d: len(list_filter(p_date, lambda p: starts_with(d, p) OR starts_with(p, d))) = 0)]))"
)


def verdict(answer: str) -> str:
    """Columns in_pool, comparable, reason, drift from the fact columns."""
    m = "(len(m_pol) + len(m_val) + len(m_date) > 0)"
    p = "(len(p_pol) + len(p_val) + len(p_date) > 0)"
    empty = f"(trim({answer}) = '')"
    inside = f"(NOT {empty} AND len({DRIFT}) = 0)"
    return (
        f"{inside} AS in_pool, ({empty} OR ({m} AND {p})) AS comparable, "
        f"CASE WHEN {empty} THEN 'empty_answer' WHEN NOT {m} THEN CASE WHEN {p} THEN 'no_comparable_facts' "
        f"ELSE 'no_facts_in_either' END WHEN NOT {p} THEN 'v1_pool_has_no_facts' "
        f"WHEN NOT {inside} THEN 'introduced_new_fact' ELSE 'ok' END AS reason, {DRIFT} AS drift"
    )


NO_FACTS = "CAST([] AS VARCHAR[])"

# Style of the derived reasoning texts: the words that occur there, spelled out.
STYLE = (
    "regexp_matches({t}, '参考问答对|参考资料|参考内容|检索结果|资料(显示|表明|指出)|根据(检索|参考|提供的资料)"
    "|回答\\s*[:：]|小贴士|参考下图|如下图|您可以参考') "
    "OR regexp_matches({t}, '(?i)\\S+\\.(png|jpe?g|xlsx?|pdf)([^a-z0-9]|$)') "
    "OR contains({t}, '《甲办法》《乙办法》《丙办法》')"
)


def style(text: str) -> str:
    return "(" + STYLE.replace("{t}", text) + ")"


def parsed(text: str) -> str:
    """think, answer, format_reason of the diagnostic parse; tags are at most once in derived texts."""
    closed = f"contains({text}, '</think>')"
    tail = f"split_part({text}, '</think>', 2)"
    inner = f"CASE WHEN contains({tail}, '<answer>') THEN split_part({tail}, '<answer>', 2) ELSE {tail} END"
    think = f"trim(replace(split_part({text}, '</think>', 1), '<think>', ''), ' ' || chr(10))"
    answer = f"CASE WHEN {closed} THEN trim(replace({inner}, '</answer>', ''), ' ' || chr(10)) ELSE '' END"
    reason = (
        f"concat_ws('+', CASE WHEN NOT {closed} THEN 'missing_think_close' END, "
        f"CASE WHEN {think} = '' THEN 'empty_think' END, CASE WHEN ({answer}) = '' THEN 'empty_answer' END)"
    )
    return f"{think} AS p_think, {answer} AS p_answer, CASE WHEN {reason} = '' THEN 'ok' ELSE {reason} END AS p_reason"


def sigma(x: str) -> str:
    tiers = DEFAULTS.noise.tiers
    out = f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} <= {tiers[0][0]} THEN {tiers[0][1]}"
    for (x0, y0), (x1, y1) in zip(tiers, tiers[1:]):
        out += f" WHEN {x} <= {x1} THEN {y0} + ({x} - {x0}) / ({x1} - {x0}) * ({y1} - {y0})"
    return out + f" ELSE {tiers[-1][1]} END"


def clearly(a: str, b: str, n: float) -> str:
    return f"coalesce({a} - {b} > 0 AND {a} - {b} > {n} * (({sigma(a)}) + ({sigma(b)})), false)"


def error(n: str, k: int = 3) -> str:
    noise = DEFAULTS.noise
    return f"sqrt({noise.sigma_between ** 2!r} + {noise.sigma_judge ** 2!r} / {k}) / sqrt(greatest({n}, 1))"


def key(ref: str, think: str, k: int) -> str:
    nul = "chr(0)"
    return f"sha1('judge_v1' || {nul} || {ref} || {nul} || {think} || {nul} || '{k}' || {nul})"
