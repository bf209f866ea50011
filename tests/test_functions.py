import hashlib
import json
import random
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillgate.functions import facts, noise, penalties, replies, style, tags, text
from quillgate.settings import ClipSettings, DEFAULTS, NoiseSettings

N = DEFAULTS.noise


def test_spaces_are_those_of_python():
    assert sorted(text.SPACES) == sorted(chr(c) for c in range(0x110000) if chr(c).isspace())


def test_strip_and_key(ask):
    texts = ["  a b　\n", " \x1c", None, "", "小规模", "x"]
    got = ask(texts, s=text.stripped("t"), q=text.question_id("t"))
    for t, r in zip(texts, got):
        assert r["s"] == (t or "").strip()
        assert r["q"] == hashlib.sha1((t or "").encode()).hexdigest()[:12]


def test_nfkc_equals_unicodedata(ask):
    rng = random.Random(1)
    texts = ["１０万", "ＡＢＣ（）％", "㎏…ﬁ①½", "é ü", "①", "한글 한", "plain", "、。《》【】—“”", None,
             "ab", "ｶﾞ", "Ａ́"]
    texts += ["".join(chr(rng.choice([rng.randrange(0x20, 0x7F), rng.randrange(0x4E00, 0x9FFF),
                                      rng.randrange(0xFF01, 0xFFE0), rng.randrange(0x3000, 0x30FF),
                                      rng.randrange(0x2000, 0x2200)])) for _ in range(12)) for _ in range(200)]
    got = ask(texts, n=text.nfkc("t"))
    for t, r in zip(texts, got):
        assert r["n"] == unicodedata.normalize("NFKC", t or "")


def test_inert_characters_really_are_inert():
    keep = [*range(0x80), 0x2014, 0x2018, 0x2019, 0x201C, 0x201D, 0x3001, 0x3002, *range(0x3008, 0x3012),
            0x3014, 0x3015, *range(0x4E00, 0xA000), 0xE000]
    assert all(unicodedata.normalize("NFKC", chr(c)) == chr(c) and not unicodedata.combining(chr(c)) for c in keep)


TAGGED = [
    "<think>\n想法\n</think>\n\n<answer>\n回话\n</answer>",
    "<think>想到这里就停了",
    "<think>同一句话说了又说，一直说到写不下",
    "no tags at all",
    "<think>a</think>tail only",
    "<think>a</think><answer>x</answer>y<answer>z</answer>",
    "<think>a</think></answer>q<answer>z",
    "a<think>b</think>c</think><answer> d </answer>",
    "</think><answer></answer>",
    None,
    "",
    "<think> </think> <answer>ok</answer>",
    "x<think>y<think>z",
    "<answer>first</answer><think>t</think>",
]


def py_tolerant(raw):
    raw = raw or ""
    head, sep, tail = raw.partition("</think>")
    think = head.replace("<think>", "").strip() if sep else ""
    tail = tail if sep else raw
    before, opened, inner = tail.partition("<answer>")
    if opened and "</answer>" in inner:
        inner = inner.rpartition("</answer>")[0]
    span = inner if opened else tail
    return think, span.replace("<answer>", "").replace("</answer>", "").strip()


def test_tolerant_parse(ask):
    for raw, r in zip(TAGGED, ask(TAGGED, p=tags.parse_tolerant("t"))):
        assert (r["p"]["think"], r["p"]["answer"]) == py_tolerant(raw), raw


def test_diagnostic_parse(ask):
    got = [r["p"] for r in ask(TAGGED, p=tags.parse_diagnostic("t"))]
    assert got[0] == {"think": "想法", "answer": "回话", "format_ok": True, "format_reason": "ok"}
    assert got[2]["think"] == "同一句话说了又说，一直说到写不下"
    assert got[2]["answer"] == "" and got[2]["format_reason"] == "missing_think_close+empty_answer"
    assert got[3]["format_reason"] == "missing_think_close+empty_think+empty_answer"
    assert got[12]["think"] == "xy<think>z"
    for raw, p in zip(TAGGED, got):
        if raw and "</think>" in raw:
            assert (p["think"], p["answer"]) == py_tolerant(raw)
        else:
            assert p["answer"] == "" and not p["format_ok"]


def test_strict_tags(ask):
    good = tags.wrap_completion(F.lit("a"), F.lit("b"))
    got = ask(TAGGED, ok=tags.tags_in_order("t"), good=tags.tags_in_order(good))
    assert all(r["good"] for r in got)
    assert [r["ok"] for r in got] == [True, False, False, False, False, True, False, True, False, False, False, True,
                                      False, False]


def test_wrap_then_parse(ask):
    t = tags.wrap_completion(F.lit(" 推理 "), F.lit("\n答案"))
    r = ask(["x"], w=t, p=tags.parse_tolerant(t))[0]
    assert r["w"] == "<think>\n推理\n</think>\n\n<answer>\n答案\n</answer>"
    assert r["p"] == {"think": "推理", "answer": "答案"}


def test_references(ask):
    texts = ["【参考问答对】 参考 【问题】测试", "没有标记", "【参考问答对】只有开头", "【参考问答对】【问题】紧邻", None,
             "【问题】【参考问答对】甲【问题】乙"]
    got = [r["r"] for r in ask(texts, r=tags.references_of("t"))]
    assert got == ["参考", "", "只有开头", "【问题】紧邻", "", "甲"]


def test_completion_of_messages(spark):
    df = spark.sql(
        "select array(named_struct('role','user','content','u'), named_struct('role','assistant','content','a')) m "
        "union all select cast(array() as array<struct<role:string,content:string>>)"
    )
    assert sorted(r[0] for r in df.select(tags.completion_text("m")).collect()) == ["", "a"]


# ------------------------------------------------------------------ facts

POOL = [
    "仓库租金6万元，未超过8万元，免征。",
    "租金为6万元，可以按免税办理。",
    "收到6万元，无需缴纳。",
]


def test_fact_cases(ask):
    texts = ["租金不超过8万元", "8万元", "8万", "从2022年3月5日开始算", "无需缴纳", "１３％，共1,000元，30 天",
             "万分之五，千分之二点五，2023 年 1 月", "3个月，2季度，5年", None]
    got = [r["f"] for r in ask(texts, f=facts.extract_facts("t"))]
    assert got[0]["polarity"] == ["不超过"]
    assert got[1]["value"] == got[2]["value"] == ["8万"]
    assert got[3] == {"polarity": [], "value": [], "date": ["2022年3月5日"]}
    assert got[4]["polarity"] == ["需缴纳"]
    assert got[5]["value"] == sorted(["13%", "1000元", "30天"])
    assert got[6] == {"polarity": [], "value": sorted(["万分之五", "千分之二点五"]), "date": ["2023年1月"]}
    assert got[7]["value"] == sorted(["3个月", "2季度", "5年"])
    assert got[8] == {"polarity": [], "value": [], "date": []}


def test_masking_plan_equals_masking_everything():
    """Skipping masks that cannot matter never changes the terms found."""
    terms = facts.ZH_FACTS.polarity
    plan = facts.masking_plan(terms)
    rng = random.Random(3)
    for _ in range(3000):
        t = "".join(rng.choice(terms)[rng.randrange(0, 2):] for _ in range(rng.randrange(1, 7)))
        full, rest = set(), t
        for term in sorted(terms, key=len, reverse=True):
            if term in rest:
                full.add(term)
                rest = rest.replace(term, "　")
        short = set()
        for term, masks in plan:
            masked = t
            for m in masks:
                masked = masked.replace(m, "　")
            if term in masked:
                short.add(term)
        assert short == full, t


def test_masking_plan_for_nested_latin_terms():
    plan = dict(facts.masking_plan(("there", "the", "her", "ere")))
    assert plan["there"] == [] and plan["the"] == ["there"]


def verdicts(ask, answers, pool):
    pooled = facts.extract_facts(facts.pool_text(F.array(*[F.lit(p) for p in pool]) if pool else
                                                 F.array().cast("array<string>")))
    stage = {"m": facts.extract_facts("t"), "p": pooled}
    return [r["v"] for r in ask(answers, stage=stage, v=facts.pool_verdict("t", F.col("m"), F.col("p")))]


def test_pool_verdicts(ask):
    good, empty, blank, drift, vague = verdicts(
        ask, ["仓库租金6万元，免征。", "", " \n", "税率是13%，应缴。", "先看看再说。"], POOL)
    assert good["in_pool"] and good["comparable"] and good["reason"] == "ok"
    assert not empty["in_pool"] and empty["reason"] == "empty_answer" and empty["comparable"]
    assert blank["reason"] == "empty_answer"
    assert not drift["in_pool"] and "13%" in drift["drift_facts"] and drift["reason"] == "introduced_new_fact"
    assert vague["in_pool"] and not vague["comparable"] and vague["reason"] == "no_comparable_facts"


def test_date_granularity_and_factless_pool(ask):
    assert verdicts(ask, ["2022年开始免征。"], ["2022年3月5日开始免征。"])[0]["in_pool"]
    assert verdicts(ask, ["2022年3月5日开始免征。"], ["2022年开始免征。"])[0]["in_pool"]
    for v in verdicts(ask, ["去窗口问一问。", "说不准，得看情形。"], ["到时候再定。"]):
        assert not v["comparable"] and v["reason"] == "no_facts_in_either"
    v = verdicts(ask, ["税率13%", "空话"], [])
    assert v[0]["reason"] == "v1_pool_has_no_facts" and not v[0]["in_pool"]
    assert v[1]["in_pool"] and not v[1]["comparable"]


def test_pool_facts_in_one_pass_equal_union(ask):
    pool = ["免征10", "万元，2023", "年1月，不超", "过5%"]
    joined = facts.extract_facts(facts.pool_text(F.array(*[F.lit(p) for p in pool])))
    one = ask(["x"], f=joined)[0]["f"]
    each = [r["f"] for r in ask(pool, f=facts.extract_facts("t"))]
    for kind in ("polarity", "value", "date"):
        assert one[kind] == sorted({x for e in each for x in e[kind]})


def test_anchor_and_merged_pool(ask):
    pooled = facts.extract_facts(facts.pool_text(F.array(*[F.lit(p) for p in POOL])))
    r = ask(["x"], a=facts.anchor_text(pooled), e=facts.anchor_text(facts.extract_facts(F.lit("空话"))),
            m=facts.merged_pool(F.lit(" a "), F.lit(None).cast("string"), F.array(F.lit("b"), F.lit("a"), F.lit(" "))))[0]
    assert r["a"].split("\n")[0].endswith("、".join(sorted({"免征", "超过", "免税", "可以", "需缴纳"})))
    assert r["e"] == "" and r["m"] == ["a", "b"]


# ------------------------------------------------------------------ style

STYLE_CASES = [
    ("租金是6万，线划在8万，6万没到线，这一笔自然就不用交。", False),
    ("参考资料写着租金未超过8万元就免征。", True),
    ("照《房屋租赁办法》的说法，这种情形用5%，那就拿5%去算。", False),
    ("就这么定。\n政策依据：财税〔2018〕7号", True),
    ("数目在 SHEET9.JPG 那张图里", True),
    ("见 a.pngx 文件", False),
    ("列示如下：《甲办法》《乙办法》《丙办法》", True),
    ("列示如下：《甲申报表》《乙清单》《丙凭证》", False),
    ("《甲办法》。《乙办法》。财税〔2019〕13号", True),
    ("《甲办法》。《乙办法》", False),
    ("按照《甲办法》《乙办法》《丙办法》处理", True),
    ("问题１：怎么办", True),
    (None, False),
    ("", False),
]


def test_style_cases(ask):
    got = ask([t for t, _ in STYLE_CASES], h=style.has_trace("t"), r=style.trace_report("t"))
    for (t, expected), r in zip(STYLE_CASES, got):
        assert r["h"] is expected, t
        assert r["r"]["has_rag_style"] is expected, t
        assert r["r"]["n"] == len(r["r"]["spans"]) and (r["r"]["n"] > 0) is expected, t
    assert "A_检索装置腔" in got[1]["r"]["n_by_type"]
    assert got[3]["r"]["n_by_type"] == {"D_清单式甩文号": 1}
    assert got[6]["r"]["n_by_type"] == {"D_清单式甩文号": 3}


def test_contained_hits_count_once_and_documents_are_capped(ask):
    many = "列：" + "".join(f"《办法{i}》" for i in range(11))
    texts = ["https://x.aliyuncs.com/a.png", "您可以参考下图", many, "a参考资料"]
    got = [r["r"] for r in ask(texts, r=style.trace_report("t"))]
    assert got[0]["n"] == 1 and got[0]["spans"][0]["text"] == texts[0]
    assert [s["text"] for s in got[1]["spans"]] == ["您可以参考", "参考下图"]
    assert got[2]["n"] == 8 and got[2]["n_by_type"] == {"D_清单式甩文号": 11}
    assert got[3]["n"] == 1


def test_sentences(ask):
    assert ask(["甲。 乙！\n丙;；丁? "], s=text.sentences("t"))[0]["s"] == ["甲", "乙", "丙", "丁"]


# ------------------------------------------------------------------ penalties, noise, replies


def brute_penalty(t):
    compact = "".join((t or "").split())
    if len(compact) < 80:
        return 0.0
    total = 0.0
    for size, threshold, weight in DEFAULTS.reward.repeat_rules:
        grams = Counter(compact[i:i + size] for i in range(len(compact) - size + 1))
        if grams and max(grams.values()) >= threshold:
            total += weight
    return min(0.8, total)


def test_repeat_and_length_penalty(ask):
    rng = random.Random(5)
    texts = [None, "短", "租金六万没有超过八万于是就免征。" * 12, "ab" * 60, "abcdefgh" * 4 + "x" * 60, "长" * 3000, "长" * 9000]
    for _ in range(150):
        base = "".join(rng.choice("甲乙丙丁 \n") for _ in range(rng.randrange(20, 160)))
        texts.append(base * rng.randrange(1, 5))
    got = ask(texts, r=penalties.repeat_penalty("t", DEFAULTS.reward), l=penalties.length_penalty("t", DEFAULTS.reward))
    for t, r in zip(texts, got):
        assert r["r"] == pytest.approx(brute_penalty(t)), t
        over = len((t or "").strip()) - 2200
        assert r["l"] == pytest.approx(min(0.6, max(0, over) / 1000 * 0.3))


def test_gram_counts_match_brute_force(ask):
    rng = random.Random(6)
    texts = ["".join(rng.choice("abc") for _ in range(rng.randrange(0, 70))) for _ in range(80)]
    got = ask(texts, g=penalties.gram_counts("t", (5, 1, 2, 3, 8)))
    for t, r in zip(texts, got):
        for size, top in zip((5, 1, 2, 3, 8), r["g"]):
            grams = Counter(t[i:i + size] for i in range(len(t) - size + 1))
            assert top == max(grams.values(), default=0)


def test_noise_model(spark):
    def one(c):
        return spark.range(1).select(c.alias("v")).first()[0]

    s = lambda x: noise.sigma_of_score(F.lit(x), N)
    assert one(s(7.3)) == pytest.approx(1.63 + (7.3 - 4.64) / 2.7 * 0.22)
    assert one(s(-5.0)) == 0.0 and one(s(99.0)) == 1.85 and one(s(7.0)) > one(s(1.0))
    clear = lambda a, b: one(noise.clearly_cleaner(F.lit(a), F.lit(b), N, 2.0))
    assert clear(7.3, 0.03) and not clear(7.3, 7.0) and not clear(2.0, 7.0)
    assert one(noise.clearly_cleaner(F.lit(None).cast("double"), F.lit(1.0), N, 2.0)) is False
    se = lambda n, k: one(noise.mean_score_error(F.lit(n), k, N))
    assert se(500, 3) == pytest.approx(0.04946, abs=1e-5)
    assert (se(500, 3) - se(500, 16)) / se(500, 3) < 0.10 and se(2000, 3) < se(500, 3)
    assert one(noise.true_gain_threshold(F.lit(500), 3, N)) == pytest.approx(3 * se(500, 3))
    assert one(noise.rate_error(F.lit(0.49), F.lit(500))) == pytest.approx(0.02236, abs=1e-4)


def test_tiers_must_ascend():
    with pytest.raises(ValueError):
        NoiseSettings(tiers=((1.0, 0.1), (0.0, 0.2)))


def test_judge_replies(ask):
    texts = ['{"clean_score": 7.5}', '好的 {"clean_score": 12, "reason": "x"} 完', '{"clean_score": -1}',
             'broken {"clean_score": 3.5, ', "no score", None, '{"clean_score": null}', '{"clean_score": "6"}',
             '{"other": 1}', '{"clean_score": "NaN"}', '{"clean_score": 3, "clean_score": 8}', '{"clean_score": true}']
    got = [r["s"] for r in ask(texts, s=replies.judge_score("t"))]
    assert got == [7.5, 10.0, 0.0, 3.5, None, None, None, 6.0, None, None, 8.0, 1.0]


def test_score_key_and_prompts(ask):
    k = replies.score_key("v", F.lit("参考"), F.lit("想"), 16)
    p = replies.judge_prompt(F.lit("R" * 5000 + "{think}"), F.lit("T{reference}"), replies.DEFAULT_PROMPTS, ClipSettings(judge_reference=3500))
    whole = replies.judge_prompt(F.lit("R" * 5000), F.lit("T" * 5000), replies.DEFAULT_PROMPTS, DEFAULTS.clip)
    names = F.when(F.col("t") == "none", None).otherwise(F.col("t"))
    got = ask(["base", "", "none", "dpo"], k=k, p=p, w=whole,
              s=replies.system_prompt_for(names, "base", replies.DEFAULT_PROMPTS))
    assert got[0]["k"] == hashlib.sha1("v\0参考\0想\0".encode() + b"16\0").hexdigest()
    assert "R" * 3500 in got[0]["p"] and "R" * 3501 not in got[0]["p"] and "T{reference}" in got[0]["p"]
    assert "R" * 5000 in got[0]["w"] and "T" * 5000 in got[0]["w"]
    retrieval, neutral = replies.DEFAULT_PROMPTS.retrieval_system, replies.DEFAULT_PROMPTS.neutral_system
    assert [r["s"] for r in got] == [retrieval, retrieval, retrieval, neutral]


def test_json_round_trip_of_a_pool(spark):
    from quillgate.operators.rewards import decoded_pool

    rows = [(json.dumps(["甲", " ", "乙"], ensure_ascii=False),), ("一条答案",), ("",), (None,), ("[坏",)]
    df = spark.createDataFrame(rows, "p string").coalesce(1)
    assert [r[0] for r in df.select(decoded_pool("p")).collect()] == [["甲", "乙"], ["一条答案"], [], [], ["[坏"]]
