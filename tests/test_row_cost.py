"""What a row costs: triggers, facts in one Arrow pass, verdict fields, narrow picks."""

from __future__ import annotations

import unicodedata
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import functions as F

from quillgate.catalog import queries as q
from quillgate.catalog.derived import candidates, flagged, numbered, order_lines, worded
from quillgate.functions import facts, style
from quillgate.functions.style import ZH_STYLE
from quillgate.functions.text import fold_joined
from quillgate.operators import dedup

TRACES = [
    None, "", "先核对数量", "资料显示如此", "回答 ：好", "第 3 个参考", "亲，您好", "A.PNG 一栏", "见 HTTPS://x.aliyuncs/y",
    "政策依据：某文", "《甲办法》《乙办法》《丙办法》。", "《甲办法》规定按照执行；", "资料表明", "<IMG src", "逐条对照", "财税〔2016〕36号、财税〔2017〕1号、财税〔2018〕2号",
]


def untold(pack):
    """The pack without the words of its triggers: every pattern is tried on every text."""
    return replace(pack, categories=tuple(replace(c, words=None) for c in pack.categories), list_dump=replace(pack.list_dump, label_words=None))


def test_the_trigger_changes_no_style_result(spark):
    assert style.trigger(ZH_STYLE) and style.trigger(untold(ZH_STYLE)) is None
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(TRACES)], "i int, t string")

    def read(pack):
        return texts.select("i", style.has_trace("t", pack).alias("h"), style.trace_report("t", pack).alias("r")).orderBy("i").collect()

    assert read(ZH_STYLE) == read(untold(ZH_STYLE))
    assert [r.h for r in read(ZH_STYLE)].count(True) > 8


def test_a_text_without_a_trigger_is_settled_by_one_search(spark):
    plan = spark.range(1).select(F.lit("x").alias("t")).select(style.has_trace("t").alias("h"))._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan


def test_a_count_of_traces_is_that_of_the_full_report(spark):
    more = TRACES + ["参考资料与参考问答对，原始问答对", "如上文所示，如前述；对照参考资料", "哦~哦～亲,", "问答对 3，问答对三，问题 1：", "如上 文"]
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(more)], "i int, t string")
    told = texts.select("i", style.trace_report("t", untold(ZH_STYLE)).alias("r"), style.trace_report("t", ZH_STYLE, ("has_rag_style", "n")).alias("f"))
    rows = told.orderBy("i").collect()
    assert [(r.r.has_rag_style, r.r.n) for r in rows] == [tuple(r.f) for r in rows]
    assert max(r.f.n for r in rows) > 2


def test_patterns_are_led_by_plain_text():
    leads = {"参考资料": "参考资料", "如(?:上|前)述": "如", "哦[~～]": "哦", "ab?c": "a", "(?:逐条|依次)对照": "", "甲|乙": "", r"\\d+号": "", r"a\\(b|c\\)": "",
             "a[|]b": "", "(?:a(?:b|c)|d)": "", "甲{2}": "", r"第\\s*条": "第", "": ""}
    assert {p: style._lead(p) for p in leads} == leads


FACTS = [
    None, "", " ", "自２０２３年１月１日起免征，税率１３％", "不超过10万元可以，超过1,000.5 万元不得", "万分之五、3个月、2024 年", "不可以不属于应缴", "٣٤年 5年", "12万元", "千分之三\x1c%", "2024年5月 6日至2024年",
]


def test_facts_by_arrow_are_those_of_the_jvm(spark):
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(FACTS)], "i int, t string")
    # A back reference to an empty group is read by the JVM only.
    java = replace(facts.ZH_FACTS, date=facts.ZH_FACTS.date + r"()\1")
    both = texts.select("i", facts.extract_facts("t").alias("a"), facts.extract_facts("t", java).alias("j")).orderBy("i").collect()
    assert [r.a for r in both] == [r.j for r in both]
    assert both[3].a.date == ["2023年1月1日"] and both[4].a.polarity == ["不得", "不超过", "可以", "超过"]


def test_facts_need_one_arrow_pass_and_no_pattern_of_the_jvm(spark):
    rows = spark.createDataFrame([("a", "b")], "think string, answer string")
    plan = rows.select(style.has_trace("think").alias("h"), facts.extract_facts("answer").alias("f"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "regexp_extract_all(answer" not in plan


def test_a_verdict_holds_what_is_asked_for(spark):
    rows = spark.createDataFrame([("免征",)], "a string").withColumn("f", facts.extract_facts("a"))
    told = rows.select(facts.pool_verdict("a", F.col("f"), F.col("f"), ("in_pool",)).alias("v")).first().v
    assert told.asDict() == {"in_pool": True}


def test_the_first_line_is_picked_before_texts_are_made(spark):
    assert not {"think", "answer", "text"} & set(order_lines(spark, "/root/testdata/sf0.001").columns)
    made = q._inference(order_lines(spark, "/root/testdata/sf0.001"))
    assert "lineitem" not in str(made.inputFiles()) and "firsts" in str(made.inputFiles())
    assert made.count() == candidates(spark, "/root/testdata/sf0.001").select("qid").distinct().count()


def test_survivors_are_written_once_as_parquet(spark):
    kept = q.training_rows.long_survivors(*q._selection_inputs(spark, "/root/testdata/sf0.001"))
    assert kept.inputFiles() and all(f.endswith(".zstd.parquet") for f in kept.inputFiles())


def test_gates_and_penalties_share_one_python_stage(spark):
    cand, prompts = q._reward_inputs(spark, "/root/testdata/sf0.001")
    pooled = cand.select("qid", "cand_idx", "text", F.lit(True).alias("has_pool"), facts.no_facts().alias("pool_facts"))
    plan = q.rewards.reward_gates(pooled, q.DEFAULTS.reward)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_a_gate_reads_only_the_kinds_it_compares(spark):
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(FACTS)], "i int, t string")
    java = replace(facts.ZH_FACTS, date=facts.ZH_FACTS.date + r"()\1")
    for pack in (facts.ZH_FACTS, java):
        for kinds in (("polarity",), ("value", "date"), facts.KINDS):
            r = texts.select(facts.extract_facts("t", pack).alias("all"), facts.extract_facts("t", pack, kinds=kinds).alias("some"),
                             facts.facts_of_list(facts.listed_facts("t", pack, kinds), kinds).alias("listed")).collect()
            assert [{k: x.all[k] for k in kinds} for x in r] == [x.some.asDict() for x in r] == [x.listed.asDict() for x in r]


def test_rows_of_numbers_are_picked_by_hashing(spark):
    rows = spark.createDataFrame([("a", 2, 1, None), ("a", 1, 5, 6.5), ("b", 3, None, 1.0), (None, 1, 7, 2.0)], "k string, o int, n bigint, x double")
    first, last = dedup.first_per_key(rows, "k", "o"), dedup.last_per_key(rows, "k", "o")
    assert "SortAggregate" not in first._jdf.queryExecution().executedPlan().toString()
    assert first.columns == rows.columns
    assert {r.k: (r.o, r.n, r.x) for r in first.collect()} == {"a": (1, 5, 6.5), "b": (3, None, 1.0), None: (1, 7, 2.0)}
    assert {r.k: (r.o, r.n, r.x) for r in last.collect()} == {"a": (2, 1, None), "b": (3, None, 1.0), None: (1, 7, 2.0)}


def test_order_lines_keep_their_texts_through_numbers(spark):
    lines = order_lines(spark, "/root/testdata/sf0.001", dealt=False)
    again = flagged(numbered(lines))
    odd = spark.createDataFrame([("X", "F"), (None, None), ("", "O"), ("R", "o")], "l_returnflag string, l_linestatus string")
    assert [tuple(r) for r in flagged(numbered(odd)).collect()] == [(None, None), (None, None), (None, "O"), ("R", None)]
    assert worded(again).exceptAll(worded(lines)).count() == 0 and worded(lines).exceptAll(worded(again)).count() == 0


def test_both_waves_of_scores_meet_the_rewrites_in_one_join(spark):
    gated = spark.createDataFrame(
        [(f"q{i}", "q", "u", "a", "n", "b", "r", True, i != 3, f"s{i}", f"t{i}", f"s{i}", f"t{i}") for i in range(4)],
        "qid string, query string, user_prompt string, answer string, natural string, base_think string, references string, "
        "rule_ok boolean, facts_ok boolean, screen_key string, screen_base_key string, select_key string, base_key string")

    def wave(rows):  # both waves hold the same keys with other scores
        return spark.createDataFrame(rows, "key string, clean_score double, sd double, n bigint")

    quick = wave([("s0", 9.0, 0.0, 2), ("t0", 1.0, 0.0, 2), ("s1", 1.0, 0.0, 2), ("t1", 9.0, 0.0, 2), ("s2", 5.0, 0.0, 2), ("s3", 9.0, 0.0, 2), ("t3", 1.0, 0.0, 2)])
    full = wave([(k + str(i), v, 0.0, 16) for i in range(4) for k, v in (("s", 8.0), ("t", 0.5))])
    made = q.training_rows.rewrite_results(gated, quick, full)
    assert {r.qid: (r.score_clean, r.score_base, r.selected) for r in made.collect()} == {
        "q0": (8.0, 0.5, True), "q1": (None, None, False), "q2": (None, None, False), "q3": (None, None, False)}
    assert made._jdf.queryExecution().optimizedPlan().toString().count("_salt") <= 12
    assert {r.qid for r in q.training_rows.rewrite_screen(gated, quick).collect()} == {"q0"}


def test_scores_are_not_broadcast_for_a_small_file(spark):
    inference = q._inference(order_lines(spark, "/root/testdata/sf0.001", dealt=False))
    answers = q.sampled_answers(candidates(spark, "/root/testdata/sf0.001"))
    plan = q.scorecard.score_rows(inference, answers, q._eval_scores(inference))._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan


def test_texts_are_folded_together_as_one_by_one():
    texts = ["", "１，２", "ｶﾞ é ﬁ", "한　한", "ａ́", "先核对，数量", "①"]
    assert fold_joined("".join(texts), "").split("") == [unicodedata.normalize("NFKC", t) for t in texts]


def test_terms_are_found_in_the_joined_texts():
    plan = facts.masking_plan(facts.ZH_FACTS.polarity)
    texts = ["", "不超过10，超过", "不可以可以", "不属于", "\U00020000免征免征", "无", "需缴纳"]
    rows, terms = facts._polarity_hits(facts._ROW.join(texts), plan)
    assert sorted(set(zip(rows.tolist(), terms.to_pylist()))) == [
        (1, "不超过"), (1, "超过"), (2, "不可以"), (2, "可以"), (3, "不属于"), (4, "免征"), (6, "需缴纳")]


def test_dates_are_cut_out_where_they_were_found():
    date = facts._led(facts.ZH_FACTS.date)
    for text in ["", "无", "2024年", "自2024年5月6日至2025年 3月", "2023年2024年5%"]:
        assert facts._without(text, *facts._found([date], text)) == date.sub(" ", text)


def test_a_slice_of_texts_is_joined_and_its_own_separators_are_not():
    texts = pa.array(["x", "甲", f"乙{facts._ROW}丙", "", "丁"]).slice(1)
    assert facts._join(texts).split(facts._ROW) == ["甲", f"乙{facts.JOINER}丙", "", "丁"]
