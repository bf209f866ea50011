import json
import random

import pytest
from pyspark.sql import functions as F

from quillgate.functions.replies import DEFAULT_PROMPTS, score_key
from quillgate.functions.tags import parse_tolerant
from quillgate.operators import rewards, scorecard
from quillgate.operators.scores import observed_scores, repeat_scores
from quillgate.plans import evaluation, training_rows, upstream
from quillgate.schemas import ddl, schema
from quillgate.settings import DEFAULTS, GateSettings, RewardSettings, SplitSettings

POOL = [
    "仓库租金收了6万元，未超过8万元，可以免征这笔税。",
    "租金6万元在8万元以内，属于免征。",
]
PROMPT = "【参考问答对】出租仓库的季度租金未超过8万元的免征。【问题】收了6万元租金要不要交"
GOOD = ("题目里的租金是6万元，拿它同8万元那条线相比，没有超过，于是落到可以免征的一边；"
        "到此为止只用了题目给出的两个数，方向也没有变过。")


def wrap(think, answer):
    return f"<think>\n{think}\n</think>\n\n<answer>\n{answer}\n</answer>"


# ------------------------------------------------------------------ rewards


def reward_table(spark, texts, scores=None, rules=DEFAULTS.reward, pool=POOL):
    prompts = spark.createDataFrame([("q", PROMPT, json.dumps(pool, ensure_ascii=False))],
                                    "qid string, user_prompt string, v1_answers_json string")
    cands = spark.createDataFrame([("q", i, t, f"k{i}") for i, t in enumerate(texts)],
                                  "qid string, cand_idx int, text string, key string")
    out = rewards.candidate_rewards(cands, prompts, rules, scores)
    return {r.cand_idx: r for r in out.collect()}


def test_reward_order_and_values(spark):
    texts = [
        wrap(GOOD, POOL[0]),
        wrap(GOOD + " 顺手贴一张 <img src=y> 在后面。", POOL[0]),
        wrap(GOOD, "这要看房东怎么说，先打电话问一问吧。"),
        wrap(GOOD, "租金6万元，应缴税款，税率5%。"),
        "<think>写到一半就断了，后面什么也没写",
        "<think>" + GOOD + "</think>\n" + POOL[0],
        wrap("租金六万没有超过八万于是就免征。" * 12, POOL[0]),
        wrap("不够长", POOL[0]),
        wrap(GOOD + "长" * 3000, POOL[0]),
    ]
    got = reward_table(spark, texts)
    r = [got[i].reward for i in range(len(texts))]
    assert r[0] > r[1] > r[3] > r[4] and r[2] < 0 and r[3] < 0
    assert r[4] == r[5] == r[7] == -4.0 and r[3] == -3.0 and r[2] == -2.0
    assert r[0] == 1.0 and r[1] == 0.5
    assert r[6] == pytest.approx(1.0 - 0.8) and got[6].gate == "clean"
    over = len(GOOD) + 3000 - 2200
    assert r[8] == pytest.approx(1.0 - 0.8 - over / 1000 * 0.3, abs=1e-4)


def test_reward_with_judge(spark):
    scores = spark.createDataFrame([("k0", 8.0, 0.1, 2), ("k1", 10.0, 0.0, 2)],
                                   "key string, clean_score double, sd double, n bigint")
    texts = [wrap(GOOD, POOL[0]), wrap(GOOD + "参考资料", POOL[0])]
    got = reward_table(spark, texts, scores)
    assert got[0].reward == pytest.approx(1.0 + 0.4 * 0.8) and got[1].reward == 0.5
    third = [*texts, wrap(GOOD, POOL[1])]
    with pytest.raises(Exception, match="no judge score"):
        reward_table(spark, third, scores)
    lenient = reward_table(spark, third, scores, RewardSettings(judge_required=False))
    assert lenient[2].reward == 1.0


def test_reward_without_pool_fails_only_for_well_formed(spark):
    assert reward_table(spark, ["<think>标签不全"], pool=[])[0].reward == -4.0
    with pytest.raises(Exception, match="no answer pool"):
        reward_table(spark, [wrap(GOOD, POOL[0])], pool=[])


# ------------------------------------------------------------------ online prompts

VAGUE = ["这件事说不准。", "照着规矩来就好。"]
CONCRETE = [POOL[0]]
TRAIN_DDL = "qid string, query string, user_prompt string, split string, gold_answer string"
POOL_DDL = "qid string, canonical_answer string, gold_answer string, pool_answers array<string>"


def prompts_of(spark, train, pool, held=()):
    return training_rows.online_prompts(
        spark.createDataFrame(train, TRAIN_DDL),
        spark.createDataFrame([(q, c, g, a) for q, (c, g, a) in pool.items()], POOL_DDL),
        spark.createDataFrame([(q, None) for q in held], "qid string, query string"),
    ).collect()


def test_pool_merges_in_order(spark):
    rows = prompts_of(spark, [("q1", "问题", "题面", "train", POOL[0])],
                      {"q1": (POOL[0], POOL[1], ["租金6万元不到8万元，可以免税。"] * 2 + [""])})
    assert json.loads(rows[0].v1_answers_json) == [POOL[0], POOL[1], "租金6万元不到8万元，可以免税。"]
    assert rows[0].pool_size == 3 and [m.role for m in rows[0].messages] == ["system", "user"]


def test_untrainable_rows_are_skipped(spark):
    train = [("q1", "a", "u1", "train", "g"), ("q2", "b", "u2", "train", "g")]
    pools = {"q1": (None, None, VAGUE), "q2": (None, None, CONCRETE)}
    assert [r.qid for r in prompts_of(spark, train, pools)] == ["q2"]
    left = training_rows.untrainable(spark.createDataFrame(train, TRAIN_DDL), spark.createDataFrame(
        [(q, c, g, a) for q, (c, g, a) in pools.items()], POOL_DDL))
    assert [r.qid for r in left.collect()] == ["q1"]


def test_hard_failures(spark):
    one = [("q1", "a", "u", "train", "g")]
    with pytest.raises(ValueError, match="held-out"):
        prompts_of(spark, one, {"q1": (None, None, CONCRETE)}, held=["q1"])
    with pytest.raises(ValueError, match="without an answer pool"):
        prompts_of(spark, one, {"zz": (None, None, CONCRETE)})
    with pytest.raises(ValueError, match="no training prompt"):
        prompts_of(spark, one, {"q1": (None, None, VAGUE)})
    with pytest.raises(ValueError, match="held-out"):
        prompts_of(spark, [("q1", "a", "u", "eval", "g")], {})


# ------------------------------------------------------------------ evaluation


def inference(spark, rows):
    return spark.createDataFrame(rows, schema("inference"))


def scores_of(spark, rows):
    return spark.createDataFrame(rows, "qid string, clean_score double, n bigint")


def test_format_failure_and_missing_pool(spark):
    inf = inference(spark, [
        ("a", "测试题", PROMPT, "", "", "写了几句就停下来的推演", "", False, "missing_think_close+empty_answer"),
        ("b", "无池题", "题面", "", "", "一段推理", "一个答复", True, "ok"),
        (None, "无键题", "题面", "", "", " ", "答复", None, None),
        ("d", "题", "题面", "", "", "参考资料说", "应缴3%", None, ""),
    ])
    pool = spark.createDataFrame([("a", ["这笔要按3%来缴"]), ("d", ["税率3%，应缴"]), ("z", [])],
                                 "qid string, pool_answers array<string>")
    rows = {r.query: r for r in scorecard.score_rows(inf, pool, scores_of(spark, [("a", 4.0, 3), ("b", 6.0, 3)])).collect()}
    a = rows["测试题"]
    assert a.clean_score == 4.0 and not a.has_rag_style and not a.rule_pass and a.rule_forced_failure
    assert a.in_pool is False and a.answer_reason == "empty_answer"
    b = rows["无池题"]
    assert b.no_pool and b.in_pool is None and b.answer_reason == "no_pool" and b.rule_pass
    c = rows["无键题"]
    assert len(c.qid) == 12 and c.format_reason == "unmarked_empty" and not c.format_ok and c.clean_n == 0
    d = rows["题"]
    assert d.format_ok and d.format_reason == "ok" and d.has_rag_style and d.n_traces == 1 and d.in_pool
    assert set(a.asDict()) == set(schema("scores").names)


def scored_rows(spark, rows):
    return spark.createDataFrame(rows, ddl("scores"))


def scored(qid, clean=6.0, n=3, rule=True, ok=True, reason="ok", in_pool=True, comparable=True, why="ok", no_pool=False):
    return (qid, qid, clean, n, False, 0, rule, not ok, ok, reason, False, False, in_pool, comparable, why, [], no_pool)


def test_failed_judge_rows_do_not_drag_the_mean(spark):
    card = scorecard.scorecard(scored_rows(spark, [scored("a"), scored("b", None, 0)]), "t", DEFAULTS.gates,
                               DEFAULTS.noise).first()
    assert card.clean_mean == 6.0 and card.n == 2 and card.n_valid_judge == 1


def test_scorecard_counts(spark):
    rows = [scored("a"), scored("b", 4.0, 3, False, False, "empty_think"),
            scored("c", 2.0, 3, False, False, "empty_think"),
            scored("d", 5.0, 3, False, False, "", in_pool=False, why="empty_answer"),
            scored("e", in_pool=None, comparable=False, why="no_pool", no_pool=True),
            scored("f", in_pool=True, comparable=False, why="no_comparable_facts")]
    df = scored_rows(spark, rows)
    card = scorecard.scorecard(df, "t", DEFAULTS.gates, DEFAULTS.noise).first()
    assert (card.n, card.n_pool, card.n_no_pool, card.n_answer_comparable, card.n_answer_uncomparable) == (6, 5, 1, 4, 1)
    assert card.n_format_failure == 3 and card.format_failure_reasons == {"empty_think": 2, "unknown": 1}
    assert card.format_pass_rate == 0.5 and card.rule_pass_rate == 0.5
    assert card.in_pool_rate == 0.8 and card.in_pool_comparable_rate == 0.75 and card.n_empty_answer == 1
    assert card.clean_mean == pytest.approx((6 + 4 + 2 + 5 + 6 + 6) / 6, abs=1e-4)
    kept = scorecard.scorecard_without_format_failures(df, "t", DEFAULTS.gates, DEFAULTS.noise).first()
    assert kept.n == 3 and kept.format_failure_reasons == {}
    with pytest.raises(ValueError, match="below"):
        scorecard.check_stage_gate(scorecard.scorecard(df, "t", DEFAULTS.gates, DEFAULTS.noise), DEFAULTS.gates)
    scorecard.check_stage_gate(scorecard.scorecard(df, "t", DEFAULTS.gates, DEFAULTS.noise), GateSettings(in_pool_floor=0.5))


def test_empty_scorecard(spark):
    card = scorecard.scorecard(scored_rows(spark, []), "t", DEFAULTS.gates, DEFAULTS.noise).first()
    assert card.n == 0 and card.clean_mean is None and card.rule_pass_rate == 0.0


def test_compare_runs(spark):
    def card(tag, clean):
        return scorecard.scorecard(scored_rows(spark, [scored(str(i), clean) for i in range(500)]), tag,
                                   DEFAULTS.gates, DEFAULTS.noise)

    cards = card("a", 4.0).union(card("b", 4.1)).union(card("c", 4.2)).union(card("d", 3.0))
    verdict = lambda x, y: scorecard.compare_runs(cards, x, y, DEFAULTS.noise).first()
    assert verdict("a", "b").verdict == "tie" and verdict("a", "c").verdict == "up"
    assert verdict("a", "d").verdict == "down" and verdict("a", "b").threshold == pytest.approx(0.1484)


def test_run_evaluation_writes_products(spark, tmp_path):
    inf = inference(spark, [("a", "题", PROMPT, "", "", GOOD, POOL[0], True, "ok")])
    pool = spark.createDataFrame([("a", POOL)], "qid string, pool_answers array<string>")
    paths = {p: str(tmp_path / p) for p in ("scores", "report", "summary")}
    assert not evaluation.report_is_complete(spark, paths)
    with pytest.raises(ValueError, match="no valid judge score"):
        evaluation.run_evaluation(inf, pool, scores_of(spark, []), "t", paths)
    assert not evaluation.report_is_complete(spark, paths)
    card = evaluation.run_evaluation(inf, pool, scores_of(spark, [("a", 7.0, 3)]), "t", paths)
    assert card["clean_mean"] == 7.0 and evaluation.report_is_complete(spark, paths)
    assert evaluation.read_summary(spark, paths["summary"]).first().n == 1


# ------------------------------------------------------------------ upstream


def test_upstream_chain(spark):
    corpus = spark.createDataFrame(
        [("甲", "题甲"), ("乙", "题乙"), ("丙", " "), ("甲", "题甲二"), ("丁", "题丁")], "query string, user_prompt string")
    replies = spark.createDataFrame(
        [("甲", wrap("想甲", "答甲")), ("乙", "没有标签"), ("丙", wrap("a", "b")), ("丁", wrap("想丁", " "))],
        "query string, raw string")
    out = upstream.base_outputs(corpus, replies)
    assert upstream.empty_answer_count(out).first().n_empty_answer == 1
    ordered = out.withColumn("o", F.col("user_prompt"))
    rows = {r.query: r for r in upstream.clean_questions(ordered, "o").collect()}
    assert set(rows) == {"甲", "乙"} and rows["甲"].user_prompt == "题甲" and rows["乙"].answer == "没有标签"
    with pytest.raises(ValueError, match="not enough"):
        upstream.split_questions(ordered, "o", SplitSettings(n_eval=2))
    split = upstream.split_questions(ordered, "o", SplitSettings(n_eval=1))
    assert sorted(r.split for r in split.collect()) == ["eval", "train"]
    problems = upstream.problems(split)
    assert upstream.problems(split, "train").count() == 1 and problems.columns == schema("problems").names
    gen = spark.createDataFrame(
        [(rows["甲"].qid, i, wrap(f"t{i}", f"a{i}")) for i in range(4)], "qid string, sample_idx int, reply string")
    pool = upstream.answer_pool(problems, gen).first()
    assert pool.canonical_answer == "a0" and pool.pool_answers == ["a1", "a2", "a3"]
    rolled = upstream.rollouts(problems, gen).first()
    assert rolled.candidates == [wrap(f"t{i}", f"a{i}") for i in range(4)] and rolled.gold_answer == "答甲"
    left = upstream.base_requests(corpus, corpus.filter("query = '甲'")).collect()
    assert len(left) == 3 and left[0].system == DEFAULT_PROMPTS.retrieval_system
    evals = upstream.evaluation_requests(split, "dpo", "base").first()
    assert evals.system == DEFAULT_PROMPTS.neutral_system and evals.temperature == 0.0
    inf = upstream.inference_rows(split, gen.filter("sample_idx = 0")).first()
    assert inf.think == "t0" and inf.format_ok and inf.gold_answer == "答甲"


def test_blank_first_copy_does_not_win(spark):
    rows = spark.createDataFrame([(1, "q", "p", " ", "t"), (2, "q", "p", "a", "t")],
                                 "o int, query string, user_prompt string, answer string, reasoning string")
    assert upstream.clean_questions(rows, "o").first().answer == "a"


# ------------------------------------------------------------------ selection


def selection_fixture(spark):
    rng = random.Random(9)
    train, pool, rollouts = [], [], []
    for q in range(12):
        qid = f"q{q:02d}"
        train.append((qid, f"问{q}", PROMPT, f"免征，{q}万元", "" if q == 11 else f"资料显示 {q}", "train"))
        if q != 10:
            pool.append((qid, [f"免征，{q}万元", "可以，3%"]))
        cands = []
        for c in range(6):
            think = "" if c == 5 else f"想法{q}-{rng.randrange(3)}" + ("，参考资料" if rng.random() < 0.2 else "")
            cands.append(wrap(think, rng.choice([f"免征，{q}万元", "可以", "税率13%", "空话"])))
        rollouts.append((qid, f"问{q}", PROMPT, cands))
    return (
        spark.createDataFrame(rollouts, "qid string, query string, user_prompt string, candidates array<string>"),
        spark.createDataFrame(train, ddl("questions").replace("split", "split")),
        spark.createDataFrame(pool, "qid string, pool_answers array<string>"),
        rollouts, train, dict(pool),
    )


def score_for(key):
    """A made-up but fixed judge: the score depends on the key alone; some keys fail."""
    v = int(key[:4], 16)
    return None if v % 13 == 0 else round(v % 1000 / 100.0, 2)


def judge_table(spark, keys):
    obs = [(k, r, json.dumps({"clean_score": score_for(k)}) if score_for(k) is not None else "失败")
           for k in keys for r in range(2)]
    table = spark.createDataFrame(obs or [("none", 0, "")], "key string, rep int, raw_reply string")
    return repeat_scores(observed_scores(table))


def sigma(x):
    tiers = DEFAULTS.noise.tiers
    x = max(tiers[0][0], min(tiers[-1][0], x))
    for (x0, y0), (x1, y1) in zip(tiers, tiers[1:]):
        if x0 <= x <= x1:
            return y0 + (x - x0) / (x1 - x0) * (y1 - y0)


def test_selection_against_a_loop(spark):
    roll_df, train_df, pool_df, rollouts, train, pool = selection_fixture(spark)
    kept = training_rows.survivors(roll_df, train_df, pool_df)
    rows = kept.collect()
    base_of = {t[0]: (t[3], t[4]) for t in train}

    expected = {}
    for qid, _, _, cands in rollouts:
        answer, base = base_of[qid]
        good = []
        for i, text in enumerate(cands):
            think, ans = text.split("<think>\n")[1].split("\n</think>")[0], text.split("<answer>\n")[1].split("\n</")[0]
            allowed = {f"免征，{int(qid[1:])}万元", "可以", "空话"} if qid in pool else {"空话"}
            if base and think and ans in allowed and "参考资料" not in think:
                good.append((i, think))
        if good:
            expected[qid] = good
    got = {}
    for r in rows:
        got.setdefault(r.qid, []).append((r.cand_idx, r.think))
    assert {q: sorted(v) for q, v in got.items()} == expected
    assert "q11" not in got and len(expected) > 6
    long = roll_df.select("qid", "query", "user_prompt", F.posexplode("candidates").alias("cand_idx", "text"))
    same = training_rows.long_survivors(long, train_df, pool_df).select(kept.columns)
    assert sorted(map(str, same.collect())) == sorted(map(str, rows))

    best = training_rows.screened(kept, judge_table(spark, {r.screen_key for r in rows}))
    best_rows = {r.qid: r for r in best.collect()}
    by_key = {(r.qid, r.cand_idx): r for r in rows}
    for qid, good in expected.items():
        scored = [(score_for(by_key[qid, i].screen_key), -i) for i, _ in good]
        scored = [s for s in scored if s[0] is not None]
        assert (qid in best_rows) == bool(scored)
        if scored:
            assert best_rows[qid].cand_idx == -max(scored)[1]

    keys = {k for r in best_rows.values() for k in (r.select_key, r.base_key)}
    done = {r.qid: r for r in training_rows.confirmed(best, judge_table(spark, keys)).collect()}
    for qid, r in best_rows.items():
        c, d = score_for(r.select_key), score_for(r.base_key)
        want = c is not None and d is not None and c > d and c - d > 2 * (sigma(c) + sigma(d))
        assert done[qid].selected == want
        assert (done[qid].best_think is None) == (c is None or d is None)
    outcome = training_rows.confirmed(best, judge_table(spark, keys))
    everyone = training_rows.every_question(roll_df, outcome, train_df, kept).collect()
    assert len(everyone) == 12 and {r.qid: r.n_survivors for r in everyone if r.n_survivors} == {
        q: len(v) for q, v in expected.items()}

    forced = outcome.withColumn("best_think", F.coalesce("best_think", F.lit("x")))
    pairs = training_rows.pair_rows(forced)
    locked = pairs.select(parse_tolerant(F.element_at("messages", -1)["content"]).alias("c"),
                          parse_tolerant("rejected_response").alias("r"))
    assert locked.filter("c.answer != r.answer or c.answer = ''").isEmpty() and locked.filter("c.think = r.think").isEmpty()
    assert pairs.schema.simpleString() == schema("pair_rows").simpleString()


def test_row_shapes(spark):
    df = spark.createDataFrame([("题面", "问", "推理", "答案")], "user_prompt string, query string, think string, answer string")
    row = training_rows.sft_rows(df, "think").first()
    assert row.messages[-1].content.startswith("<think>") and [m.role for m in row.messages] == ["system", "user", "assistant"]
    assert "</think>" in row.messages[-1].content and "<answer>" in row.messages[-1].content


def test_rewrite_selection_and_funnel(spark):
    train = spark.createDataFrame([(f"q{i}", f"问{i}", PROMPT, "免征，9万元", "资料显示", "train") for i in range(6)],
                                  ddl("questions"))
    pool = spark.createDataFrame([(f"q{i}", ["可以免税"]) for i in range(5)], "qid string, pool_answers array<string>")
    texts = ["先看9万，所以免征", "参考资料说免征", "这样应缴", "先看线，免征吧", "还是免征的"]
    rewrites = spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(texts)], "qid string, natural string")
    gated = training_rows.rewrite_gates(train, pool, rewrites)
    gates = {r.qid: (r.rule_ok, r.facts_ok) for r in gated.collect()}
    assert gates == {"q0": (True, True), "q1": (False, False), "q2": (True, False), "q3": (True, True),
                     "q4": (True, True), "q5": (False, False)}
    keys = {r.qid: r for r in gated.collect()}

    def table(values):
        return spark.createDataFrame([(k, float(v), 0.0, 16) for k, v in values.items()],
                                     "key string, clean_score double, sd double, n bigint")

    quick = table({keys["q0"].screen_key: 7, keys["q0"].screen_base_key: 1, keys["q3"].screen_key: 1,
                   keys["q4"].screen_key: 7})
    full = table({keys["q0"].select_key: 7.3, keys["q0"].base_key: 0.03, keys["q4"].select_key: 1.2})
    results = training_rows.rewrite_results(gated, quick, full)
    got = {r.qid: (r.selected, r.score_clean) for r in results.collect()}
    assert got["q0"] == (True, 7.3) and got["q3"] == (False, None) and got["q4"] == (True, 1.2) and len(got) == 6
    funnel = training_rows.selection_funnel(results).first().asDict()
    assert funnel == {"n_rewritten": 5, "n_rule_blocked": 1, "n_facts_blocked": 1, "n_screened": 1, "n_eligible": 2}
    train_rows, eval_rows = training_rows.sft_train_and_eval(results)
    assert train_rows.count() == 1 and eval_rows.count() == 1
    asked = {r.qid: r for r in training_rows.rewrite_requests(train, pool).collect()}
    assert "结论方向" in asked["q0"].user and "免征，9万元" in asked["q5"].user


def test_judge_requests_are_distinct(spark):
    rows = spark.createDataFrame([("甲", "想")] * 5 + [("甲", "别的")], "references string, think string").withColumn(
        "key", score_key("v", "references", "think", 2))
    asked = training_rows.judge_requests(rows, "key", "think", 2)
    assert asked.count() == 2 and {r.k for r in asked.collect()} == {2}
