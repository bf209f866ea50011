import hashlib
import math
import random
import statistics
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quillgate.operators import calibrate, candidates, dedup, joins, ledger, ranking, scores
from quillgate.settings import DEFAULTS, SpendSettings


def md5(seed, key):
    return hashlib.md5(f"{seed}:{key}".encode()).hexdigest()


def test_first_and_last_per_key_with_a_hot_key(spark):
    rng = random.Random(2)
    rows = [(i, "hot" if i % 3 == 0 else f"k{rng.randrange(40)}", f"v{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "o int, k string, v string").repartition(7)
    first, last = {}, {}
    for o, k, v in rows:
        first.setdefault(k, v)
        last[k] = v
    assert {r.k: r.v for r in dedup.first_per_key(df, "k", "o").collect()} == first
    assert {r.k: r.v for r in dedup.last_per_key(df, "k", "o").collect()} == last
    loose = df.union(spark.createDataFrame([(9001, None, "x"), (9002, "", "y")], df.schema))
    assert {r.k: r.v for r in dedup.index_by(loose, "k", "o").collect()} == last


@pytest.mark.parametrize("n_eval", [1, 37, 500])
def test_split_is_fixed_count_and_disjoint(spark, n_eval):
    df = spark.range(900).select(F.sha1(F.col("id").cast("string")).alias("qid"))
    rows = ranking.fixed_count_split(df, "qid", n_eval, 42).collect()
    chosen = {r.qid for r in rows if r.split == "eval"}
    ids = sorted((md5(42, r.qid), r.qid) for r in rows)
    assert len(rows) == 900 and chosen == {q for _, q in ids[:n_eval]}


def test_split_larger_than_the_table_takes_all(spark):
    rows = ranking.fixed_count_split(spark.range(5), "id", 50).collect()
    assert {r.split for r in rows} == {"eval"}


def test_shuffled_limit_and_global_rank(spark):
    df = spark.range(300).withColumn("h", F.md5(F.col("id").cast("string")))
    want = sorted(range(300), key=lambda i: md5(7, i))[:25]
    assert {r.id for r in ranking.shuffled_limit(df, "id", 25, 7).collect()} == set(want)
    ranks = {r.id: r["rank"] for r in ranking.global_rank(df, "h").collect()}
    order = sorted(range(300), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    assert ranks == {i: n + 1 for n, i in enumerate(order)}


@pytest.mark.parametrize("fraction,every", [(0.1, 10), (0.9, 2), (0.3, 3)])
def test_hold_out(spark, fraction, every):
    df = spark.range(101).select(F.substring(F.sha1(F.col("id").cast("string")), 1, 12).alias("qid"))
    rows = ranking.hold_out_every(df, "qid", fraction).collect()
    order = sorted(r.qid for r in rows)
    assert {r.qid for r in rows if r.held_out} == set(order[::every])
    assert not any(r.held_out for r in ranking.hold_out_every(df, "qid", 0).collect())


def test_order_is_that_of_the_key_itself(spark):
    keys = ["q1", "q2", "a1", "10", "9", "zz", "", "B7", None]
    df = spark.createDataFrame([(k,) for k in keys], "qid string")
    rows = ranking.hold_out_every(df, "qid", 0.3).collect()
    order = [None, *sorted(k for k in keys if k is not None)]
    assert len(rows) == 9 and {r.qid for r in rows if r.held_out} == set(order[::3])
    for n in (1, 4):
        assert sum(r.split == "eval" for r in ranking.fixed_count_split(df, "qid", n).collect()) == n
        assert ranking.shuffled_limit(df, "qid", n).count() == n
    picked = df.withColumn("sel", F.lit(True))
    assert ranking.gather_until(picked, "qid", "sel", 9, 1).count() == 9


@pytest.mark.parametrize("target,chunk", [(0, 48), (1, 48), (30, 48), (30, 7), (10_000, 48), (140, 1)])
def test_gather_until_equals_a_chunk_loop(spark, target, chunk):
    items = [(i, i % 5 == 0) for i in range(700)]
    df = spark.createDataFrame(items, "id int, sel boolean")
    order = sorted(items, key=lambda r: md5(42, r[0]))
    kept = []
    for start in range(0, len(order), chunk):
        kept += order[start:start + chunk]
        if target and sum(s for _, s in kept) >= target:
            break
    got = ranking.gather_until(df, "id", "sel", target, chunk).collect()
    assert {r.id for r in got} == {i for i, _ in kept}
    if target == 30:
        assert ranking.gather_until(df, "id", "sel", 30, chunk, already=30).isEmpty()


def test_running_totals_with_a_hot_first_column(spark):
    rows = [(0 if i % 3 else i, i, i % 11) for i in range(2000)]
    df = spark.createDataFrame(rows, "day int, seq int, v int")
    got = {r.seq: r.s for r in ranking.running_totals(df, ["day", "seq"], {"s": "v"}, partitions=6).collect()}
    total, want = 0, {}
    for day, seq, v in sorted(rows):
        total += v
        want[seq] = total
    assert got == want


def test_join_unique_spreads_hot_keys_without_changing_the_result(spark):
    rows = [("hot" if i % 2 else f"k{i % 50}", i) for i in range(4000)] + [(None, -1), ("absent", -2)]
    left = spark.createDataFrame(rows, "k string, i int")
    right = spark.createDataFrame([(f"k{i}", i * 10) for i in range(50)] + [("hot", 7)], "k string, v int")
    hot = joins.hot_keys(left, "k", 100).collect()
    assert [(r.k, r._copies) for r in hot] == [("hot", 20)]
    table = {f"k{i}": i * 10 for i in range(50)} | {"hot": 7}
    got = sorted((r.i, r.k, r.v) for r in joins.join_unique(left, right, "k", min_rows=100).collect())
    assert got == sorted((i, k, table.get(k)) for k, i in rows)
    inner = joins.join_unique(left, right, "k", how="inner", min_rows=100)
    assert inner.count() == 4000


def test_repeat_scores(spark):
    rows = [("a", 7.0), ("a", 8.0), ("a", None), ("b", 3.0), ("c", None), ("c", None)]
    got = {r.key: (r.clean_score, r.sd, r.n) for r in
           scores.repeat_scores(spark.createDataFrame(rows, "key string, score double")).collect()}
    assert got["a"] == (7.5, pytest.approx(statistics.stdev([7.0, 8.0])), 2)
    assert got["b"] == (3.0, 0.0, 1) and got["c"] == (None, 0.0, 0)


def test_cache_admission_and_requests(spark):
    made = spark.createDataFrame([("a", 7.0, 0.1, 16), ("b", 6.0, 0.1, 15), ("c", None, 0.0, 0)],
                                 "key string, clean_score double, sd double, n bigint")
    assert [r.key for r in scores.admitted_to_cache(made, 16, 16).collect()] == ["a"]
    assert scores.admitted_to_cache(made, 2, 16).isEmpty()
    cache = spark.createDataFrame([("a", 1.0, 0.0, 16)], made.schema)
    assert [(r.key, r.clean_score) for r in scores.update_cache(cache, made.limit(1)).collect()] == [("a", 1.0)]
    asked = spark.createDataFrame([("a",), ("x",), ("x",)], "key string")
    assert [r.key for r in scores.requests_to_send(asked, cache).collect()] == ["x"]
    found = {r.key: r.n for r in scores.with_scores(asked, cache).collect()}
    assert found == {"a": 16, "x": 0}
    with pytest.raises(ValueError):
        scores.require_select_k(15)


def test_best_of_takes_the_first_maximum(spark):
    rows = [("q", 0, 1.0), ("q", 1, 5.0), ("q", 2, 5.0), ("q", 3, None), ("r", 0, None)]
    df = spark.createDataFrame(rows, "qid string, cand_idx int, s double").withColumn("t", F.col("cand_idx") * 10)
    assert [(r.qid, r.cand_idx, r.t) for r in candidates.best_of(df, "qid", "s", "cand_idx", ["t"]).collect()] == [
        ("q", 1, 10)]


def test_nest_in_order_keeps_every_candidate(spark):
    rows = [("q", i, f"v{i}") for i in range(3000)] + [("r", 0, "x")]
    df = spark.createDataFrame(rows, "qid string, i int, v string").repartition(5)
    nested = candidates.nest_in_order(df, ["qid"], "i", "v", "candidates")
    got = {r.qid: r.candidates for r in nested.collect()}
    assert got == {"q": [f"v{i}" for i in range(3000)], "r": ["x"]}
    long = candidates.explode_candidates(nested).filter("qid = 'q'").collect()
    assert {(r.cand_idx, r.text) for r in long} == {(i, f"v{i}") for i in range(3000)}
    back = candidates.explode_candidates(df.groupBy("qid").agg(F.collect_list("v").alias("candidates")))
    assert back.count() == 3001 and back.columns == ["qid", "cand_idx", "text"]


@pytest.mark.parametrize("ddof", [0, 1])
def test_group_advantage(spark, ddof):
    groups = {"a": [1.30, 1.20, 0.50, -3.00], "b": [1.0, 1.0], "c": [2.0]}
    df = spark.createDataFrame([(k, i, v) for k, vs in groups.items() for i, v in enumerate(vs)],
                               "qid string, i int, reward double")
    got = {(r.qid, r.i): r.advantage for r in candidates.group_advantage(df, ddof=ddof).collect()}
    sd = statistics.stdev(groups["a"]) if ddof else statistics.pstdev(groups["a"])
    assert sd == pytest.approx(2.031 if ddof else 1.759, abs=1e-3)
    for i, v in enumerate(groups["a"]):
        assert got["a", i] == pytest.approx(v / sd)
    assert got["b", 0] == got["b", 1] == got["c", 0] == 0.0


def test_calibration_fit(spark):
    rng = random.Random(4)
    rows = [(t, f"{t}-{i}", rng.gauss(t * 2, 0.5)) for t in range(4) for i in range(5) for _ in range(6)]
    df = spark.createDataFrame(rows, "tier int, item string, score double")
    by_tier, by_item = defaultdict(list), defaultdict(list)
    for t, i, s in rows:
        by_tier[t].append(s)
        by_item[i].append(s)
    tiers = calibrate.fit_tiers(df, "tier", "score")
    fit = {r.tier: r for r in tiers.collect()}
    for t, vs in by_tier.items():
        assert fit[t]["mean"] == pytest.approx(statistics.mean(vs))
        assert fit[t].sigma == pytest.approx(statistics.stdev(vs)) and fit[t].n == 30
    parts = calibrate.variance_parts(df, "item", "score").first()
    judge = statistics.mean(statistics.variance(v) for v in by_item.values())
    between = statistics.variance(statistics.mean(v) for v in by_item.values()) - judge / 6
    assert parts.judge_var == pytest.approx(judge) and parts.between_var == pytest.approx(between)
    pairs = calibrate.tier_separability(tiers, "tier").collect()
    assert len(pairs) == 6
    for p in pairs:
        a, b = fit[p.tier_a], fit[p.tier_b]
        assert p.distance == pytest.approx(abs(a["mean"] - b["mean"]) / (a.sigma + b.sigma))
        assert p.separable == (p.distance > 3)
    with pytest.raises(ValueError, match="more than 3 tiers"):
        calibrate.tier_separability(tiers, "tier", most_tiers=3)
    assert calibrate.tier_separability(tiers.limit(0), "tier").count() == 0


def test_rank_correlation_with_ties(spark):
    import pandas as pd

    rng = random.Random(8)
    rows = [(rng.randrange(6), round(rng.random() * 9, 1)) for _ in range(400)]
    got = calibrate.rank_correlation(spark.createDataFrame(rows, "x int, y double"), "x", "y").first()[0]
    frame = pd.DataFrame(rows, columns=["x", "y"])
    assert got == pytest.approx(frame.x.rank().corr(frame.y.rank()))


def test_ledger(spark):
    rows = [(i, "judge" if i % 4 else "rewrite", 1000 + i, 10 * i, i % 9 == 0) for i in range(300)]
    log = spark.createDataFrame(rows, "seq bigint, stage string, in_tokens bigint, out_tokens bigint, cache_hit boolean")
    prices = SpendSettings(budget=5.0)
    total = ledger.usage_totals(log, prices).first()
    tin, tout = sum(r[2] for r in rows), sum(r[3] for r in rows)
    money = tin / 1e6 * 6.5 + tout / 1e6 * 27
    assert (total.in_tokens, total.out_tokens) == (tin, tout)
    assert total.yuan == pytest.approx(money, abs=1e-4) and total.calls + total.cache_hits == 300
    assert total.pct == pytest.approx(total.yuan / 5.0)
    spend = ledger.running_spend(log, ["seq"], prices, partitions=5)
    got = {r.seq: r for r in spend.collect()}
    run, warned, over = 0.0, None, None
    for seq, _, i, o, _ in rows:
        run += i / 1e6 * 6.5 + o / 1e6 * 27
        assert got[seq].yuan_so_far == pytest.approx(run, abs=1e-4)
        warned = seq if warned is None and run >= 4.0 else warned
        over = seq if over is None and run >= 5.0 else over
    assert ledger.crossing_row(spend, ["seq"], "warn").first().seq == warned
    assert ledger.crossing_row(spend, ["seq"], "over").first().seq == over
    free = ledger.running_spend(log, ["seq"], SpendSettings(), partitions=3)
    assert free.filter("warn or over").isEmpty() and ledger.crossing_row(free, ["seq"], "over").isEmpty()


def test_checks_on_questions(spark):
    train = spark.createDataFrame([("a", "qa", "train"), ("b", "qb", "eval"), ("c", "qc", None), ("d", "qd", "")],
                                  "qid string, query string, split string")
    held = spark.createDataFrame([("c", "x"), ("", "unknown"), (None, None)], "qid string, query string")
    assert {r.qid for r in joins.leaked_questions(train, held).collect()} == {"b", "c"}
    pools = spark.createDataFrame([("a", ["x"]), ("b", [" "]), ("c", [])], "qid string, answers array<string>")
    assert {r.qid for r in joins.without_pool(train, pools).collect()} == {"b", "c", "d"}
    assert joins.not_done(train, train.limit(0), "qid").count() == 4
    assert {r.qid for r in joins.uncovered(train, pools).collect()} == {"d"}


def test_settings_keep_the_selection_requirement():
    gates = DEFAULTS.gates
    assert gates.k_select >= 16 and gates.k_screen < gates.k_select
    assert math.isclose(DEFAULTS.noise.sigma_judge, 0.74)


def test_facts_by_key_equals_reading_the_joined_pool(spark):
    from quillgate.functions.facts import extract_facts, pool_text
    from quillgate.operators.pools import facts_by_key

    rows = [("hot", f"免征，{i % 7}万元，自202{i % 3}年起") for i in range(300)] + [("b", "空话"), ("c", None), ("c", "不超过5%")]
    df = spark.createDataFrame(rows, "qid string, answer string").repartition(5)
    got = {r.qid: r.facts.asDict() for r in facts_by_key(df, "qid", "answer").collect()}
    joined = df.groupBy("qid").agg(F.collect_list("answer").alias("a"))
    want = {r.qid: r.f.asDict() for r in joined.select("qid", extract_facts(pool_text("a")).alias("f")).collect()}
    assert got == want and len(got["hot"]["value"]) == 7 and got["b"]["value"] == []


def test_pool_targets_of_a_hundred_thousand_answers(spark):
    from quillgate.operators.pools import pool_targets

    long = spark.range(100_000).select(F.lit("q").alias("qid"), F.concat(F.lit("免征"), F.col("id") % 50, F.lit("万元")).alias("answer"))
    row = pool_targets(long).first()
    assert row.facts.polarity == ["免征"] and len(row.facts.value) == 50
    nested = spark.createDataFrame([("a", ["免征3万元", None]), ("b", [])], "qid string, pool_answers array<string>")
    assert {r.qid: r.facts.value for r in pool_targets(nested).collect()} == {"a": ["3万"]}


def test_completions_line_up_with_their_prompts_or_fail(spark):
    prompts = spark.createDataFrame([(i, f"q{i}") for i in range(3)], "position bigint, qid string")
    made = lambda ids: spark.createDataFrame([(i, f"t{i}") for i in ids], "position bigint, text string")
    got = candidates.aligned_candidates(prompts, made(range(6))).collect()
    assert sorted((r.qid, r.cand_idx, r.text) for r in got) == [(f"q{i // 2}", i % 2, f"t{i}") for i in range(6)]
    assert candidates.aligned_candidates(prompts, made([])).count() == 0
    for bad in (range(7), [0, 1, 3], [1, 2, 3], [0, None, 2]):
        with pytest.raises(ValueError):
            candidates.aligned_candidates(prompts, made(bad))
    twice = spark.createDataFrame([(0, "a"), (0, "b"), (2, "c")], "position bigint, qid string")
    with pytest.raises(Exception, match="no prompt, or two"):
        candidates.aligned_candidates(twice, made(range(3))).collect()
