"""What a job leaves on disk: shuffle files, written tables, moved columns."""

import glob

from pyspark.sql import functions as F

from quillgate.catalog import queries as q
from quillgate.operators import joins, rewards
from quillgate.plans import training_rows
from quillgate.settings import DEFAULTS
from quillgate.sources.settle import checkpoint_dir, stored
from tests.test_plans import GOOD, POOL, PROMPT, wrap

SF = "/root/testdata/sf0.001"


def shuffle_files(spark):
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {str(found.apply(i)) for i in range(found.size()) if "shuffle_" in str(found.apply(i))}


def test_a_written_table_leaves_no_shuffle_files(spark):
    conf = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None)
    before = shuffle_files(spark)
    made = stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "few")
    assert not shuffle_files(spark) - before
    assert {r["k"]: r["count"] for r in made.collect()}[0] == 143
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) == conf


def test_keys_are_counted_only_where_their_hash_is_crowded(spark):
    rows = spark.createDataFrame([("a",)] * 6 + [("b",)] * 2 + [(None,)] * 5, "k string")
    assert {r.k: r._n for r in joins.crowded_keys(rows, "k", 5).collect()} == {"a": 6, None: 5}
    assert joins.crowded_keys(rows, "k", 7).isEmpty()


def test_a_join_without_hot_keys_keeps_the_partitioning(spark):
    left = spark.createDataFrame([(f"k{i % 5}", i) for i in range(50)] + [(None, -1), ("absent", -2)], "k string, i int")
    right = spark.createDataFrame([(f"k{i}", i) for i in range(5)], "k string, v int")
    plain = joins.join_unique(left, right, "k")
    assert "_salt" not in plain._jdf.queryExecution().optimizedPlan().toString()
    for min_rows in (1000, 5):  # without and with hot keys
        made = joins.join_unique(left, right, "k", min_rows=min_rows)
        assert made.columns == ["k", "i", "v"]
        assert {r.i: r.v for r in made.collect()} == {i: i % 5 for i in range(50)} | {-1: None, -2: None}


def test_only_survivors_are_written(spark):
    kept = training_rows.long_survivors(*q._selection_inputs(spark, SF))
    written = spark.read.parquet(*kept.inputFiles())
    assert 0 < written.count() == kept.count()
    assert not {"screen_key", "answer_facts", "pool_facts", "text"} & set(written.columns)


def test_one_row_of_a_repeated_place_is_the_best(spark):
    rows = [("q", i, "query", "prompt", "r", "a", "base", "think", k) for i, k in ((3, "x"), (3, "x"), (1, "x"), (1, "x"), (0, "y"))]
    kept = spark.createDataFrame(rows, "qid string, cand_idx bigint, query string, user_prompt string, references string, "
                                       "answer string, base_think string, think string, screen_key string")
    scores = spark.createDataFrame([("x", 9.0, 0.0, 2), ("y", 1.0, 0.0, 2)], "key string, clean_score double, sd double, n bigint")
    best = training_rows.screened(kept, scores).collect()
    assert [(r.qid, r.cand_idx, r.screen_score, r.think) for r in best] == [("q", 1, 9.0, "think")]
    keys = q.replies.score_key(DEFAULTS.spend.cache_version, "references", "think", DEFAULTS.gates.k_select).alias("key")
    assert best[0].select_key == kept.select(keys).first().key


def test_clean_candidates_alone_meet_the_scores(spark):
    prompts = spark.createDataFrame([("q", PROMPT, '["%s"]' % POOL[0]), ("none", PROMPT, "[]")],
                                    "qid string, user_prompt string, v1_answers_json string")
    cands = spark.createDataFrame([("q", 0, wrap(GOOD, POOL[0]), "k0"), ("q", 1, "<think>", "k1"), ("none", 0, wrap(GOOD, POOL[0]), "k2")],
                                  "qid string, cand_idx int, text string, key string")
    seen = []

    def judged(gated):
        seen.append({(r.key, r.gate) for r in gated.collect()})
        return spark.createDataFrame([("k0", 10.0, 0.0, 2), ("k1", 10.0, 0.0, 2)], "key string, clean_score double, sd double, n bigint")

    made = rewards.candidate_rewards(cands, prompts, DEFAULTS.reward, judged, pooled_only=True)
    assert seen == [{("k0", "clean"), ("k1", "format")}]
    assert {r.key: r.reward for r in made.collect()} == {"k0": 1.4, "k1": -4.0}
    assert {r.key for r in rewards.candidate_rewards(cands.filter("key <> 'k2'"), prompts, DEFAULTS.reward, judged(made)).collect()} == {"k0", "k1"}


def test_rewrites_are_written_without_their_keys(spark):
    gated = q._rewrites(spark, SF)
    written = spark.read.parquet(*gated.inputFiles())
    assert "natural" in written.columns and not [c for c in written.columns if c.endswith("_key")]
    assert {"screen_key", "screen_base_key", "select_key", "base_key"} <= set(gated.columns)


def test_the_inbox_of_the_stream_is_compressed(spark):
    before = set(glob.glob(f"{checkpoint_dir(spark)}/stream-*"))
    q.QUERIES["streamed_scores"](spark, SF)
    (work,) = set(glob.glob(f"{checkpoint_dir(spark)}/stream-*")) - before
    assert len(glob.glob(f"{work}/inbox/*.json.gz")) >= 4 and not glob.glob(f"{work}/inbox/*.json")
