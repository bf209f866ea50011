"""Resume through the key filter, and checks counted by the job that writes the rows."""

import random

import pytest
from pyspark.sql import functions as F

from quillgate.operators import joins, observed, resume
from quillgate.plans import training_rows, upstream


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def shuffled(spark):
    """Bytes that all tasks of the session have written to shuffles."""
    every = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(every.apply(i).totalShuffleWrite() for i in range(every.size()))


def written_by(spark, df):
    before = shuffled(spark)
    df.write.format("noop").mode("overwrite").save()
    return shuffled(spark) - before


@pytest.mark.parametrize("blocks", [1, 64, 1 << 14])
def test_remaining_rows_are_those_of_the_anti_join(spark, blocks):
    """Also with one block, which every key fills: then all keys have an alarm."""
    rng = random.Random(blocks)
    items = [(rng.choice([None, rng.randrange(3000), rng.randrange(3000)]), f"row {i}") for i in range(2000)] + [(7, "hot")] * 1500
    done = [(rng.choice([None, rng.randrange(3000)]), 1) for _ in range(1500)] + [(5, 2)] * 300
    a, b = spark.createDataFrame(items, "k int, t string"), spark.createDataFrame(done, "k bigint, extra int")
    got = resume.remaining(a, b, "k", blocks)
    assert got.columns == a.columns and rows_of(got) == rows_of(joins.not_done(a, b, "k"))


def test_keys_of_any_type_and_empty_tables(spark):
    for ddl, keys in [("k string, n int", ["", "a", "ä" * 5000, None, "a "]), ("k double, n int", [0.0, -0.0, 1.5, None]),
                      ("k date, n int", [__import__("datetime").date(2024, 1, d) for d in (1, 2, 3)])]:
        a = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], ddl)
        for b in (a.limit(0), a.filter("n < 2"), a):
            assert rows_of(resume.remaining(a, b, "k")) == rows_of(joins.not_done(a, b, "k"))
            assert resume.remaining(a.limit(0), b, "k").count() == 0
    with pytest.raises(ValueError, match="blocks"):
        resume.key_filter(a, "k", resume.MOST_BLOCKS + 1)


def test_an_alarm_is_never_missed_and_seldom_false(spark):
    done, items = spark.range(0, 40_000).toDF("k"), spark.range(0, 80_000).toDF("k")
    known = resume.key_filter(done, "k", 128)  # thirteen bits a key
    assert known.count() <= 128 and known.filter(F.size("words") != resume.BLOCK_WORDS).isEmpty()
    marked = resume.with_alarm(items, known, F.col("k"), 128)
    assert marked.filter("k < 40000 AND NOT _alarm").isEmpty()
    assert 0 < marked.filter("k >= 40000 AND _alarm").count() < 40_000 * 0.03


def test_wide_rows_are_not_shuffled(spark):
    """Most of the items are done; neither these nor the new ones travel with their texts."""
    wide = spark.range(0, 60_000, numPartitions=4).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 512).alias("text"))
    done = spark.range(0, 60_000, numPartitions=4).filter("id % 6 > 0").toDF("k")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100k")  # the finished keys are no small table
    try:
        plain = written_by(spark, joins.not_done(wide, done, "k"))
        before = shuffled(spark)
        left = resume.remaining(wide, done, "k", 256)
        filtered = shuffled(spark) - before + written_by(spark, left)
        assert left.count() == 10_000 and filtered < plain / 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_requests_with_either_way_to_resume(spark):
    corpus = spark.createDataFrame([(f"q{i}", f"u{i}", None) for i in range(50)], "query string, user_prompt string, qid string")
    done = corpus.filter("query < 'q3'").select("query")
    assert rows_of(upstream.base_requests(corpus, done, left=resume.remaining)) == rows_of(upstream.base_requests(corpus, done))


TRAIN = "qid string, query string, user_prompt string, split string"
POOL = "qid string, canonical_answer string, gold_answer string, pool_answers array<string>"
FACT, VAGUE = "租金6万元不到8万元，可以免税。", "这件事说不准。"


def test_checks_and_rows_come_from_one_pass(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(len(b))
            yield b

    train = spark.createDataFrame([(f"q{i}", "a", "u", "train") for i in range(20)], TRAIN)
    pool = spark.createDataFrame([(f"q{i}", None, None, [FACT if i % 2 else VAGUE]) for i in range(20)], POOL).mapInPandas(counted, POOL)
    nobody = train.limit(0).select("qid", "query")
    rows = training_rows.online_prompts(train, pool, nobody)
    assert {r.qid for r in rows.collect()} == {f"q{i}" for i in range(1, 20, 2)} and read.value == 20


def test_first_failed_check_names_its_least_keys(spark):
    rows = spark.createDataFrame([(f"k{i}", i % 2 == 0, i % 3 == 0, None) for i in range(12)], "qid string, a boolean, b boolean, c boolean")
    a, b, c = observed.Check("a", "A", 2), observed.Check("b", "B", 3), observed.Check("c", "C", 3)
    with pytest.raises(ValueError, match=r"^A, e.g. \['k0', 'k10'\]$"):
        observed.stored_if_sound(rows, [a, b], "qid")
    with pytest.raises(ValueError, match=r"^B, e.g. \['k0', 'k3', 'k6'\]$"):
        observed.stored_if_sound(rows, [c, b, a], "qid")
    kept, seen = observed.stored_if_sound(rows, [c], "qid", odd=~F.col("a"))
    assert rows_of(kept) == rows_of(rows) and seen == {"c": 0, "odd": 6}
    empty, seen = observed.stored_with_counts(rows.limit(0), a="a")
    assert empty.count() == 0 and seen == {"a": 0}


def test_pool_of_several_rows_counts_once(spark):
    train = spark.createDataFrame([("q1", "a", "u", "train"), ("q2", "a", "u", "train"), ("q3", "a", "u", "train")], TRAIN)
    pool = spark.createDataFrame([("q1", None, None, [" "]), ("q1", None, None, [VAGUE]), ("q1", None, None, [FACT]), ("q2", None, None, [""])], POOL)
    got = training_rows.marked_prompts(train, pool, train.limit(0).select("qid", "query")).select("qid", "answers", "leaked", "missing", "kept")
    assert rows_of(got) == [("q1", [FACT], False, False, True), ("q2", [], False, True, False), ("q3", None, False, True, False)]


def test_questions_without_answers_in_long_form(spark):
    train = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "qid string")
    answers = spark.createDataFrame([("a", "x"), ("a", ""), ("b", " "), ("b", None)], "qid string, answer string")
    assert {r.qid for r in joins.without_long_pool(train, answers).collect()} == {"b", "c", None}
