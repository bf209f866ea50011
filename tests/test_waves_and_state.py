"""Early stop in waves, mergeable moments, the partitioned score cache, streams that start again."""

import datetime as dt
import os
import random
import statistics

import pytest
from pyspark.sql import functions as F

from quillgate.operators import ledger, moments, ranking, scores, waves
from quillgate.settings import SpendSettings
from quillgate.sources import score_cache
from quillgate.streaming.spend import crossing_stream, spend_stream, windowed_spend


def items(spark, n, every=4):
    return spark.range(n).select(F.concat(F.lit("q"), "id").alias("qid"), (F.col("id") % every == 0).alias("good"))


def rows_of(df):
    return sorted(map(tuple, df.select("qid", "good").collect()), key=repr)


@pytest.mark.parametrize(("n", "target", "chunk", "growth"), [(300, 20, 7, 2.0), (300, 20, 7, 1.0), (50, 1000, 8, 3.0), (40, 0, 8, 2.0), (0, 5, 8, 2.0), (64, 16, 64, 2.0)])
def test_waves_return_what_gather_until_returns(spark, n, target, chunk, growth):
    df = items(spark, n)
    made = waves.gather_in_waves(df, lambda part: part, "qid", "good", target, chunk, growth=growth)
    want = ranking.gather_until(df, "qid", "good", target, chunk)
    assert rows_of(made.rows) == rows_of(want)
    assert made.reached == (0 < target <= (n + 3) // 4)
    if growth == 1.0:  # waves of one chunk: nothing beyond it is worked on
        assert made.scored == want.count() < n


def test_work_is_done_once_and_only_where_it_is_reached(spark, tmp_path):
    df, seen = items(spark, 400), []

    def work(part):
        seen.append([r.qid for r in part.collect()])
        return part

    first = waves.gather_in_waves(df, work, "qid", "good", 15, 10, folder=str(tmp_path / "w"), growth=1.0)
    touched = [q for part in seen for q in part]
    assert len(touched) == len(set(touched)) == first.scored < 400 and all(len(part) == 10 for part in seen)
    before = len(seen)
    again = waves.gather_in_waves(df, work, "qid", "good", 15, 10, folder=str(tmp_path / "w"), growth=1.0)
    assert len(seen) == before and again.scored == again.waves == 0 and again.reached and rows_of(again.rows) == rows_of(first.rows)
    os.remove(tmp_path / "w" / f"wave={first.waves - 1:05d}" / "_SUCCESS")  # the last wave was cut off
    more = waves.gather_in_waves(df, work, "qid", "good", 25, 10, folder=str(tmp_path / "w"), growth=1.0)
    assert rows_of(more.rows) == rows_of(ranking.gather_until(df, "qid", "good", 25, 10))
    assert {q for part in seen[before:] for q in part} & {q for part in seen[: before - 1] for q in part} == set()


def test_items_without_a_result_count_in_their_chunk(spark):
    df = items(spark, 200, 3)
    made = waves.gather_in_waves(df, lambda part: part.filter("good"), "qid", "good", 20, 10)
    want = ranking.gather_until(df, "qid", "good", 20, 10).filter("good")
    assert rows_of(made.rows) == rows_of(want)


def test_moments_merge_in_any_order(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None, "once"]) if k else "once", None if k % 9 == 0 else 1e9 + rng.gauss(0, 1e-3), k % 4) for k in range(400)]
    rows += [("alone", 2.0, 1), ("empty", None, 2)]
    df = spark.createDataFrame(rows, "key string, score double, part int")
    parts = [moments.moments(df.filter(F.col("part") == p), ["key"], "score") for p in range(4)]
    for order in ((0, 1, 2, 3), (3, 1, 0, 2)):
        state = parts[order[0]]
        for p in order[1:]:
            state = moments.merged_moments(state, parts[p], ["key"])
        got = {r.key: r for r in moments.scores_of_moments(state, ["key"]).collect()}
        assert set(got) == {r[0] for r in rows}
        for key, r in got.items():
            values = [v for k, v, _ in rows if k == key and v is not None]
            assert r.n == len(values) and (r.clean_score is None) == (not values)
            if values:
                assert abs(r.clean_score - statistics.fmean(values)) < 1e-6
                assert abs(r.sd - (statistics.stdev(values) if len(values) > 1 else 0)) < 1e-5
    one = moments.variance_within(moments.moments(df.filter("key = 'a'"), ["key"], "score")).first()
    assert abs(one.within - statistics.variance([v for k, v, _ in rows if k == "a" and v is not None])) < 1e-9


def files_of(path):
    return {os.path.join(d, x) for d, _, names in os.walk(path) for x in names if x.endswith(".parquet")}


def test_only_partitions_with_a_new_key_are_written(spark, tmp_path):
    path = str(tmp_path / "cache")
    columns = "key string, clean_score double, sd double, n bigint"
    made = lambda lo, hi, s: spark.createDataFrame([(f"k{i}", s + i, 0.5, 16) for i in range(lo, hi)], columns)
    assert score_cache.answered(spark, path, made(0, 3, 0.0)).count() == 0
    assert score_cache.add_scores(spark, path, made(0, 200, 0.0), 32) > 20
    before = files_of(path)
    assert score_cache.add_scores(spark, path, made(0, 200, 5.0)) == 0 and files_of(path) == before
    assert score_cache.add_scores(spark, path, made(199, 202, 5.0).unionByName(made(201, 202, 7.0))) in (1, 2)
    after = files_of(path)
    assert 0 < len(before - after) <= 2 and len(before & after) >= len(before) - 2
    got = {r.key: r.clean_score for r in score_cache.read_scores(spark, path).collect()}
    assert got == {f"k{i}": float(i) if i < 200 else 5.0 + i for i in range(202)}
    asked = spark.createDataFrame([("k3",), ("k3",), ("k999",), (None,)], "key string")
    assert [(r.key, r.clean_score) for r in score_cache.answered(spark, path, asked).collect()] == [("k3", 3.0)]


LOG = "seq bigint, ts timestamp, stage string, in_tokens bigint, out_tokens bigint, cache_hit boolean"
START = dt.datetime(2024, 1, 1)


def usage(n, lo=0):
    rng = random.Random(n)
    return [(k, START + dt.timedelta(minutes=3 * k), rng.choice(["judge", "write"]), rng.randrange(9000), rng.randrange(900), False) for k in range(lo, n)]


def follow(spark, folder, start):
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(f"{folder}/log")
    query = start(stream, spark.read.schema(LOG).parquet(f"{folder}/log"))
    query.awaitTermination(180)
    assert query.exception() is None


def test_spend_streams_close_windows_once_and_drop_late_rows(spark, tmp_path):
    folder, prices = str(tmp_path), SpendSettings(budget=2.0)
    rows = usage(160)
    spend = lambda s, _: spend_stream(s, prices, f"{folder}/windows", f"{folder}/c1")
    cross = lambda s, log: crossing_stream(s, log, ["ts", "seq"], prices, "warn", f"{folder}/spend", f"{folder}/c2")
    end = [(-1, START + dt.timedelta(days=9), "end", 0, 0, False)]
    late = [(999, START, "judge", 10**7, 0, False)]  # long after its window was closed
    for part in (rows[:60], rows[60:100], late, rows[100:], end):
        spark.createDataFrame(part, LOG).coalesce(1).write.mode("append").parquet(f"{folder}/log")
        for start in (spend, cross):
            follow(spark, folder, start)
    batch = spark.createDataFrame(rows, LOG)
    got = spark.read.parquet(f"{folder}/windows")
    want = windowed_spend(batch, prices)
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()
    first = ledger.crossing_row(ledger.running_spend(batch, ["ts", "seq"], prices), ["ts", "seq"], "warn").first()
    found = spark.read.parquet(f"{folder}/spend/crossing").collect()
    assert [(r.seq, r.yuan_so_far) for r in found] == [(first.seq, first.yuan_so_far)]
    totals = spark.read.parquet(f"{folder}/spend/totals").orderBy(F.desc("batch")).first()
    assert totals.crossed and totals.in_tokens == sum(r[3] for r in rows)


def test_scores_stay_exact_after_rounding(spark):
    df = spark.createDataFrame([(f"k{i % 3}", float(i)) for i in range(30)], "key string, score double")
    a = scores.repeat_scores(df).orderBy("key").collect()
    b = moments.scores_of_moments(moments.moments(df, ["key"], "score"), ["key"]).select("clean_score", "sd", "n", "key").orderBy("key").collect()
    assert [(r.key, round(r.clean_score, 9), round(r.sd, 9), r.n) for r in a] == [(r.key, round(r.clean_score, 9), round(r.sd, 9), r.n) for r in b]
