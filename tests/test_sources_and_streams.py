import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillgate.operators.scorecard import score_rows
from quillgate.schemas import schema
from quillgate.settings import SpendSettings
from quillgate.sources import jsonl
from quillgate.sources.layout import Layout
from quillgate.sources.settle import checkpoint_dir, settled
from quillgate.streaming.incremental import score_stream
from quillgate.streaming.spend import running_stage_spend, windowed_spend

S = StructType().add("query", "string").add("user_prompt", "string")


def write_lines(path, lines):
    path.write_text("\n".join(lines), encoding="utf-8")
    return str(path)


def test_strict_scan(spark, tmp_path):
    assert jsonl.read_jsonl(spark, str(tmp_path / "none"), S).count() == 0
    good = write_lines(tmp_path / "a.jsonl", ['{"query": "甲", "user_prompt": "p"}', "", '{"query": "乙"}'])
    assert [r.query for r in jsonl.read_jsonl(spark, good, S, ordered=True).orderBy("_ord").collect()] == ["甲", "乙"]
    bad = write_lines(tmp_path / "b.jsonl", ['{"query": "甲"}', '{"query": "乙'])
    with pytest.raises(Exception):
        jsonl.read_jsonl(spark, bad, S).collect()


def test_progress_scan_is_tolerant_and_last_wins(spark, tmp_path):
    path = write_lines(tmp_path / "p.jsonl", [
        '{"query": "甲", "user_prompt": "1"}', '{"user_prompt": "nokey"}', '{"query": "乙", "user_prompt": "2"}',
        '{"query": "甲", "user_prompt": "3"}', '{"query": "丙", "user'])
    got = {r.query: r.user_prompt for r in jsonl.read_progress(spark, path, S, "query").collect()}
    assert got == {"甲": "3", "乙": "2"}
    assert {r.query for r in jsonl.done_keys(spark, path).collect()} == {"甲", "乙"}
    assert jsonl.done_keys(spark, str(tmp_path / "none")).isEmpty()


def test_write_append_and_markers(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([("甲", "p")], S)
    assert not jsonl.nonempty(spark, path) and not jsonl.is_complete(spark, path)
    jsonl.write_jsonl(df.limit(0), path)
    assert jsonl.is_complete(spark, path)
    jsonl.write_jsonl(df, path)
    jsonl.append_jsonl(df, path)
    assert jsonl.read_jsonl(spark, path, S).count() == 2 and jsonl.nonempty(spark, path)
    raw = "".join(r[0] for r in spark.read.text(path).collect())
    assert "甲" in raw


def test_later_appends_win_whatever_their_files_are_called(spark, tmp_path):
    path = str(tmp_path / "p")
    for k in range(4):
        rows = [(f"k{i}", f"{k}-{j}") for j in range(3) for i in range(20)]
        jsonl.append_jsonl(spark.createDataFrame(rows, S).coalesce(1).repartition(1 if k == 3 else 4), path)
    last = {r.query: r.user_prompt for r in jsonl.read_progress(spark, path, S, "query").collect()}
    assert len(last) == 20 and all(v.startswith("3-") for v in last.values())
    assert jsonl.first_lines(spark, path, S, 7).count() == 7


def test_layout_and_checkpoint(spark):
    run = Layout("/data/run")
    assert run.table("train") == "/data/run/01_train" and run.evaluation("dpo")["scores"].endswith("dpo_scores")
    assert checkpoint_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert settled(spark.range(5)).count() == 5


def test_stream_scores_each_question_once(spark, tmp_path):
    inbox, sink, ckpt = (str(tmp_path / n) for n in ("in", "sink", "ckpt"))
    (tmp_path / "in").mkdir()
    pool = spark.createDataFrame([(f"q{i}", [f"免征{i}万元"]) for i in range(6)], "qid string, pool_answers array<string>")
    scores = spark.createDataFrame([(f"q{i}", float(i), 3) for i in range(6)], "qid string, clean_score double, n bigint")

    def line(i):
        return json.dumps({"qid": f"q{i}", "query": f"问{i}", "think": "推理" if i else "参考资料", "answer": f"免征{i}万元",
                           "format_ok": True, "format_reason": "ok"}, ensure_ascii=False)

    def run():
        query = score_stream(spark, inbox, pool, scores, sink, ckpt, "dpo", files_per_trigger=1)
        query.awaitTermination(120)
        assert query.exception() is None

    write_lines(tmp_path / "in" / "1.json", [line(0), line(1), line(1)])
    run()
    write_lines(tmp_path / "in" / "2.json", [line(1), line(2), line(3)])
    write_lines(tmp_path / "in" / "3.json", [line(3), line(4)])
    run()
    got = spark.read.parquet(sink).drop("tag", "batch")
    every = spark.read.schema(schema("inference")).json(inbox).dropDuplicates(["qid"])
    want = score_rows(every, pool, scores)
    assert got.count() == 5
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect()))


def test_spend_windows_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:{i % 60:02d}:00", "judge" if i % 2 else "rewrite", 1000 * i, 10 * i) for i in range(120)]
    log = spark.createDataFrame(rows, "seq bigint, t string, stage string, in_tokens bigint, out_tokens bigint").select(
        "seq", F.to_timestamp("t").alias("ts"), "stage", "in_tokens", "out_tokens", F.lit(False).alias("cache_hit"))
    log.write.parquet(str(tmp_path / "log"))
    prices = SpendSettings(budget=10.0)
    batch = windowed_spend(log, prices)
    stream = windowed_spend(spark.readStream.schema(log.schema).parquet(str(tmp_path / "log")), prices)
    q = stream.writeStream.format("memory").queryName("spend").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("spend")
    assert got.count() == batch.count() == 12 and got.exceptAll(batch).isEmpty()
    stages = {r.stage: r for r in running_stage_spend(log, prices).collect()}
    assert stages["judge"].over and stages["judge"].calls == 60
