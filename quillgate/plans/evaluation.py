"""Running an evaluation and writing its products."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from quillgate.functions.facts import FactPack, ZH_FACTS
from quillgate.functions.style import StylePack, ZH_STYLE
from quillgate.operators.scorecard import score_rows, scorecard
from quillgate.settings import DEFAULTS, Settings
from quillgate.sources.jsonl import exists, write_parquet

# Names a complete report contains.
REPORT_MARKERS = ("干净分", "规则去检索腔通过率", "答案在池率")


def evaluate(inference: DataFrame, pool: DataFrame, scores: DataFrame, tag: str, settings: Settings = DEFAULTS,
             facts: FactPack = ZH_FACTS, style: StylePack = ZH_STYLE) -> tuple[DataFrame, DataFrame]:
    """Scored rows and the one-row scorecard of a run."""
    scored = score_rows(inference, pool, scores, facts, style)
    return scored, scorecard(scored, tag, settings.gates, settings.noise)


def render_report(card: dict) -> str:
    """Readable report of one scorecard row."""
    n, n_pool = card["n"], card["n_pool"]
    clean = "N/A" if card["clean_mean"] is None else f"{card['clean_mean']}"
    lines = [
        f"# 评测报告 · {card['tag']}",
        "",
        f"- 样本 {n}，有效判分 {card['n_valid_judge']}，缺池 {card['n_no_pool']}，空答案 {card['n_empty_answer']}",
        f"- 格式完整率：{n - card['n_format_failure']}/{n} = {card['format_pass_rate']:.1%}",
        f"- 干净分（k={card['k_eval']}）：{clean}，标准误 {card['se']:.3f}，真涨门 {card['true_gain_threshold']:.2f}",
        f"- 规则去检索腔通过率：{card['rule_pass_rate']:.1%}（{n} 题）",
        f"- 答案在池率：{card['in_pool_rate']:.1%}（{n_pool} 题）",
        f"- 可比题：{card['n_answer_comparable']}/{n_pool}，其中在池 {card['in_pool_comparable_rate']:.1%}",
    ]
    return "\n".join(lines) + "\n"


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(p.getParent())
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def _read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


def run_evaluation(inference: DataFrame, pool: DataFrame, scores: DataFrame, tag: str, paths: dict[str, str],
                   settings: Settings = DEFAULTS) -> dict:
    """Write scored rows, then the summary, then the report; no valid score is an error.

    The failure report carries none of the markers, so the run counts as not done.
    """
    spark = inference.sparkSession
    scored = score_rows(inference, pool, scores)
    write_parquet(scored, paths["scores"])
    # The scorecard reads the written rows: nothing is scored twice.
    card = scorecard(spark.read.parquet(paths["scores"]), tag, settings.gates, settings.noise).first().asDict(True)
    if card["n"] == 0 or card["clean_mean"] is None:
        _write_text(spark, paths["report"], f"# FAILED · {tag}\nN={card['n']}，有效判分 {card['n_valid_judge']}\n")
        raise ValueError(f"{tag}: no valid judge score")
    _write_text(spark, paths["summary"], json.dumps(card, ensure_ascii=False, indent=2))
    _write_text(spark, paths["report"], render_report(card))
    return card


def report_is_complete(spark: SparkSession, paths: dict[str, str]) -> bool:
    if not (exists(spark, paths["report"]) and exists(spark, paths["summary"])):
        return False
    text = _read_text(spark, paths["report"])
    return all(marker in text for marker in REPORT_MARKERS)


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """A written summary as a one-row scorecard."""
    return spark.read.option("multiLine", True).json(path)
