"""Questions, candidates and judge scores derived from the order tables.

The driver tables hold no tagged completions, so every order line becomes one candidate
of the question its order stands for.  The expressions are plain SQL that Spark and
DuckDB read alike; both sides of a check start from the same derived rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QID = "substring(sha1('order ' || cast(l_orderkey as string)), 1, 12)"
CAND = "cast(l_linenumber as bigint) * 1000000000000 + l_partkey * 100000 + l_suppkey"

THINK = """
'先核对数量' || cast(cast(l_quantity as bigint) as string) || '件与折扣，'
|| case when l_returnflag = 'R' and l_linenumber = 1 then '根据参考资料，'
        when l_returnflag = 'R' and l_linenumber = 2 then '您可以参考下图，'
        when l_returnflag = 'A' and l_linenumber = 3 then '回答：'
        when l_returnflag = 'N' and l_linenumber = 4 then '见 table' || cast(l_partkey as string) || '.PNG 一栏，'
        when l_returnflag = 'N' and l_linenumber = 5 then '《甲办法》《乙办法》《丙办法》。'
        else '' end
|| '再看第' || cast(l_suppkey as string) || '家的报价，'
|| repeat('逐项推算这一笔的金额与期限；', l_linenumber)
|| '于是得到结论'
"""

ANSWER = """
case when cast(l_quantity as bigint) % 10 = 3 then '请结合实际情况处理。'
     when cast(l_quantity as bigint) % 10 = 4 then ' '
     else '这一笔' || cast(cast(floor(l_extendedprice / 20000) as bigint) * 2 as string) || '万元，税率'
       || cast(cast(round(l_tax * 100) as bigint) as string) || '%，自' || cast(year(l_shipdate) as string) || '年'
       || case when l_linenumber % 2 = 0 then ''
               else cast(month(l_shipdate) as string) || '月' || cast(day(l_shipdate) as string) || '日' end
       || '起' || case when l_linestatus = 'O' then '应缴' when l_returnflag = 'A' then '不超过限额' else '免征' end
       || '。' end
"""

TEXT = """
case when q % 10 = 0 then '<think>' || think || answer
     when q % 10 = 1 then '<think>' || think || '</think>' || answer
     when q % 10 = 2 then '<think> </think><answer>' || answer || '</answer>'
     else '<think>' || chr(10) || think || chr(10) || '</think>' || chr(10) || chr(10)
       || '<answer>' || chr(10) || answer || chr(10) || '</answer>' end
"""

PROMPT = "'【参考问答对】第' || qid || '题的依据【问题】' || qid"

# What an order line's texts are made of, and the key of a line.
_LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_OF_TEXTS = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
# The flags that the texts look at.
_FLAGS = {"l_returnflag": ("R", "A", "N"), "l_linestatus": ("O",)}

_INNER = [
    f"{QID} as qid", f"{CAND} as cand_idx", f"{THINK} as think", f"{ANSWER} as answer",
    "cast(l_quantity as bigint) as q", "l_tax", "l_linenumber", "l_linestatus", "l_extendedprice",
]

# DuckDB text of the derived candidates: ``WITH {CANDIDATES_CTE} SELECT ...``
CANDIDATES_CTE = (
    f"cand AS (SELECT qid, cand_idx, think, answer, q, l_tax, l_linenumber, {TEXT} AS text "
    f"FROM (SELECT {', '.join(_INNER)} FROM lineitem))"
)
# A question's sampled answers: the lines taxed at most 4 %.
POOL_CTE = (
    "pool AS (SELECT qid, list(answer ORDER BY cand_idx) AS pool_answers FROM cand "
    "WHERE l_tax <= 0.045 GROUP BY qid)"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """Deal rows over the shuffle partitions by their contents, whatever the files' row groups are."""
    parts = int(scan.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return scan.repartition(parts, F.xxhash64(*scan.columns))


def _in_many_splits(scan: DataFrame) -> bool:
    """Do the files alone make a task for every core?"""
    size = int(str(scan._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    split = scan.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(
        scan.sparkSession.conf.get("spark.sql.files.maxPartitionBytes"))
    return size >= split * scan.sparkSession.sparkContext.defaultParallelism


def order_lines(spark: SparkSession, sf_dir: str, dealt: bool = True) -> DataFrame:
    """``qid, cand_idx`` and what the texts of a candidate are made of: numbers and flags, no text yet.

    Dealt by the line's key, so that a reader of few columns shuffles few, unless the files are large
    enough to be read in many splits.  Readers that make no text of a line before they shuffle need no dealing.
    """
    lines = table(spark, sf_dir, "lineitem")
    if dealt and not _in_many_splits(lines):
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        lines = lines.repartition(parts, F.xxhash64(*_LINE_KEY))
    return lines.selectExpr(f"{QID} as qid", f"{CAND} as cand_idx", *_OF_TEXTS)


def numbered(lines: DataFrame) -> DataFrame:
    """The lines with their flags as places in ``_FLAGS``, 0 for any other: a row of numbers, which is
    grouped by hashing where texts would be sorted."""
    places = {c: F.coalesce(F.array_position(F.array(*map(F.lit, known)), F.col(c)), F.lit(0)) for c, known in _FLAGS.items()}
    return lines.withColumns(places)


def flagged(lines: DataFrame) -> DataFrame:
    """Numbered lines with the flags that the texts look at again; any other is null."""
    return lines.withColumns({c: F.elt(F.nullif(F.col(c), F.lit(0)).cast("int"), *map(F.lit, known)) for c, known in _FLAGS.items()})


def worded(lines: DataFrame) -> DataFrame:
    """``qid, cand_idx, think, answer, q, l_tax, l_linenumber, text`` of order lines."""
    inner = lines.selectExpr("qid", "cand_idx", *_INNER[2:])
    return inner.selectExpr("qid", "cand_idx", "think", "answer", "q", "l_tax", "l_linenumber", f"{TEXT} as text")


def with_texts(lines: DataFrame) -> DataFrame:
    """The lines with ``text`` beside their own columns."""
    made = lines.selectExpr("*", *[e for e in _INNER if e.endswith((" as think", " as answer", " as q"))])
    return made.withColumn("text", F.expr(TEXT)).drop("think", "answer", "q")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order line, with its texts."""
    return worded(order_lines(spark, sf_dir))


def sampled_answers(cand: DataFrame) -> DataFrame:
    """The pool in long form: distinct ``(qid, answer)``."""
    return cand.filter("l_tax <= 0.045").select("qid", "answer").distinct()


def pools(cand: DataFrame) -> DataFrame:
    from quillgate.operators.candidates import nest_in_order

    # Equal answers of a question are merged before the shuffle; the first one gives the place.
    sampled = cand.filter("l_tax <= 0.045").groupBy("qid", "answer").agg(F.min("cand_idx").alias("cand_idx"))
    return nest_in_order(sampled, ["qid"], "cand_idx", "answer", "pool_answers")


def score_of_key(key: str):
    """A fixed stand-in for the judge: a score from 0 to 10 read off the key."""
    return (F.conv(F.substring(key, 1, 4), 16, 10).cast("bigint") % 1001) / F.lit(100.0)


def sql_score_of_key(key: str) -> str:
    return f"(cast('0x' || substring({key}, 1, 4) AS BIGINT) % 1001) / 100.0"
