"""A training corpus from raw documents: five stages, each one operator over all that the last one kept.

Every stage takes ``(spark, docs, sf_dir)`` and returns a table; ``run`` writes it as Parquet
and reads it back for the next.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgate.llm import decontaminate, jaccard_join, line_dedup, mixing, toxicity
from quillgate.llm.shared import carried, fields, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold go.  Learns as ``op1`` does.

    A text without any evidence, whose score is the base score, stays whatever the base is.
    """
    settings = toxicity.Settings()
    model = toxicity.train_on_open_rows(docs, table(spark, sf_dir, "labels"), settings)
    clean = (F.col("score") < settings.threshold) | (F.col("score") <= F.lit(model.base_score))
    return toxicity.scored(docs, model, carry="whole").where(clean).select(*fields(docs.columns))


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go from all of them; a null text stays null."""
    kept = line_dedup.drop_common_lines(docs)
    text = F.when(F.col("whole").getField("text").isNotNull(), F.col("kept_text"))
    return kept.select(*fields(docs.columns, text=text, n_chars=F.char_length(text).cast("bigint")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least ``doc_id`` of each group of near duplicates stays, once; documents without an id stay.

    Unrelated texts under one ``doc_id`` are groups of their own and all stay.
    """
    found = jaccard_join.joined(docs)
    firsts = found.where("doc_id IS NOT NULL").groupBy("group_id").agg(F.min(F.struct("doc_id", "row")).alias("first"))
    stay = firsts.select("first.row").unionByName(found.where("doc_id IS NULL").select("row").distinct())
    once = carried(docs).withColumn("nth", F.row_number().over(W.partitionBy("row").orderBy("row"))).where(
        (F.col("nth") == 1) | F.col("whole").getField("doc_id").isNull()
    )
    return once.join(written(stay, "near-stay"), "row", "left_semi").select(*fields(docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes from each remaining document."""
    return mixing.mixed(docs, table(spark, sf_dir, "labels")).drop("source")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_common_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
]

#: SQL cannot state the classifier, the banded join and the sampling; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
