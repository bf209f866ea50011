"""Incremental evaluation: inference files arrive, each question is scored exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillgate.functions.text import filled_question_id
from quillgate.operators.joins import not_done
from quillgate.operators.pools import pool_targets
from quillgate.operators.scorecard import score_rows
from quillgate.schemas import schema
from quillgate.sources.jsonl import exists
from quillgate.sources.settle import shuffles_cleaned, stored


# What scoring reads of an inference row.
_READ = ("qid", "query", "think", "answer", "format_ok", "format_reason")


def score_stream(spark: SparkSession, inbox: str, pool: DataFrame, scores: DataFrame, sink: str, checkpoint: str,
                 tag: str, available_now: bool = True, files_per_trigger: int | None = None) -> StreamingQuery:
    """Score every new inference file into ``sink`` (Parquet, one folder per tag and batch).

    A batch writes to its own folder in overwrite mode, so a batch that is repeated after
    a failure replaces its rows.  Questions of earlier batches are known from the keyed state of
    the checkpoint; the sink is not read.  Only a stream that starts without a checkpoint looks
    at the sink, once, for questions that another stream has scored.
    """
    source = spark.readStream.schema(schema("inference"))
    if files_per_trigger:
        source = source.option("maxFilesPerTrigger", files_per_trigger)
    arriving = source.json(inbox).withColumn("qid", filled_question_id("qid", "query")).select(*_READ)
    # One bit of keyed state for each question, kept with the checkpoint: a batch costs what its own
    # rows cost, however many came before.  Of equal questions in one batch any one counts.
    fresh = arriving.dropDuplicates(["qid"])
    # Facts of the pool are read once, not for every batch.
    targets = stored(pool_targets(pool), "pool-facts")
    base, done = f"{sink}/tag={tag}", None
    if not exists(spark, f"{checkpoint}/metadata") and exists(spark, base):
        done = stored(spark.read.parquet(sink).filter(F.col("tag") == tag).select("qid").distinct(), "done")

    def score_batch(batch: DataFrame, batch_id: int) -> None:
        rows = stored(batch, "batch")  # scoring reads it several times; the state must be asked once
        rows = rows if done is None else not_done(rows, done, "qid")
        scored = score_rows(rows, targets, scores)
        with shuffles_cleaned(scored.sparkSession):
            scored.write.mode("overwrite").parquet(f"{base}/batch={batch_id}")

    writer = fresh.writeStream.foreachBatch(score_batch).outputMode("append").option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
