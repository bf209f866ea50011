"""Live spend per stage from the usage log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillgate.operators.ledger import budget_flags, crossing_row, rounded_cost
from quillgate.operators.ranking import running_totals
from quillgate.settings import SpendSettings
from quillgate.sources.settle import settled


def windowed_spend(usage: DataFrame, prices: SpendSettings, window: str = "10 minutes",
                   lateness: str = "30 minutes") -> DataFrame:
    """Tokens and cost per time window and stage; works on a stream and on a table alike."""
    sums = (
        usage.withWatermark("ts", lateness)
        .groupBy(F.window("ts", window).alias("_w"), "stage")
        .agg(
            F.count("*").alias("calls"),
            F.sum("in_tokens").alias("in_tokens"),
            F.sum("out_tokens").alias("out_tokens"),
        )
    )
    return sums.select(
        F.col("_w.start").alias("window_start"),
        F.col("_w.end").alias("window_end"),
        "stage", "calls", "in_tokens", "out_tokens",
        rounded_cost("in_tokens", "out_tokens", prices).alias("yuan"),
    )


def running_stage_spend(usage: DataFrame, prices: SpendSettings) -> DataFrame:
    """Running totals per stage (``complete`` or ``update`` output), with the budget flags of the stage."""
    sums = usage.groupBy("stage").agg(
        F.count("*").alias("calls"), F.sum("in_tokens").alias("in_tokens"), F.sum("out_tokens").alias("out_tokens")
    )
    spent = sums.withColumn("yuan", rounded_cost("in_tokens", "out_tokens", prices))
    warn, over = budget_flags(F.col("yuan"), prices)
    return spent.withColumns({"warn": warn, "over": over})


def spend_stream(usage: DataFrame, prices: SpendSettings, sink: str, checkpoint: str, window: str = "10 minutes",
                 lateness: str = "30 minutes", available_now: bool = True) -> StreamingQuery:
    """``windowed_spend`` of a stream into Parquet, each window once, when the watermark has passed its end.

    Rows later than ``lateness`` are left out.
    """
    closed = windowed_spend(usage, prices, window, lateness)
    writer = closed.writeStream.outputMode("append").format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def crossing_stream(usage: DataFrame, log: DataFrame, order: list[str], prices: SpendSettings, flag: str, sink: str, checkpoint: str,
                    window: str = "10 minutes", lateness: str = "30 minutes", available_now: bool = True) -> StreamingQuery:
    """The row of the log at which ``flag`` (``warn`` or ``over``) is first raised, written once.

    Windows of event time are summed in parallel and closed in order by the watermark; only their
    sums run on, over ranges of windows.  The window in which the total crosses is then searched
    row by row in ``log``, the stored table that the stream reads.  The totals after each batch
    are a row of their own, under its number: a repeated batch starts from the same totals and
    writes the same files again, so the row appears once.  ``order`` begins with ``ts``.
    """
    spark = usage.sparkSession
    sums = usage.withWatermark("ts", lateness).groupBy(F.window("ts", window).alias("_w")).agg(
        F.coalesce(F.sum("in_tokens"), F.lit(0)).alias("in_tokens"), F.coalesce(F.sum("out_tokens"), F.lit(0)).alias("out_tokens")
    )
    closed = sums.select(F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), "in_tokens", "out_tokens")
    totals = {"in_so_far": "in_tokens", "out_so_far": "out_tokens"}

    def flagged(rows: DataFrame, by: list[str], spent: tuple[int, int]) -> DataFrame:
        ran = running_totals(rows, by, totals)
        ran = ran.withColumns({c: F.col(c) + F.lit(s) for c, s in zip(totals, spent, strict=True)})
        ran = ran.withColumn("yuan_so_far", rounded_cost("in_so_far", "out_so_far", prices))
        warn, over = budget_flags(F.col("yuan_so_far"), prices)
        return ran.withColumns({"warn": warn, "over": over})

    def follow(batch: DataFrame, batch_id: int) -> None:
        before = spark.read.parquet(f"{sink}/totals/batch={batch_id - 1}").first() if batch_id else None
        spent, crossed = ((before.in_tokens, before.out_tokens), before.crossed) if before else ((0, 0), False)
        windows = settled(batch)
        found = None
        if not crossed:
            first = crossing_row(flagged(windows, ["start"], spent), ["start"], flag).first()
            if first:
                earlier = first.in_so_far - first.in_tokens, first.out_so_far - first.out_tokens
                inside = log.filter((F.col("ts") >= F.lit(first.start)) & (F.col("ts") < F.lit(first.end)))
                found = crossing_row(flagged(inside, order, earlier), order, flag)
        if found is not None:
            found.write.mode("overwrite").parquet(f"{sink}/crossing/batch={batch_id}")
        sent = windows.agg(F.coalesce(F.sum("in_tokens"), F.lit(0)).alias("i"), F.coalesce(F.sum("out_tokens"), F.lit(0)).alias("o")).first()
        after = [(spent[0] + sent.i, spent[1] + sent.o, crossed or found is not None)]
        spark.createDataFrame(after, "in_tokens bigint, out_tokens bigint, crossed boolean").write.mode("overwrite").parquet(f"{sink}/totals/batch={batch_id}")

    writer = closed.writeStream.foreachBatch(follow).outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
