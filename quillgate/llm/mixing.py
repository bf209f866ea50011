"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws an exponential key, divided by its quality weight; ordered by key, the
documents of a source are a weighted sample without replacement at every length.  A source's
target is met by complete epochs first; the rest is the prefix of that order whose sizes add
up to the remainder.

A draw comes from a hash of the document (id, text and seed), so reruns and retried tasks
agree.  The order within a source is not sorted in one place: keys fall into ``cells`` of the
exponential law, equal in expectation; cell totals give each cell its offset, and only the
rows of one cell of one source are sorted together.

Defined results: a null text has size 0; a document of size 0 is never taken.  A null source
is a source of its own, last in order.  Rows that repeat an id and text draw the same key and
follow each other.  A source without words has target 0.  Quality labels of one id combine by
minimum.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgate.llm.shared import WORD, table, written


@dataclass(frozen=True)
class Settings:
    weights: tuple[float, ...] = (5.0, 2.0, 1.0)  #: of the sources in order, repeating
    share: float = 1.5  #: of all sizes, what the mix takes
    most_epochs: float = 2.0  #: bound of a source's target over its size
    good: float = 2.0  #: quality weight of documents labelled good
    poor: float = 0.5  #: and of those labelled poor; others weigh 1
    cells: int = 4096  #: of a source's key range
    seed: int = 41


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: list[tuple], settings: Settings = Settings()) -> list[float]:
    """Token targets of ``(source, size)`` in order: shares by weight, capped at ``most_epochs``
    times the size, the excess shared again by weight among the others until none is above."""
    weight = [settings.weights[i % len(settings.weights)] for i in range(len(sizes))]
    caps = [settings.most_epochs * n for _, n in sizes]
    out, open_ = [0.0] * len(sizes), [i for i in range(len(sizes)) if caps[i] > 0]
    left = settings.share * sum(n for _, n in sizes)
    while open_:
        total = sum(weight[i] for i in open_)
        over = [i for i in open_ if left * weight[i] / total > caps[i]]
        if not over:
            for i in open_:
                out[i] = left * weight[i] / total
            break
        for i in over:
            out[i] = caps[i]
        left -= sum(caps[i] for i in over)
        open_ = [i for i in open_ if i not in over]
    return out


def mixed(docs: DataFrame, labels: DataFrame | None = None, settings: Settings = Settings()) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken``: one row for each row of ``docs``.

    ``taken`` counts the words that the mix takes from the document, repeats included.
    """
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), size_of(F.col("text").cast("string")).alias("size"),
        F.xxhash64(F.lit(settings.seed), F.col("doc_id").cast("bigint"), F.col("text").cast("string")).alias("draw"),
    )
    if labels is not None:
        known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(
            "doc_id IS NOT NULL AND quality IS NOT NULL"
        ).groupBy("doc_id").agg(F.min("quality").alias("quality"))
        rows = rows.join(known, "doc_id", "left").withColumn(
            "weight", F.when(F.col("quality") == 1, settings.good).when(F.col("quality") == 0, settings.poor).otherwise(1.0)
        ).drop("quality")
    else:
        rows = rows.withColumn("weight", F.lit(1.0))
    # 53 bits of the draw, strictly between 0 and 1
    uniform = (F.shiftrightunsigned("draw", 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    key = -F.log(uniform) / F.col("weight")
    keyed = rows.select(
        "doc_id", "source", "size", "draw", key.alias("key"),
        F.least(F.floor((1 - F.exp(-key)) * settings.cells), F.lit(settings.cells - 1)).cast("int").alias("cell"),
    )
    keyed = written(keyed, "mix-keys")
    cells = written(keyed.groupBy("source", "cell").agg(F.sum("size").alias("cell_size")), "mix-cells")
    # One row for each source: the mix is planned from their sizes.
    sums = sorted(((r["source"], r["n"]) for r in cells.groupBy("source").agg(F.sum("cell_size").alias("n")).collect()), key=lambda x: (x[0] is None, x[0] or ""))
    goals = [(s, n, t) for (s, n), t in zip(sums, targets(sums, settings), strict=True)]
    plan = docs.sparkSession.createDataFrame(goals, "planned string, source_size bigint, target double")
    epochs = F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("bigint")
    plan = plan.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    before = W.partitionBy("source").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)  # ``cells`` rows for each source
    offsets = cells.withColumn("offset", F.coalesce(F.sum("cell_size").over(before), F.lit(0)))
    offsets = offsets.join(plan, F.col("source").eqNullSafe(F.col("planned")))
    # The plan has a row for each cell of each source; it grows with the sources, so it is not broadcast.
    # Cells that the prefix passes or never reaches need no order; one cell of each source does.
    offsets = written(offsets.select(
        F.col("source").alias("s"), F.col("cell").alias("c"), "offset", "source_size", "target", "epochs", "rest",
        ((F.col("offset") < F.col("rest")) & (F.col("offset") + F.col("cell_size") > F.col("rest"))).alias("cut"),
    ), "mix-plan")
    rows = keyed.join(offsets.hint("merge"), F.col("source").eqNullSafe(F.col("s")) & (F.col("cell") == F.col("c"))).drop("s", "c")
    order = W.partitionBy("source", "cell").orderBy("key", "draw", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    whole = rows.where("NOT cut").withColumn("chosen", F.col("offset") < F.col("rest"))
    start = F.col("offset") + F.coalesce(F.sum("size").over(order), F.lit(0))
    # the last document is taken if at least half of it fits
    edge = rows.where("cut").withColumn("chosen", start + F.col("size") / 2 <= F.col("rest"))
    return whole.unionByName(edge).select(
        "doc_id", "source", "size", "source_size", "target", (F.col("size") * (F.col("epochs") + F.col("chosen").cast("int"))).alias("taken"),
    )


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("source")
