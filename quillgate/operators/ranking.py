"""Order-dependent operators without a global sort.

Ranks over a hash key are found from a histogram of its leading hex digits: bucket
counts (at most 65,536 rows) give every bucket its offset, so only rows of one bucket
are ever ordered together.  Where just a cut-off is needed, wide rows are not moved at
all: the cut-off hash is a scalar and the split is a filter.

Hash keys must be unique per row (hash a unique key); buckets are then even.  Ranks over
any other key are running counts over ranges of the key itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgate.functions.text import seeded_hash
from quillgate.sources.settle import stored

_HEX_DIGITS = 4


def _place(seed: int, key: str) -> Column:
    """Where a row stands in seeded order; a null key has a place of its own."""
    return seeded_hash(seed, F.coalesce(F.col(key).cast("string"), F.lit("\x00null")))


def _bucket(hash_col: Column) -> Column:
    return F.conv(F.substring(hash_col, 1, _HEX_DIGITS), 16, 10).cast("int")


def _with_offsets(counts: DataFrame, *totals: str) -> DataFrame:
    """Add ``<name>_before`` for each total.  The input is one row per bucket, so a single task is enough."""
    earlier = W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    for name in totals:
        counts = counts.withColumn(f"{name}_before", F.coalesce(F.sum(name).over(earlier), F.lit(0)))
    return counts


def hash_at_rank(keys: DataFrame, hash_col: str, rank: Column | int) -> DataFrame:
    """One row with the ``rank``-th smallest hash; no row when there are fewer."""
    rank = rank if isinstance(rank, Column) else F.lit(rank)
    narrow = keys.select(F.col(hash_col).alias("_h")).withColumn("_bucket", _bucket(F.col("_h")))
    offsets = _with_offsets(narrow.groupBy("_bucket").agg(F.count("*").alias("n")), "n")
    edge = offsets.withColumn("_rank", rank).filter(
        (F.col("n_before") < F.col("_rank")) & (F.col("n_before") + F.col("n") >= F.col("_rank"))
    )
    inside = narrow.join(F.broadcast(edge), "_bucket")
    placed = inside.withColumn("_at", F.row_number().over(W.partitionBy("_bucket").orderBy("_h")) + F.col("n_before"))
    return placed.filter(F.col("_at") == F.col("_rank")).select("_h")


def up_to_rank(df: DataFrame, hash_col: str, rank: Column | int) -> Column:
    """Condition: the row is among the ``rank`` smallest hashes of ``df``."""
    return F.col(hash_col) <= F.coalesce(hash_at_rank(df, hash_col, rank).scalar(), F.lit("g"))


def fixed_count_split(df: DataFrame, key: str, n_eval: int, seed: int = 42) -> DataFrame:
    """Label exactly ``n_eval`` rows ``eval`` and the rest ``train``, the same way on every run."""
    hashed = df.withColumn("_hash", _place(seed, key))
    split = F.when(up_to_rank(hashed, "_hash", n_eval), "eval").otherwise("train")
    return hashed.withColumn("split", split).drop("_hash")


def shuffled_limit(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """The first ``n`` rows in seeded order; 0 keeps all."""
    if not n:
        return df
    hashed = df.withColumn("_hash", _place(seed, key))
    return hashed.filter(up_to_rank(hashed, "_hash", n)).drop("_hash")


def global_rank(df: DataFrame, key: str, out: str = "rank") -> DataFrame:
    """1-based rank of every row in the order of any key, null first; the key should be unique."""
    return running_totals(df.withColumn("_one", F.lit(1)), [key], {out: "_one"}).drop("_one")


def hold_out_every(df: DataFrame, key: str, fraction: float) -> DataFrame:
    """Add ``held_out``: every N-th row in plain key order, starting with the first; N is at least 2.

    A null key comes first, then the empty text.
    """
    if fraction <= 0:
        return df.withColumn("held_out", F.lit(False))
    every = max(2, round(1 / fraction))
    ranked = global_rank(df, key, "_rank")
    return ranked.withColumn("held_out", (F.col("_rank") - 1) % every == 0).drop("_rank")


def gather_until(df: DataFrame, key: str, selected: str, target: int, chunk: int, seed: int = 42,
                 already: int = 0) -> DataFrame:
    """Rows of the seeded-order chunks up to the one in which ``target`` selected rows are reached.

    All rows are kept when the target is 0 or never reached; none when ``already``
    (selected rows of an earlier run) satisfies it.
    """
    if target <= 0:
        return df
    if already >= target:
        return df.limit(0)
    missing = target - already
    hashed = df.withColumn("_hash", _place(seed, key))
    narrow = hashed.select("_hash", F.col(selected).cast("int").alias("_sel")).withColumn(
        "_bucket", _bucket(F.col("_hash"))
    )
    counts = narrow.groupBy("_bucket").agg(F.count("*").alias("n"), F.coalesce(F.sum("_sel"), F.lit(0)).alias("hit"))
    edge = _with_offsets(counts, "n", "hit").filter(
        (F.col("hit_before") < missing) & (F.col("hit_before") + F.col("hit") >= missing)
    )
    in_order = W.partitionBy("_bucket").orderBy("_hash")
    inside = (
        narrow.join(F.broadcast(edge), "_bucket")
        .withColumn("_at", F.row_number().over(in_order) + F.col("n_before"))
        .withColumn(
            "_hits",
            F.sum("_sel").over(in_order.rowsBetween(W.unboundedPreceding, W.currentRow)) + F.col("hit_before"),
        )
    )
    chunk = max(1, chunk)
    stop = inside.filter((F.col("_sel") == 1) & (F.col("_hits") == missing)).select(
        (F.ceil(F.col("_at") / chunk) * chunk).alias("stop")
    )
    return hashed.filter(up_to_rank(hashed, "_hash", stop.scalar())).drop("_hash")


def running_totals(df: DataFrame, order: list[str], totals: dict[str, str], partitions: int | None = None) -> DataFrame:
    """Running sums over one global order.

    ``totals`` maps an output column to the summed column.  Rows are range-partitioned
    on the order columns, written once, and every range gets the sum of the ranges
    before it; no task sees more than its range.  The order columns together must be
    unique, so that a hot first column is split like any other.
    """
    spark = df.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(df.repartitionByRange(partitions, *order).withColumn("_range", F.spark_partition_id()), "ranged")
    sums = ranged.groupBy("_range").agg(*[F.sum(c).alias(f"_t_{out}") for out, c in totals.items()])
    earlier = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    # One row per range: bounded by the partition count.
    before = sums.select(
        "_range", *[F.coalesce(F.sum(f"_t_{out}").over(earlier), F.lit(0)).alias(f"_b_{out}") for out in totals]
    )
    within = W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    joined = ranged.join(F.broadcast(before), "_range")
    for out, column in totals.items():
        joined = joined.withColumn(out, F.sum(column).over(within) + F.col(f"_b_{out}"))
    return joined.drop("_range", *[f"_b_{out}" for out in totals])
