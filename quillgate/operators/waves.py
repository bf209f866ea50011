"""Early stop that saves work: items are gated and scored in waves of seeded order.

Only the keys of all items are hashed and ordered.  A wave is a range of the hash order; the
work is done for its items, written, and the next wave starts only if too few were selected.
Waves grow, so that a target far away takes few of them, and a wave that was written is never
done again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgate.operators.joins import not_done
from quillgate.operators.ranking import _place, gather_until, hash_at_rank
from quillgate.sources.jsonl import exists
from quillgate.sources.settle import checkpoint_dir, shuffles_cleaned, stored


@dataclass(frozen=True)
class Gathered:
    """``rows`` of the items up to the chunk that reached the target; what it took to get them."""

    rows: DataFrame
    scored: int  #: items whose work was done by this call
    waves: int
    reached: bool


def gather_in_waves(items: DataFrame, work: Callable[[DataFrame], DataFrame], key: str, selected: str, target: int, chunk: int,
                    seed: int = 42, folder: str | None = None, first_chunks: int = 1, growth: float = 2.0) -> Gathered:
    """``work(items)`` for as many items, in seeded order, as it takes to get ``target`` selected rows.

    ``work`` returns at most one row for each item, with ``key`` and the flag ``selected``; it sees
    the items of one wave at a time.  A wave holds whole chunks, ``first_chunks`` and then
    ``growth`` times as many.  The rows are those of ``gather_until`` over the results of all
    items: what lies beyond the chunk that reached the target is scored at most, never returned.

    ``folder`` keeps the waves: a later call with it does the work for new items only and returns
    the stored rows as well.  A wave without its success marker is done again.  ``target`` 0 or
    less takes all items in one wave.  ``key`` must be unique; a null key is an item like others.
    """
    spark = items.sparkSession
    folder = folder or f"{checkpoint_dir(spark).rstrip('/')}/waves-{uuid.uuid4().hex}"
    wave = 0
    while exists(spark, f"{folder}/wave={wave:05d}/_SUCCESS"):
        wave += 1
    resumed = _stored(items, folder, wave, key)
    todo = items if resumed is None else not_done(items, resumed, key)
    order = stored(todo.select(key, _place(seed, key).alias("_hash")), "order")
    already = 0 if resumed is None else _hits(resumed, selected)
    hits, last, chunks, first_wave = already, "", first_chunks, wave
    while target <= 0 or hits < target:
        ahead = order.filter(F.col("_hash") > last)
        edge = None if target <= 0 else hash_at_rank(ahead, "_hash", chunks * chunk).first()
        upto = edge[0] if edge else "g"  # after every hexadecimal hash
        if not edge and ahead.isEmpty():
            break
        mine = todo.filter((_place(seed, key) > last) & (_place(seed, key) <= upto))
        path = f"{folder}/wave={wave:05d}"
        made = work(mine)
        with shuffles_cleaned(spark):
            made.write.mode("overwrite").parquet(path)
        hits += _hits(spark.read.parquet(path), selected)
        last, wave, chunks = upto, wave + 1, max(chunks, round(chunks * growth))
        if not edge:
            break
    done = order.filter(F.col("_hash") <= last)
    reached = 0 < target <= hits
    rows = _stored(items, folder, wave, key)
    if rows is None:  # nothing to do: the work's columns without rows
        return Gathered(work(items.limit(0)), 0, 0, reached)
    if wave > first_wave:
        # Chunks are counted in items, also in those that the work returned no row for.
        new = rows if resumed is None else not_done(rows, resumed, key)
        flags = done.join(new.select(F.col(key).alias("_k"), F.col(selected).alias("_s")), F.col(key).eqNullSafe(F.col("_k")), "left")
        flags = stored(flags.select(key, F.coalesce("_s", F.lit(False)).alias("_s")), "flags")
        stay = gather_until(flags, key, "_s", target if target <= 0 else target - already, chunk, seed).select(F.col(key).alias("_k"))
        new = new.join(stay, F.col(key).eqNullSafe(F.col("_k")), "left_semi")
        rows = new if resumed is None else resumed.unionByName(new)
    return Gathered(rows, done.count(), wave - first_wave, reached)


def _stored(items: DataFrame, folder: str, waves: int, key: str) -> DataFrame | None:
    if not waves:
        return None
    return items.sparkSession.read.parquet(*[f"{folder}/wave={k:05d}" for k in range(waves)])


def _hits(rows: DataFrame, selected: str) -> int:
    return rows.agg(F.count_if(selected)).first()[0]
