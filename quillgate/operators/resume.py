"""Resume against many finished keys: a small filter settles most items before any shuffle.

The filter is a blocked Bloom filter in a table.  A key's hash picks one block of 4,096 bits and
five bits in it, so a probe is one broadcast equi-join and five bit tests.  A bit that is not set
proves that a key is new; only keys whose bits are all set meet the finished keys, and they do so
without the other columns of their rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgate.sources.settle import settled, stored

BLOCK_WORDS = 64  # 64-bit words of a block
PROBES = 5  # twelve bits of one hash each
MOST_BLOCKS = 1 << 18  # about 140 MB: the largest filter that is broadcast


def _bits(key: Column) -> list[Column]:
    """Places 0 to 4095 of a key in its block."""
    h = F.xxhash64(key, F.lit(1))
    return [F.shiftrightunsigned(h, 12 * i).bitwiseAND(F.lit(64 * BLOCK_WORDS - 1)).cast("int") for i in range(PROBES)]


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def key_filter(done: DataFrame, key: str, blocks: int = 1 << 14) -> DataFrame:
    """``block, words`` of the keys, written once; at most ``blocks`` rows of 512 bytes, however many keys.

    The default of eight megabytes knows seven million keys with about one false alarm in a
    hundred.  With far more keys it gets full and settles less; the rows of ``remaining`` stay the same.
    """
    if not 0 < blocks <= MOST_BLOCKS:
        raise ValueError(f"blocks must be from 1 to {MOST_BLOCKS}, not {blocks}")
    k = F.col(key)
    bits = done.filter(k.isNotNull()).select(_block(k, blocks).alias("block"), F.explode(F.array(*_bits(k))).alias("_bit"))
    words = bits.groupBy("block", F.shiftright("_bit", 6).alias("_word")).agg(
        F.bit_or(F.expr("shiftleft(1L, _bit & 63)")).alias("_mask")
    )
    # A block has at most 64 words.
    packed = words.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("_word", "_mask"))).alias("_m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(BLOCK_WORDS - 1)), lambda i: F.coalesce(F.element_at("_m", i), F.lit(0).cast("bigint")))
    return settled(packed.select("block", dense.alias("words")))


def with_alarm(items: DataFrame, known: DataFrame, key: Column, blocks: int = 1 << 14, alarm: str = "_alarm") -> DataFrame:
    """Items with a flag: false proves that the key is not among the known ones."""
    placed = items.withColumn("_block", _block(key, blocks))
    found = placed.join(F.broadcast(known.withColumnRenamed("block", "_block").withColumnRenamed("words", "_words")), "_block", "left")
    hit = key.isNotNull()
    for bit in _bits(key):
        hit = hit & (F.getbit(F.get("_words", F.shiftright(bit, 6)), bit.bitwiseAND(F.lit(63))) == 1)
    return found.withColumn(alarm, F.coalesce(hit, F.lit(False))).drop("_block", "_words")


def remaining(items: DataFrame, done: DataFrame, key: str, blocks: int = 1 << 14) -> DataFrame:
    """The rows of ``not_done``: items whose key has no result yet; rows without a key are kept.

    Keys with an alarm are compared with the finished ones, keys alone.  Those that turn out to be
    new are few (false alarms) and are written, so that their known size decides how they are
    joined back; whole rows are shuffled only if there are too many of them to be broadcast.
    Reads ``items`` twice, which must give the same rows both times.
    """
    # Both sides hash one type, the one that a join would compare them in.
    kind = items.select(key).union(done.select(key)).schema[0].dataType
    k = F.col(key).cast(kind)
    known = key_filter(done.select(k.alias(key)), key, blocks)
    flagged = with_alarm(items, known, k, blocks)
    doubtful = with_alarm(items.select(key), known, k, blocks).filter("_alarm").select(key).distinct()
    false_alarms = stored(doubtful.join(done.select(key), key, "left_anti"), "false-alarms")
    sure = flagged.filter(~F.col("_alarm")).drop("_alarm")
    return sure.unionByName(flagged.filter("_alarm").drop("_alarm").join(false_alarms, key, "left_semi").select(*items.columns))
