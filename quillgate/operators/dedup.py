"""One row per key, decided by an order column.

The winner is found with a partially aggregated ``min_by``/``max_by``, never with a
window: every input partition keeps one candidate per key before the shuffle, so a key
that holds a third of all rows sends one row per partition.  Rows of numbers, flags
and dates are picked column by column, which Spark groups by hashing; a row with a text
or a nested column is picked as one struct, for which Spark sorts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, NumericType, TimestampNTZType, TimestampType

_FIXED_WIDTH = (BooleanType, DateType, NumericType, TimestampNTZType, TimestampType)

def _one_per_key(df: DataFrame, keys: list[str], order: Column, pick) -> DataFrame:
    others = [c for c in df.columns if c not in keys]
    kinds = [df.schema[c].dataType for c in others] + [df.select(order).schema[0].dataType]
    if others and all(isinstance(k, _FIXED_WIDTH) for k in kinds):
        # All columns compare the same orders of the same rows in turn, so they come from one row.
        return df.groupBy(*keys).agg(*[pick(F.col(c), order).alias(c) for c in others]).select(df.columns)
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*keys).agg(pick(row, order).alias("_row")).select("_row.*")


def _as_list(keys: str | list[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def first_per_key(df: DataFrame, keys: str | list[str], order: str | Column) -> DataFrame:
    """Keep the row that comes first.  ``order`` must be unique within a key."""
    order = F.col(order) if isinstance(order, str) else order
    return _one_per_key(df, _as_list(keys), order, F.min_by)


def last_per_key(df: DataFrame, keys: str | list[str], order: str | Column) -> DataFrame:
    """Keep the row that comes last.  ``order`` must be unique within a key."""
    order = F.col(order) if isinstance(order, str) else order
    return _one_per_key(df, _as_list(keys), order, F.max_by)


def index_by(df: DataFrame, key: str, order: str | Column) -> DataFrame:
    """Lookup table: rows without a key dropped, the last row of each key kept."""
    keyed = df.filter(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
    return last_per_key(keyed, key, order)
