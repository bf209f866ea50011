"""What several operators share: table reading, columns of given types, settling tables.

Tables may carry more columns than an operator needs, under any name.  Every operator
first selects the columns it works on, so extra columns never clash with its own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgate.sources.settle import checkpoint_dir

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents_of(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` and ``text`` in fixed types, then the named columns as they are."""
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), *[F.col(c) for c in more])


def carried(docs: DataFrame) -> DataFrame:
    """``whole``, every column of ``docs`` in one struct, and ``row``, a hash of id and text.

    Operators that return the rows they got work beside the struct, so that no column of
    theirs can clash with one of the table's, and the text is carried once.
    """
    row = F.xxhash64(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), row.alias("row"))


def fields(columns: list[str], **changed: Column) -> list[Column]:
    """The columns of ``whole`` again, some of them replaced."""
    return [(changed[c] if c in changed else F.col("whole").getField(c)).alias(c) for c in columns]


def written(df: DataFrame, name: str, sort: list[str] | None = None) -> DataFrame:
    """Write a table once in the shared folder and read it back.

    It cuts lineage like ``checkpoint()``, and the columnar file lets each later reader take
    only the columns it needs.  The folder is new for every call.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    out = df.sortWithinPartitions(*sort) if sort else df
    out.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def wide_hash(column: Column, name: str = "h") -> list[Column]:
    """Two independent 64-bit hashes: 128 bits, so that equal hashes mean equal values."""
    return [
        F.xxhash64(column).alias(f"{name}1"),
        F.xxhash64(F.lit(7_919), column).alias(f"{name}2"),
    ]


def ascii_lower(column: Column) -> Column:
    """Lower-case A-Z only; other letters stay.  ASCII texts take the quicker way."""
    translated = F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.octet_length(column) == F.char_length(column), F.lower(column)).otherwise(translated)


def bound(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, as a lambda variable.

    An expression used inside a lambda would otherwise be computed again for every element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
