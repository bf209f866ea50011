"""JSON-lines and Parquet scans and sinks."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from quillgate.operators.dedup import last_per_key

ORDER = "_ord"
_BAD = "_bad_line"
# Where an appended line stands: its append, then its row in it.  File names say nothing about either.
_APPEND, _LINE = "_append", "_line"
_PLACE = [StructField(_APPEND, LongType()), StructField(_LINE, LongType())]
_ORDER_TYPE = "struct<append:bigint,line:bigint,file:string,block:bigint,row:bigint>"


def _hadoop_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    return jvm.org.apache.hadoop.fs.Path(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = _hadoop_path(spark, path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def nonempty(spark: SparkSession, path: str) -> bool:
    """The path exists and holds at least one byte of data; an empty output is legal."""
    if not exists(spark, path):
        return False
    p = _hadoop_path(spark, path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getContentSummary(p).getLength() > 0


def is_complete(spark: SparkSession, path: str) -> bool:
    """An output directory counts as done only when the job committed it."""
    return exists(spark, path.rstrip("/") + "/_SUCCESS")


def with_file_order(df: DataFrame) -> DataFrame:
    """Turn the append columns into ``_ord``.

    Lines come in order of their append and row; lines that another writer left come
    first, by file, offset of the split in the file, and row within the split.
    """
    order = F.struct(
        F.coalesce(_APPEND, F.lit(0)).alias("append"),
        F.coalesce(_LINE, F.lit(0)).alias("line"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    return df.withColumn(ORDER, order).drop(_APPEND, _LINE)


def read_jsonl(spark: SparkSession, path: str, schema: StructType, ordered: bool = False) -> DataFrame:
    """Strict scan: a missing path is an empty table, a malformed line fails the job."""
    if not exists(spark, path):
        empty = spark.createDataFrame([], schema)
        return empty.withColumn(ORDER, F.lit(None).cast(_ORDER_TYPE)) if ordered else empty
    wide = StructType([*schema.fields, *_PLACE]) if ordered else schema
    df = spark.read.schema(wide).option("mode", "FAILFAST").json(path)
    return with_file_order(df) if ordered else df


def first_lines(spark: SparkSession, path: str, schema: StructType, n: int) -> DataFrame:
    """The first ``n`` rows in input order; 0 keeps all."""
    rows = read_jsonl(spark, path, schema, ordered=True)
    return (rows.orderBy(ORDER).limit(n) if n else rows).drop(ORDER)


def read_tolerant(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Scan that skips malformed lines (a half-written last line); keeps ``_ord``."""
    if not exists(spark, path):
        return read_jsonl(spark, path, schema, ordered=True)
    wide = StructType([*schema.fields, *_PLACE, StructField(_BAD, StringType())])
    df = (
        spark.read.schema(wide)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", _BAD)
        .json(path)
    )
    return with_file_order(df).filter(F.col(_BAD).isNull()).drop(_BAD)


def read_progress(spark: SparkSession, path: str, schema: StructType, key: str = "qid") -> DataFrame:
    """Tolerant scan, null keys dropped, the later line replacing the earlier one."""
    rows = read_tolerant(spark, path, schema).filter(F.col(key).isNotNull())
    return last_per_key(rows, key, ORDER).drop(ORDER)


def done_keys(spark: SparkSession, path: str, key: str = "query") -> DataFrame:
    schema = StructType([StructField(key, StringType())])
    return read_tolerant(spark, path, schema).select(key).filter(F.col(key).isNotNull()).distinct()


def write_jsonl(df: DataFrame, path: str) -> None:
    """Replace the output in one committed job."""
    df.write.mode("overwrite").json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    """Add rows behind all earlier ones.  Appends are numbered by the clock of the driver."""
    placed = df.withColumn(_APPEND, F.lit(time.time_ns())).withColumn(_LINE, F.monotonically_increasing_id())
    placed.write.mode("append").json(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)
