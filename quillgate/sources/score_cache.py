"""A score cache in hash partitions: adding scores rewrites only the partitions that get a new key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgate.operators.dedup import first_per_key
from quillgate.sources.jsonl import exists
from quillgate.sources.settle import settled

BUCKETS = 256  #: of a new cache


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int").alias("bucket")


def _marker(path: str, buckets: int) -> str:
    return f"{path.rstrip('/')}/_buckets={buckets}"


def buckets_of(spark: SparkSession, path: str) -> int | None:
    """How many partitions the cache was made with; None if there is no cache."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(folder, "_buckets=*")) if exists(spark, path) else None
    return int(found[0].getPath().getName().split("=")[1]) if found else None


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """``key, clean_score, sd, n, bucket``."""
    return spark.read.schema("key string, clean_score double, sd double, n bigint, bucket int").parquet(path)


def add_scores(spark: SparkSession, path: str, fresh: DataFrame, buckets: int = BUCKETS) -> int:
    """Store scores under keys that have none yet; returns the number of partitions written.

    A stored key keeps its value, and of several fresh rows with a key the least one counts.
    Only the partitions of fresh keys are read, and only those with a new key are replaced, each
    at once, so files of other partitions keep their names.
    """
    have = buckets_of(spark, path)
    buckets = have or buckets
    columns = ["key", "clean_score", "sd", "n"]
    least = first_per_key(fresh.select(*columns).filter("key IS NOT NULL"), "key", F.struct("clean_score", "sd", "n"))
    rows = settled(least.select(*columns, _bucket(buckets)))
    if have:
        stored = read_scores(spark, path)
        near = [r[0] for r in rows.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
        new = settled(rows.join(stored.filter(F.col("bucket").isin(near)).select("bucket", "key"), ["bucket", "key"], "left_anti").select(*columns, "bucket"))
        touched = [r[0] for r in new.select("bucket").distinct().collect()]
        if not touched:
            return 0
        rows = settled(stored.filter(F.col("bucket").isin(touched)).unionByName(new))
    else:
        files = spark._jvm.org.apache.hadoop.fs.Path(_marker(path, buckets))
        files.getFileSystem(spark._jsc.hadoopConfiguration()).create(files, True).close()
        touched = [r[0] for r in rows.select("bucket").distinct().collect()]
    # One file for each partition that is written.
    dealt = rows.repartition(max(1, len(touched)), "bucket")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return len(touched)


def answered(spark: SparkSession, path: str, requests: DataFrame) -> DataFrame:
    """Scores of the requested keys that the cache holds."""
    buckets = buckets_of(spark, path)
    if not buckets:
        return spark.createDataFrame([], "key string, clean_score double, sd double, n bigint")
    wanted = requests.select("key").distinct().select("key", _bucket(buckets))
    return wanted.join(read_scores(spark, path), ["bucket", "key"]).drop("bucket")
