"""Parquet scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SMALL_BYTES = 256 << 20


def scan(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def spread_small(df: DataFrame, most_bytes: int = SMALL_BYTES) -> DataFrame:
    """Give a small input one partition per core; leave a larger one as it is scanned.

    A file with one row group is read by one task, and heavy work per row would stay
    there. The exchange moves at most ``most_bytes``; beyond that the scan has tasks
    enough and nothing is shuffled.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > most_bytes:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)
