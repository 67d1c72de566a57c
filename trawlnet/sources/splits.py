"""Raw document splits: landing, scanning, tagging, union."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _finished(spark: SparkSession, path: str) -> bool:
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    filesystem = marker.getFileSystem(spark._jsc.hadoopConfiguration())
    return filesystem.exists(marker)


def land_splits(splits: Mapping[str, DataFrame], base: str) -> list[str]:
    """Write each split below ``base`` unless a finished copy is there already.

    Returns the names written. A folder without its success marker is the remainder of a
    broken run and is written again.
    """
    written = []
    for name, df in splits.items():
        path = f"{base}/{name}"
        if not _finished(df.sparkSession, path):
            df.write.mode("overwrite").parquet(path)
            written.append(name)
    return written


def tag_and_union(splits: Mapping[str, DataFrame], tag: str = "split") -> DataFrame:
    """Union by column name; each row says which split it came from."""
    tagged = [df.withColumn(tag, F.lit(name)) for name, df in splits.items()]
    return reduce(DataFrame.unionByName, tagged)


def read_splits(spark: SparkSession, base: str, names: Sequence[str]) -> DataFrame:
    """Scan landed splits as one tagged table."""
    scans = {name: spark.read.format("parquet").load(f"{base}/{name}") for name in names}
    return tag_and_union(scans)
