"""Intermediate tables in the shared folder of the cluster."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


_held: dict[str, list[str]] = {}  # folders of the sessions that this driver has run, and the tables in them


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``, which the driver deletes when it ends.

    A machine-local folder is used only by a session whose executors are threads of the driver,
    and only if it has no such setting: on a cluster other executors could not see it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="trawlnet-")
    own = f"{root}/trawlnet-{spark.sparkContext.applicationId}"
    held = _held.setdefault(own, [])
    if not held:  # the folder of the session is there before its tables: what a failed job leaves goes, too
        place = spark._jvm.org.apache.hadoop.fs.Path(own)
        files = place.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(place)
        files.deleteOnExit(place)
    held.append(f"{own}/{label}-{uuid.uuid4().hex}")
    return held[-1]


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Delete what the block has written as scratch once it ends, be it by an error.

    Results of the block that read such tables have to be consumed inside it. The driver deletes, so the
    loss of an executor changes nothing; what other sessions or earlier steps wrote stays.
    """
    before = {own: len(held) for own, held in _held.items()}
    try:
        yield
    finally:
        for own, held in _held.items():
            for path in held[before.get(own, 0) :]:
                if "/package-" in path:  # executors that come later load it
                    continue
                place = spark._jvm.org.apache.hadoop.fs.Path(path)
                place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and read it back.

    Used where several later steps need the same expensive table: the files survive the
    loss of executors and the reads prune columns and push filters down.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
