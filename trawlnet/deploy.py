"""Make the package importable in the Python workers of a session."""

from __future__ import annotations

import io
import os
import zipfile

from pyspark.sql import SparkSession

from trawlnet.sources.scratch import scratch_path

_FILE = "trawlnet.zip"


def ship(spark: SparkSession) -> None:
    """Put this package into the shared folder and have the workers load it, once per session.

    Not needed where it is installed on every node.
    """
    context = spark.sparkContext
    if any(os.path.basename(f) == _FILE for f in context.listFiles):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = io.BytesIO()
    with zipfile.ZipFile(archive, "w") as target:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    target.write(path, os.path.relpath(path, os.path.dirname(package)))
    path = f"{scratch_path(spark, 'package')}/{_FILE}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place)
    stream.write(bytearray(archive.getvalue()))
    stream.close()
    context.addPyFile(path)
