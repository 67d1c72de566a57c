"""The chunk store: a parquet table keyed by run settings and year, plus a manifest.

A run has a folder, each of its versions a folder in that, and a pointer file that names the version
to read. What belongs to a version lies inside it, in folders that a scan of its chunks passes by.
"""

from __future__ import annotations

import time
import uuid
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RUN_COLUMNS = ("embedding_model", "chunk_size", "chunk_overlap")
_POINTER = "_current"  # file that names the published version of a run
HISTORY = 20  # versions that the pointer goes back

STORE_SCHEMA = T.StructType(
    [
        T.StructField("chunk_id", T.StringType()),
        T.StructField("cik", T.StringType()),
        T.StructField("filename", T.StringType()),
        T.StructField("section", T.StringType()),
        T.StructField("chunk", T.StringType()),
        T.StructField("digest", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.DoubleType())),
        T.StructField("embedding_model", T.StringType()),
        T.StructField("chunk_size", T.IntegerType()),
        T.StructField("chunk_overlap", T.IntegerType()),
        T.StructField("year", T.StringType()),
    ]
)


def write_store(chunks: DataFrame, base: str, model: str, size: int, overlap: int) -> None:
    """Replace all chunks of this run, leave other runs alone.

    The new version is written beside the old one and takes its place when it is complete
    (:func:`publish`). Chunks without a filename get an empty one, those without a digest theirs.
    Rows are written by the tasks that hold them. Gather them by year before the vectors
    are added (:func:`gather_by_year`), or each task writes a small file per year.
    """
    spark, run, version = chunks.sparkSession, run_path(base, model, size, overlap), new_version()
    write_version(chunks, version_path(run, version))
    publish(spark, run, version)
    expire(spark, run)


def write_version(chunks: DataFrame, path: str) -> None:
    """Write the chunks of one version of a run, which no reader sees yet."""
    if "filename" not in chunks.columns:
        chunks = chunks.withColumn("filename", F.lit(""))
    if "digest" not in chunks.columns:
        chunks = chunks.withColumn("digest", digest("chunk"))
    columns = [c for c in STORE_SCHEMA.fieldNames() if c not in RUN_COLUMNS]
    chunks.select(columns).write.partitionBy("year").parquet(path)


def digest(column: str) -> Column:
    """Identity of what a model sees of a chunk."""
    return F.sha2(F.col(column), 256)


def run_path(base: str, model: str, size: int, overlap: int) -> str:
    """The folder of a run, named as partitions are."""
    values = quote(model, safe=""), size, overlap
    return "/".join([base, *(f"{c}={v}" for c, v in zip(RUN_COLUMNS, values, strict=True))])


def new_version() -> str:
    """A name for a version; later ones sort behind earlier ones."""
    return f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"


def version_path(run: str, version: str) -> str:
    return f"{run}/version={version}"


def publish(spark: SparkSession, run: str, version: str) -> None:
    """Make a complete version of a run the one that readers find, in one step.

    The pointer is written beside the old one and renamed over it, which a file system does
    whole or not at all. A job that dies before that leaves the old version as it was.
    """
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path
    target = path(f"{run}/{_POINTER}")
    beside = path(f"{run}/{_POINTER}-{version}")
    stream = beside.getFileSystem(spark._jsc.hadoopConfiguration()).create(beside)
    stream.write(bytearray("\n".join([version, *published(spark, run)][:HISTORY]).encode()))
    stream.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    context.rename(context.makeQualified(beside), context.makeQualified(target), how)


def current(spark: SparkSession, run: str) -> str | None:
    """The published version of a run, if there is one."""
    return next(iter(published(spark, run)), None)


def published(spark: SparkSession, run: str) -> list[str]:
    """The published version of a run and those before it, as far as the pointer goes back."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{run}/{_POINTER}")
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(place):
        return []
    stream = files.open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split("\n")
    finally:
        stream.close()


def runs_below(
    spark: SparkSession, base: str, model: str | None = None, size: int | None = None, overlap: int | None = None
) -> list[str]:
    """Folders of the published runs with these settings. One entry per run, so they are few."""
    values = [quote(model, safe="") if model is not None else "*", *("*" if v is None else v for v in (size, overlap))]
    pattern = "/".join([base, *(f"{c}={v}" for c, v in zip(RUN_COLUMNS, values, strict=True)), _POINTER])
    place = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place) or []
    return sorted(status.getPath().getParent().toString() for status in found)


def expire(spark: SparkSession, run: str, keep: int = 2) -> None:
    """Delete what came before the published version, but for the last ``keep`` - 1 published ones.

    Readers that found a version before the last publication can go on with it. Versions
    behind the published one may be in the making and stay; those that a failed writer has left go
    with the next publication.
    """
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{run}/version=*")
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    kept = published(spark, run)[:keep]
    for status in files.globStatus(place) or []:
        version = status.getPath().getName().partition("=")[2]
        if kept and version < kept[0] and version not in kept:
            files.delete(status.getPath(), True)


def gather_by_year(chunks: DataFrame) -> DataFrame:
    """Bring the chunks of a year together in even partitions.

    AQE cuts a year that holds much of the corpus into several partitions and merges
    small years, so the files come out even and so do the model calls of the embedding.
    """
    return chunks.hint("rebalance", "year")


def read_store(
    spark: SparkSession,
    base: str,
    model: str | None = None,
    size: int | None = None,
    overlap: int | None = None,
) -> DataFrame:
    """Scan the published version of each run, or of the runs with the settings given.

    A reader keeps the version that it has found, whatever is published meanwhile. The
    declared schema keeps ``year`` a string: partition inference would turn it into a number and
    string filters would no longer prune.
    """
    paths = [version_path(run, current(spark, run)) for run in runs_below(spark, base, model, size, overlap)]
    if not paths:
        return spark.createDataFrame([], STORE_SCHEMA)
    found = spark.read.schema(STORE_SCHEMA).option("basePath", base).parquet(*paths)
    return found.select(STORE_SCHEMA.fieldNames())


def write_manifest(spark: SparkSession, path: str, model: str, size: int, overlap: int) -> None:
    values = zip(RUN_COLUMNS, (model, size, overlap), strict=True)
    row = spark.range(1, numPartitions=1).select(*[F.lit(v).alias(name) for name, v in values])
    row.write.mode("overwrite").json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Read one manifest, or all below ``path``; indented JSON objects are fine too."""
    schema = T.StructType([STORE_SCHEMA[name] for name in RUN_COLUMNS])
    reader = spark.read.schema(schema).option("multiLine", True)
    return reader.option("recursiveFileLookup", True).json(path)
