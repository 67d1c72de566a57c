"""Raw documents to a stored, embedded chunk table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawlnet.operators import postings
from trawlnet.operators.chunk import OVERLAP, SIZE, chunk
from trawlnet.operators.clean import SECTIONS, clean_sections, entity, unpivot_sections
from trawlnet.operators.embed import Model, embed
from trawlnet.operators.joins import bounded
from trawlnet.operators.postings import Postings, statistics_of, write_postings
from trawlnet.sources.scratch import materialize
from trawlnet.sources.store import (
    RUN_COLUMNS,
    STORE_SCHEMA,
    current,
    digest,
    expire,
    gather_by_year,
    new_version,
    publish,
    run_path,
    version_path,
    write_manifest,
    write_version,
)

_POSTINGS, _STATISTICS = "_postings", "_statistics"


def build_index(
    documents: DataFrame,
    base: str,
    make_model: Callable[[], Model],
    model_name: str,
    key: str | None = None,
    sections: Sequence[str] = SECTIONS,
    size: int = SIZE,
    overlap: int = OVERLAP,
    batch_size: int = 8,
) -> None:
    """Clean, chunk, embed and store wide documents (cik, year, filename, section columns).

    ``filename`` tells apart two filings of one company and year; a split, where there is one,
    tells apart equal names. Both are part of ``chunk_id``.

    Where the run is stored already, a chunk whose text it has gets the vector of that text, and
    the model sees only the others; chunks that are no more in the documents are not in
    the new version. Postings and word statistics (:func:`read_postings`,
    :func:`read_statistics`) belong to the version, which readers find once all of it is written.

    The filters run before the chunker. Chunks are gathered by year before they are embedded,
    so new vectors are not moved.
    """
    spark = documents.sparkSession
    wide = documents if key is None else entity(documents, key)
    name = [F.col(c) for c in ("split", "filename") if c in wide.columns]
    wide = wide.withColumn("filename", F.concat_ws("/", *name))
    sections_long = clean_sections(unpivot_sections(wide, ("cik", "year", "filename"), sections))
    chunks = chunk(sections_long, size=size, overlap=overlap).withColumn("digest", digest("chunk"))
    run, version = run_path(f"{base}/store", model_name, size, overlap), new_version()
    path = version_path(run, version)
    before = current(spark, run)
    if before is None:
        write_version(embed(gather_by_year(chunks), make_model, batch_size=batch_size), path)
    else:
        known = read_version(spark, run, before).where("embedding is not null")
        write_version(with_vectors(chunks, known, make_model, batch_size), path)
    write_postings(read_version(spark, run, version), f"{path}/{_POSTINGS}")
    counted = statistics_of(postings.read_postings(spark, f"{path}/{_POSTINGS}"))
    counted.write.parquet(f"{path}/{_STATISTICS}")
    info = f"{base}/info/config_{model_name}_{size}_{overlap}"
    write_manifest(spark, info, model_name, size, overlap)
    publish(spark, run, version)
    expire(spark, run)


def with_vectors(chunks: DataFrame, known: DataFrame, make_model: Callable[[], Model], batch_size: int = 8) -> DataFrame:
    """Chunks with their vectors: known ones by the digest of the text, the others from the model.

    The chunks are written once, as they are asked for twice. Only digests are compared to find the new ones,
    and a text that many chunks have is one row of the known vectors, so a boilerplate text is a hot
    key on one side only, which adaptive execution splits.
    """
    chunks = materialize(chunks, "chunks")
    new = chunks.select("digest").distinct().join(known.select("digest"), "digest", "left_anti")
    new = materialize(new, "digests")
    fresh = embed(gather_by_year(chunks.join(bounded(new), "digest", "left_semi")), make_model, batch_size=batch_size)
    vectors = known.groupBy("digest").agg(F.first("embedding").alias("embedding"))
    carried = chunks.join(vectors, "digest")
    return fresh.unionByName(gather_by_year(carried))


def read_version(spark: SparkSession, run: str, version: str) -> DataFrame:
    """The chunks of one version, without the settings of its run."""
    fields = [f for f in STORE_SCHEMA if f.name not in RUN_COLUMNS]
    return spark.read.schema(T.StructType(fields)).parquet(version_path(run, version))


def _part(spark: SparkSession, base: str, model: str, size: int, overlap: int, name: str) -> str:
    run = run_path(f"{base}/store", model, size, overlap)
    version = current(spark, run)
    if version is None:
        raise FileNotFoundError(f"no published run in {run}")
    return f"{version_path(run, version)}/{name}"


def read_statistics(spark: SparkSession, base: str, model: str, size: int, overlap: int) -> DataFrame:
    """Word statistics of one stored run, for the ``statistics`` of searches over it."""
    schema = "year string, term string, n_chunks long, n_tokens long"
    return spark.read.schema(schema).parquet(_part(spark, base, model, size, overlap, _STATISTICS))


def read_postings(spark: SparkSession, base: str, model: str, size: int, overlap: int) -> Postings:
    """Postings of one stored run, for searches that read no texts."""
    return postings.read_postings(spark, _part(spark, base, model, size, overlap, _POSTINGS))
