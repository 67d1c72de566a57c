"""Corpus statistics and BM25 term weights, as grouped aggregates and equi-joins.

Statistics are kept per year, so that any year filter is a sum over years and the
corpus is read once, however many filters the queries use.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawlnet.functions import batches, text


@dataclass(frozen=True)
class Bm25:
    """The usual Okapi parameters."""

    k1: float = 1.5
    b: float = 0.75
    epsilon: float = 0.25


def term_counts(chunks: DataFrame, key: str = "chunk_id", column: str = "chunk") -> DataFrame:
    """Term frequency per chunk. The partial count ends in the task that reads the chunk,
    so the shuffle carries each (chunk, term) once."""
    lists = chunks.select(key, batches.words(F.lower(column)).alias("terms"))
    words = lists.select(key, F.explode("terms").alias("term"))
    return words.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def _count_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Chunks per (year, term) in one batch, and for each year a row with term NULL."""
    flat, lengths = batches.split_words(batch.column("text"))
    words = flat.dictionary_encode()
    years = batch.column("year").dictionary_encode(null_encoding="encode")
    year = years.indices.to_numpy()
    width = len(words.dictionary) + 1  # the last place stands for the whole year
    row = np.repeat(np.arange(len(lengths)), lengths)
    cells = np.sort(row * width + words.indices.to_numpy(), kind="stable")
    first = np.ones(len(cells), dtype=bool)
    first[1:] = cells[1:] != cells[:-1]
    row, term = np.divmod(cells[first], width)
    pairs = np.concatenate([year[row].astype(np.int64) * width + term, year * width + width - 1])
    pairs, n_chunks = np.unique(pairs, return_counts=True)
    place, term = np.divmod(pairs, width)
    whole = term == width - 1
    n_tokens = np.zeros(len(pairs), dtype=np.int64)
    n_tokens[whole] = np.bincount(year, weights=lengths).astype(np.int64)
    terms = pa.array(term, mask=whole)
    columns = [
        years.dictionary.take(pa.array(place)),
        words.dictionary.cast(pa.string()).take(terms),
        pa.array(n_chunks),
        pa.array(n_tokens),
    ]
    return pa.RecordBatch.from_arrays(columns, ["year", "term", "n_chunks", "n_tokens"])


def year_statistics(
    chunks: DataFrame, column: str = "chunk", year: str = "year"
) -> DataFrame:
    """Rows (year, term, n_chunks, n_tokens); term NULL stands for the whole year.

    For a term ``n_chunks`` is its document frequency. The NULL row holds the number of
    chunks and of tokens of the year, so one scan and one shuffle give everything. Terms
    are counted per Arrow batch and again per task before the shuffle: a stop word or a
    year that holds much of the corpus arrives as one row per task.
    """
    rows = chunks.select(
        F.col(year).cast("string").alias("year"), F.lower(F.col(column)).alias("text")
    )

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return (_count_batch(piece) for part in parts for piece in batches.pieces(part))

    schema = "year string, term string, n_chunks long, n_tokens long"
    counted = rows.mapInArrow(count, schema)
    return counted.groupBy("year", "term").agg(
        F.sum("n_chunks").alias("n_chunks"), F.sum("n_tokens").alias("n_tokens")
    )


def filter_statistics(statistics: DataFrame, filters: Sequence[Sequence[str]]) -> DataFrame:
    """Year statistics summed per filter: (filter_id, term, n_chunks, n_tokens).

    ``filters`` are lists of years, numbered from 0; an empty list keeps every year. The
    driver holds them, so their (filter, year) pairs are small enough to broadcast.
    """
    counted = [F.sum(c).alias(c) for c in ("n_chunks", "n_tokens")]
    sums = []
    pairs = [(i, year) for i, years in enumerate(filters) for year in set(years)]
    if pairs:
        ids, years = zip(*pairs, strict=True)
        listed = pa.table({"filter_id": pa.array(ids, pa.int32()), "year": pa.array(years)})
        per_year = statistics.join(
            F.broadcast(statistics.sparkSession.createDataFrame(listed)), "year"
        )
        sums.append(per_year.groupBy("filter_id", "term").agg(*counted))
    open_ids = [F.lit(i) for i, years in enumerate(filters) if not years]
    if open_ids or not pairs:
        whole = statistics.groupBy("term").agg(*counted)
        each = F.explode(F.array(*open_ids).cast("array<int>")).alias("filter_id")
        sums.append(whole.select(each, "term", "n_chunks", "n_tokens"))
    return reduce(DataFrame.unionByName, sums)


def raw_idf(n_chunks: Column, frequency: Column) -> Column:
    return F.log(n_chunks - frequency + 0.5) - F.log(frequency + 0.5)


def corpus_totals(filtered: DataFrame) -> DataFrame:
    """Per filter: number of chunks and mean chunk length in tokens."""
    return filtered.where(F.col("term").isNull()).select(
        "filter_id",
        F.col("n_chunks").alias("corpus_chunks"),
        F.try_divide(F.col("n_tokens"), F.col("n_chunks")).alias("avg_length"),
    )


def with_idf(filtered: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """Add the raw idf of every term; a term in more than half of the chunks is negative.

    The totals are one row per filter and always broadcast: a shuffle on ``filter_id``
    would send the whole vocabulary of a filter to one task.
    """
    terms = filtered.where(F.col("term").isNotNull())
    per_filter = corpus_totals(filtered) if totals is None else totals
    joined = terms.join(F.broadcast(per_filter), "filter_id")
    return joined.withColumn("idf", raw_idf(F.col("corpus_chunks"), F.col("n_chunks")))


def idf_summary(filtered: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """Per filter: chunks, mean length, number of terms, mean raw idf over all terms."""
    return (
        with_idf(filtered, totals)
        .groupBy("filter_id", "corpus_chunks", "avg_length")
        .agg(F.count(F.lit(1)).alias("n_terms"), F.avg("idf").alias("mean_idf"))
    )


def query_terms(queries: DataFrame) -> DataFrame:
    """Terms of each query with their multiplicity ``qtf``."""
    words = queries.select("query_id", "filter_id", F.explode(text.tokens("prompt")).alias("term"))
    return words.groupBy("query_id", "filter_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


def query_weights(
    asked: DataFrame, filtered: DataFrame, params: Bm25, totals: DataFrame | None = None
) -> DataFrame:
    """Weight of every query term that the filtered corpus knows: floored idf times qtf.

    A negative idf is replaced by ``epsilon`` times the mean idf of all terms. ``asked``
    are the :func:`query_terms` of one block of queries, bounded by the block size, so
    they go to the vocabulary and the vocabulary stays where it is.
    """
    known = with_idf(filtered, totals).join(F.broadcast(asked), ["filter_id", "term"])
    means = idf_summary(filtered, totals).select("filter_id", "mean_idf")
    floored = F.when(F.col("idf") < 0, params.epsilon * F.col("mean_idf")).otherwise(F.col("idf"))
    return known.join(F.broadcast(means), "filter_id").select(
        "query_id", "term", (floored * F.col("qtf")).alias("weight")
    )
