"""BM25 search over stored postings: no text is read, and blocks that cannot matter are skipped.

Chunks are numbered within ranges. A block holds the postings of one term in one range, and
its maxima: the largest term frequency and the shortest chunk. They bound what the
term can add to any chunk of the range under every year filter, so the sum over the terms of
a question bounds the scores of the whole range. Blocks are stored by term, those with the
highest impact first.

A search goes in two waves. The first one scores a share of the ranges, whose k-th best score is a
floor for each question. For the others only the maxima are read; a range of which no question can
reach its floor is left out, and of the rest only blocks of terms of questions that can
are read and scored. Floors and maxima leave nothing out that could be among the best k, so the
result is that of a scan over all texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from trawlnet.functions.batches import pieces, sized, split_words
from trawlnet.operators import ranking, search
from trawlnet.operators.joins import bounded
from trawlnet.operators.lexical import Bm25
from trawlnet.sources.scratch import materialize

RANGE_CHUNKS = 4096  # chunks of a range; their numbers take two bytes
RANGE_BYTES = 16 << 20  # of texts of a range
BATCH_BYTES = 8 << 20  # of texts that are cut into ranges together, however small the batches
BUCKETS = 16  # folders of terms
FIRST = 16  # one range in so many is in the first wave
_CELLS = 1 << 21  # entries of one work matrix inside a task
_NEAR = 1e-8  # what rounding can add to a bound
_BLOCK = "range long, year string, term string, n int, max_tf int, min_length int, places binary, counts binary"
_RANGE = ("range", "year", "ids", "lengths")


@dataclass(frozen=True)
class Postings:
    """Blocks of postings, and the ranges with the ids and lengths of their chunks, all of one year."""

    blocks: DataFrame
    ranges: DataFrame


def _schema(id_type: T.DataType) -> T.StructType:
    ids = T.StructField("ids", T.ArrayType(id_type))
    return T.StructType([*T.StructType.fromDDL(_BLOCK), ids, *T.StructType.fromDDL("lengths array<int>")])


def _little(values: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Little-endian bytes of each value, as many as ``width`` says."""
    begin = np.cumsum(width) - width
    out = np.empty(int(width.sum()), np.uint8)
    for j in range(int(width.max(initial=0))):
        at = np.flatnonzero(width > j)
        out[begin[at] + j] = values[at] >> 8 * j & 255
    return out


def _binary(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _range_rows(batch: pa.RecordBatch, columns: dict[str, pa.DataType]) -> Iterator[pa.RecordBatch]:
    """The blocks of one range, and a row for the range itself."""
    batch = batch.take(pc.sort_indices(batch.column("chunk_id")))
    flat, lengths = split_words(batch.column("text"))
    words, n = flat.dictionary_encode(), batch.num_rows
    cells = words.indices.to_numpy().astype(np.int64) * n + np.repeat(np.arange(n), lengths)
    cells, tf = np.unique(cells, return_counts=True)
    code, place = np.divmod(cells, n)
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.empty(0, np.int64)
    count = np.diff(np.append(first, len(code)))
    most = np.maximum.reduceat(tf, first) if len(first) else tf
    shortest = np.minimum.reduceat(lengths[place], first) if len(first) else tf
    width = np.where(most < 1 << 8, 1, np.where(most < 1 << 16, 2, 4))
    name = repr(batch.column("chunk_id")[0].as_py()).encode()
    number = int.from_bytes(hashlib.sha256(name).digest()[:8], "little") >> 1
    year = batch.column("year")[0].as_py()
    blocks = {
        "range": pa.repeat(number, len(first)),
        "year": pa.array([year] * len(first), pa.string()),
        "term": words.dictionary.take(pa.array(code[first])),
        "n": count,
        "max_tf": most,
        "min_length": shortest,
        "places": _binary(_little(place, np.full(len(place), 2)), 2 * count),
        "counts": _binary(_little(tf, np.repeat(width, count)), width * count),
    }
    whole = {
        "range": [number],
        "year": [year],
        "ids": [batch.column("chunk_id").to_pylist()],
        "lengths": [lengths],
    }
    for rows, size in ((blocks, len(first)), (whole, 1)):
        made = [pa.array(rows[c]).cast(t) if c in rows else pa.nulls(size, t) for c, t in columns.items()]
        yield from pa.Table.from_arrays(made, names=list(columns)).to_batches(max_chunksize=1 << 16)


def write_postings(chunks: DataFrame, path: str, range_chunks: int = RANGE_CHUNKS) -> None:
    """Index chunks (chunk_id, chunk, optional year) below ``path``.

    The texts are read once, and blocks, not texts, are moved: a term that is in every
    chunk has one row per range, and its rows are spread over as many files as they fill.
    """
    year = F.col("year").cast("string") if "year" in chunks.columns else F.lit(None).cast("string")
    rows = chunks.select("chunk_id", year.alias("year"), F.coalesce(F.lower("chunk"), F.lit("")).alias("text"))
    schema = _schema(chunks.schema["chunk_id"].dataType)
    columns = {f.name: f.type for f in to_arrow_schema(schema)}

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized(batches, BATCH_BYTES):
            for year in pc.unique(batch.column("year")):
                mine = batch.filter(pc.equal(batch.column("year"), year) if year.is_valid else batch.column("year").is_null())
                for start in range(0, mine.num_rows, range_chunks):
                    for piece in pieces(mine.slice(start, range_chunks), RANGE_BYTES):
                        yield from _range_rows(piece, columns)

    made = materialize(rows.mapInArrow(index, schema), "postings")
    ranges = made.where("ids is not null").select(*_RANGE)
    ranges.write.mode("overwrite").parquet(f"{path}/ranges")
    blocks = made.where("term is not null").select(*T.StructType.fromDDL(_BLOCK).names, _bucket())
    impact = F.col("max_tf") / (F.col("max_tf") + F.col("min_length"))
    blocks = blocks.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", impact.desc())
    blocks.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/blocks")


def statistics_of(postings: Postings) -> DataFrame:
    """The :func:`lexical.year_statistics` of the indexed chunks, from the blocks alone."""
    terms = postings.blocks.groupBy("year", "term").agg(
        F.sum("n").cast("long").alias("n_chunks"), F.lit(0).cast("long").alias("n_tokens")
    )
    n_tokens = F.aggregate("lengths", F.lit(0).cast("long"), lambda total, n: total + n)
    years = postings.ranges.groupBy("year").agg(F.sum(F.size("ids")).alias("n_chunks"), F.sum(n_tokens).alias("n_tokens"))
    return terms.unionByName(years.withColumn("term", F.lit(None).cast("string")))


def _bucket():
    return F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int").alias("bucket")


def read_postings(spark: SparkSession, path: str, id_type: T.DataType = T.StringType()) -> Postings:
    schema = _schema(id_type)
    ranges = T.StructType([schema[c] for c in _RANGE])
    blocks = T.StructType.fromDDL(f"{_BLOCK}, bucket int")
    return Postings(spark.read.schema(blocks).parquet(f"{path}/blocks"), spark.read.schema(ranges).parquet(f"{path}/ranges"))


def _saturation(tf: np.ndarray, length: np.ndarray, average: float, params: Bm25) -> np.ndarray:
    return tf * (params.k1 + 1) / (tf + params.k1 * (1 - params.b + params.b * length / average))


def _pairs(group: search._Group, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per place of ``word``: all its (term, question) pairs of the group."""
    counts = group.first[word + 1] - group.first[word]
    ends = np.cumsum(counts)
    inside = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)
    return np.repeat(np.arange(len(word)), counts), np.repeat(group.first[word], counts) + inside


def _everywhere(group: search._Group) -> np.ndarray:
    """Questions with a negative weight: chunks without their terms are better than some with them."""
    out = np.zeros(len(group.ids), bool)
    out[group.columns[group.weights < 0]] = True
    return out


def _alive(group: search._Group, word, max_tf, min_length, params: Bm25) -> np.ndarray:
    """Questions of which a chunk of the range can reach the floor, by the maxima of its blocks."""
    row, pair = _pairs(group, word)
    most = _saturation(max_tf, min_length, group.avg_length, params)
    bound = np.bincount(group.columns[pair], most[row] * np.maximum(group.weights[pair], 0), len(group.ids))
    floor = group.bounds.get("floor", np.full(len(group.ids), -np.inf))
    return ((bound > 0) & (bound + _NEAR >= floor)) | _everywhere(group)


def _unpacked(blocks: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, tf) of all postings."""
    n = blocks.column("n").to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(n)), n)
    place = np.frombuffer(b"".join(blocks.column("places").to_pylist()), "<u2").astype(np.int64)
    raw = np.frombuffer(b"".join(blocks.column("counts").to_pylist()), np.uint8)
    size = pc.binary_length(blocks.column("counts")).to_numpy()
    width = size // np.maximum(n, 1)
    begin = np.repeat(np.cumsum(size) - size, n) + (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * width[row]
    tf = np.zeros(len(row), np.int64)
    for j in range(int(width.max(initial=0))):
        at = np.flatnonzero(width[row] > j)
        tf[at] += raw[begin[at] + j].astype(np.int64) << 8 * j
    return row, place, tf


def _score_range(blocks: pa.Table, whole: pa.Table, block: search._Block, k: int, params: Bm25) -> Iterator[pa.Table]:
    """The best k chunks of a range per question that can reach its floor."""
    ids, lengths = (whole.column(c).combine_chunks().flatten() for c in ("ids", "lengths"))
    lengths, year = lengths.to_numpy(), whole.column("year")[0].as_py()
    word, max_tf, shortest = (blocks.column(c).to_numpy().astype(np.int64) for c in ("word", "max_tf", "min_length"))
    for group in block.groups:
        if group.years and year not in group.years:
            continue
        asked = np.flatnonzero(_alive(group, word, max_tf, shortest, params))
        if not len(asked):
            continue
        column = np.full(len(group.ids), -1)
        column[asked] = np.arange(len(asked))
        row, pair = _pairs(group, word)
        used = np.unique(row[column[group.columns[pair]] >= 0])
        row, place, tf = _unpacked(blocks.take(pa.array(used)))
        value = _saturation(tf, lengths[place], group.avg_length, params)
        every = _everywhere(group)[asked]
        floor = group.bounds.get("floor", np.full(len(group.ids), -np.inf))[asked]
        step = max(1, _CELLS // len(asked))
        for start in range(0, len(ids), step):
            here = np.flatnonzero((place >= start) & (place < start + step))
            size = min(step, len(ids) - start)
            out = np.zeros(size * len(asked))
            for at in range(0, len(here), search._ASKED):
                part = here[at : at + search._ASKED]
                cell, pair = _pairs(group, word[used][row[part]])
                to = column[group.columns[pair]]
                cell, pair, to = cell[to >= 0], pair[to >= 0], to[to >= 0]
                out += np.bincount((place[part][cell] - start) * len(asked) + to, value[part][cell] * group.weights[pair], len(out))
            out = out.reshape(size, len(asked))
            order = np.round(out, ranking.TIE_PLACES)
            order[~((order > 0) | every)] = -np.inf
            top, to = search._best(order, k, floor)
            top, to = top[order[top, to] > -np.inf], to[order[top, to] > -np.inf]
            yield pa.table(
                {
                    "query_id": group.ids.take(pa.array(asked[to])),
                    "chunk_id": ids.take(pa.array(top + start)),
                    "score": out[top, to],
                    "order": order[top, to],
                }
            )


def _coded(postings: Postings, block: search._Block) -> DataFrame:
    """The blocks of the words of the questions, which are bounded by the block of questions."""
    spark = postings.blocks.sparkSession
    words = pa.table({"term": block.vocabulary.cast(pa.string()), "word": pa.array(range(len(block.vocabulary)), pa.int32())})
    asked = spark.createDataFrame(words).select("term", "word", _bucket())
    folders = sorted(r["bucket"] for r in asked.select("bucket").distinct().collect())
    held = postings.blocks.where(F.col("bucket").isin(folders))
    return held.join(F.broadcast(asked.drop("bucket")), "term")


def _scored(blocks: DataFrame, ranges: DataFrame, block: search._Block, id_type, k: int, params: Bm25) -> DataFrame:
    shared = blocks.sparkSession.sparkContext.broadcast(block)
    kind = ranges.schema["ids"].dataType.elementType
    schema = T.StructType(
        [T.StructField("query_id", id_type), T.StructField("chunk_id", kind)]
        + [T.StructField(c, T.DoubleType()) for c in ("score", "order")]
    )
    none = pa.schema(to_arrow_schema(schema)).empty_table()

    def score(one: pa.Table, other: pa.Table) -> pa.Table:
        found = list(_score_range(one, other, shared.value, k, params)) if other.num_rows else []
        return pa.concat_tables([none, *(t.cast(none.schema) for t in found)])

    rows = blocks.select(F.col("range").alias("of"), "word", "n", "max_tf", "min_length", "places", "counts")
    return rows.groupBy("of").cogroup(ranges.groupBy("range")).applyInArrow(score, schema)


def needed_blocks(blocks: DataFrame, ranges: DataFrame, block: search._Block, params: Bm25 = Bm25()) -> DataFrame:
    """(range, word) of the blocks that some question needs; word -1 for the range as such.

    Reads the maxima of the blocks and the years of the ranges only.
    """
    shared = blocks.sparkSession.sparkContext.broadcast(block)

    def need(one: pa.Table, other: pa.Table) -> pa.Table:
        number, year = (other.column(c).to_pylist()[:1] for c in ("range", "year"))
        word, max_tf, shortest = (one.column(c).to_numpy().astype(np.int64) for c in ("word", "max_tf", "min_length"))
        found = []
        for group in shared.value.groups if number else []:
            if group.years and year[0] not in group.years:
                continue
            alive = _alive(group, word, max_tf, shortest, params)
            if alive.any():
                row, pair = _pairs(group, word)
                found += [np.array([-1]), word[row[alive[group.columns[pair]]]]]
        words = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
        return pa.table({"range": pa.array(number * len(words), pa.int64()), "word": pa.array(words, pa.int32())})

    maxima = blocks.select(F.col("range").alias("of"), "word", "max_tf", "min_length")
    named = ranges.select("range", "year")
    return maxima.groupBy("of").cogroup(named.groupBy("range")).applyInArrow(need, "range long, word int")


def _place_floors(block: search._Block, hits: DataFrame, k: int) -> None:
    """What k chunks have reached already, per question."""
    kth = hits.where(F.col("rank") == k).select("query_id", "order").toArrow()
    for group in block.groups:
        at = pc.index_in(group.ids, value_set=kth.column("query_id").combine_chunks().cast(group.ids.type))
        reached = kth.column("order").take(at).to_numpy().astype(np.float64)
        group.bounds["floor"] = np.where(np.isnan(reached), -np.inf, reached)


def _lowest(ranges: DataFrame, block: search._Block, id_type, k: int) -> DataFrame:
    """For questions that too few chunks answer: the first chunks that they may have, with score 0."""
    shared = ranges.sparkSession.sparkContext.broadcast(block)
    kind = ranges.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("place", T.IntegerType()), T.StructField("chunk_id", kind)])

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, pa.Array] = {}
        for batch in batches:
            for place, group in enumerate(shared.value.groups):
                mine = batch
                if group.years:
                    mine = batch.filter(pc.is_in(batch.column("year"), value_set=pa.array(group.years, pa.string())))
                mine = mine.column("ids").flatten()
                both = pa.concat_arrays([held[place], mine]) if place in held else mine
                held[place] = both.take(pc.sort_indices(both)[: 2 * k])
        for place, ids in held.items():
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(place, pa.int32()), len(ids)), ids], names=["place", "chunk_id"])

    low = ranking.top_k(ranges.select("ids", "year").mapInArrow(pick, schema).withColumn("score", F.lit(0.0)), ["place"], 2 * k)
    asked = [(i, q) for i, g in enumerate(block.groups) for q in g.ids.to_pylist()]
    names = T.StructType([T.StructField("place", T.IntegerType()), T.StructField("query_id", id_type)])
    named = low.join(F.broadcast(ranges.sparkSession.createDataFrame(asked, names)), "place")
    return named.select("query_id", "chunk_id", F.lit(0.0).alias("score"), F.lit(0.0).alias("order"))


def _only(block: search._Block, wanted: set) -> search._Block:
    groups = [replace(g, ids=g.ids.filter(pc.is_in(g.ids, value_set=pa.array(list(wanted), g.ids.type)))) for g in block.groups]
    return search._Block([g for g in groups if len(g.ids)])


def search_postings(
    queries: DataFrame, postings: Postings, statistics: DataFrame, k: int = 10, params: Bm25 = Bm25()
) -> DataFrame:
    """BM25 top k: (query_id, rank, chunk_id, score), as :func:`search.search_sparse` gives it.

    ``queries`` have query_id, prompt and optionally years; ``statistics`` are the stored
    :func:`lexical.year_statistics` of the same chunks. Chunks that no term leads to
    have score 0 and fill up the answer, first ids first.
    """
    id_type = queries.schema["query_id"].dataType
    asked = search.canonical_years(queries).select("query_id", "years", "prompt")
    n_ranges = postings.ranges.count()
    early = F.lit(True) if n_ranges < 2 * FIRST else F.pmod("range", F.lit(FIRST)) == 0
    answers = []
    for rows in search._blocks(asked):
        block = search._grouped(rows, False)
        search._add_weights(rows, block, statistics, params)
        blocks = _coded(postings, block)

        def best(found: DataFrame) -> DataFrame:
            return materialize(ranking.top_k(found, ["query_id"], k, "order", places=None), "hits")

        hits = best(_scored(blocks.where(early), postings.ranges.where(early), block, id_type, k, params))
        if n_ranges >= 2 * FIRST:
            _place_floors(block, hits, k)
            needed = materialize(needed_blocks(blocks.where(~early), postings.ranges.where(~early), block, params), "needed")
            some = bounded(needed)
            late = blocks.where(~early).join(some, ["range", "word"], "left_semi")
            ranges = postings.ranges.where(~early).join(bounded(needed.select("range").distinct()), "range", "left_semi")
            more = _scored(late, ranges, block, id_type, k, params)
            hits = best(hits.drop("rank").unionByName(more))
        full = {r["query_id"] for r in hits.where(F.col("rank") == k).select("query_id").collect()}
        short = _only(block, {q for g in block.groups for q in g.ids.to_pylist()} - full)
        if short.groups:
            low = _lowest(postings.ranges, short, id_type, k).join(hits, ["query_id", "chunk_id"], "left_anti")
            hits = best(hits.drop("rank").unionByName(low))
        answers.append(hits)
    if not answers:
        empty = search._Block([], pa.array([], pa.string()))
        answers.append(ranking.top_k(_scored(_coded(postings, empty), postings.ranges, empty, id_type, k, params), ["query_id"], k, "order", places=None))
    return reduce(DataFrame.unionByName, answers).select("query_id", "rank", "chunk_id", "score")
