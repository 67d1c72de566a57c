"""Exact cosine search that leaves out cells of vectors which cannot hold a best one.

Vectors are stored by their nearest pivot, with the largest angle between the pivot and a vector of
its cell. No vector of a cell can be nearer to a question than the angle to the pivot less that
radius, so a cell whose bound is below what k vectors have reached is not read. A question
first visits the cells around it that hold k vectors; their k-th best score is its floor for the
others. Pivots come from a bounded sample; they decide what can be skipped, never the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawlnet.operators import profile, ranking, search
from trawlnet.sources.scratch import materialize

PIVOTS = 256
SAMPLED = 16  # vectors of the sample per pivot
ROUNDS = 5  # of moving pivots to the middle of their vectors
NONE = -1  # cell of vectors without a direction
_NEAR = 1e-8  # what rounding can add to a score


def _pivots(vectors: DataFrame, n: int) -> np.ndarray:
    """Unit vectors around which the sample lies, by a few rounds of spherical k-means."""
    rows = profile.hashed_rows(vectors.select("chunk_id", "embedding"), n * SAMPLED, "chunk_id").toArrow()
    found = [v for v in rows.column("embedding").to_pylist() if v is not None and any(v)]
    if not found:
        return np.empty((0, 0))
    sample = search._unit_rows(np.array(found, float))
    pivots = sample[:n]
    for _ in range(ROUNDS):
        near = (sample @ pivots.T).argmax(axis=1)
        sums = np.zeros_like(pivots)
        np.add.at(sums, near, sample)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        pivots = np.where(norm > 1e-12, sums / np.where(norm > 1e-12, norm, 1), pivots)
    return pivots


def _units(column: pa.Array, width: int) -> np.ndarray:
    """Unit rows; NaN where a vector is NULL or zero."""
    present = column.is_valid().to_numpy(zero_copy_only=False)
    out = np.full((len(column), width), np.nan)
    out[present] = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(int(present.sum()), width)
    return search._unit_rows(out)


def write_cells(vectors: DataFrame, path: str, n_pivots: int = PIVOTS) -> None:
    """Store vectors (chunk_id, embedding) by cell below ``path``, with pivots and radii.

    Nothing is shuffled but small cells together: the rows of a large cell are spread over files.
    """
    spark = vectors.sparkSession
    pivots = _pivots(vectors, n_pivots)
    shared = spark.sparkContext.broadcast(pivots)
    schema = T.StructType(
        [vectors.schema["chunk_id"], vectors.schema["embedding"], *T.StructType.fromDDL("angle double, cell int").fields]
    )

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = shared.value
        for batch in batches:
            cell, angle = np.full(batch.num_rows, NONE, np.int32), np.zeros(batch.num_rows)
            if len(pivots):
                cosine = _units(batch.column("embedding"), pivots.shape[1]) @ pivots.T
                known = ~np.isnan(cosine[:, 0])
                cell[known] = cosine[known].argmax(axis=1)
                angle[known] = np.arccos(np.clip(cosine[known].max(axis=1), -1, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(angle), pa.array(cell)], names=schema.names)

    made = vectors.select("chunk_id", "embedding").mapInArrow(assign, schema)
    made.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
    stored = spark.read.schema(schema).parquet(f"{path}/vectors")
    sums = stored.groupBy("cell").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("n"))
    rows = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(pivots)], "cell int, pivot array<double>")
    sums.join(F.broadcast(rows), "cell", "left").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")


def read_cells(spark: SparkSession, path: str, id_type: T.DataType, element: T.DataType) -> tuple[DataFrame, pa.Table]:
    """The stored vectors, and the few rows that describe the cells."""
    fields = [T.StructField("chunk_id", id_type), T.StructField("embedding", T.ArrayType(element))]
    schema = T.StructType([*fields, *T.StructType.fromDDL("angle double, cell int").fields])
    cells = spark.read.schema("cell int, radius double, n long, pivot array<double>").parquet(f"{path}/cells")
    return spark.read.schema(schema).parquet(f"{path}/vectors"), cells.toArrow()


def bounds(questions: np.ndarray, pivots: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """The largest cosine that a vector of each cell can have with each question."""
    angle = np.arccos(np.clip(questions @ pivots.T, -1, 1)) - radius
    return np.cos(np.maximum(angle, 0))


def _visit(vectors: DataFrame, ids: pa.Array, questions: np.ndarray, wanted: np.ndarray, cells: np.ndarray, floor, k: int, id_type) -> DataFrame:
    """The best k vectors of each task per question, from the cells that it wants (questions down, cells across)."""
    used = wanted.any(axis=0)
    asked = {int(c): np.flatnonzero(wanted[:, i]) for i, c in enumerate(cells) if used[i]}
    shared = vectors.sparkSession.sparkContext.broadcast((ids, questions, asked, floor))
    schema = T.StructType(
        [T.StructField("query_id", id_type), vectors.schema["chunk_id"]] + [T.StructField(c, T.DoubleType()) for c in ("score", "order")]
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, questions, asked, floor = shared.value
        floor = floor.copy()
        for batch in batches:
            batch = batch.take(pc.sort_indices(batch.column("chunk_id")))
            unit, cell = _units(batch.column("embedding"), questions.shape[1]), batch.column("cell").to_numpy()
            for here in np.unique(cell):
                who, rows = asked[int(here)], np.flatnonzero(cell == here)
                score = unit[rows] @ questions[who].T
                order = np.round(score, ranking.TIE_PLACES)
                reached = floor[who]
                top, to = search._best(order, k, reached)
                floor[who] = reached
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(who[to])), batch.column("chunk_id").take(pa.array(rows[top])),
                        pa.array(score[top, to]), pa.array(order[top, to]),
                    ],
                    names=schema.names,
                )

    rows = vectors.where(F.col("cell").isin(sorted(asked))).select("chunk_id", "embedding", "cell")
    return rows.mapInArrow(scan, schema)


def search_cells(queries: DataFrame, stored: tuple[DataFrame, pa.Table], k: int = 10) -> DataFrame:
    """Cosine top k: (query_id, rank, chunk_id, score), as :func:`search.search_dense` gives it.

    Questions without a direction, and tables of fewer than k vectors with one, have scores
    that no bound orders; they are answered by a scan.
    """
    vectors, cells = stored
    id_type = queries.schema["query_id"].dataType
    known = cells.filter(pc.not_equal(cells.column("cell"), NONE))
    names, radius, n = (known.column(c).to_numpy() for c in ("cell", "radius", "n"))
    asked = materialize(queries.select("query_id", "vector"), "queries")
    has_direction = F.coalesce(F.exists("vector", lambda x: x != 0), F.lit(False))
    enough = n.sum() >= k
    answers = [search.search_dense(asked.where(~has_direction) if enough else asked, vectors.select("chunk_id", "embedding"), k)]
    for rows in search._blocks(asked.where(has_direction).select("query_id", "vector")) if enough else []:
        ids = rows.column("query_id").combine_chunks()
        questions = search._unit_rows(np.array(rows.column("vector").to_pylist(), float))
        most = bounds(questions, np.array(known.column("pivot").to_pylist()), radius)
        order = np.argsort(-most, axis=1, kind="stable")
        before = np.cumsum(n[order], axis=1) - n[order]  # vectors in nearer cells
        first = np.zeros(most.shape, bool)
        np.put_along_axis(first, order, before < k, axis=1)
        none = np.full(len(ids), -np.inf)
        hits = materialize(ranking.top_k(_visit(vectors, ids, questions, first, names, none, k, id_type), ["query_id"], k, "order", places=None), "hits")
        kth = hits.where(F.col("rank") == k).select("query_id", "order").toArrow()
        at = pc.index_in(ids, value_set=kth.column("query_id").combine_chunks().cast(ids.type))
        floor = kth.column("order").take(at).to_numpy().astype(float)
        rest = ~first & (most + _NEAR >= floor[:, None])
        if rest.any():
            more = _visit(vectors, ids, questions, rest, names, floor, k, id_type)
            hits = ranking.top_k(hits.drop("rank").unionByName(more), ["query_id"], k, "order", places=None)
        answers.append(hits.select("query_id", "rank", "chunk_id", "score"))
    return reduce(DataFrame.unionByName, answers)
