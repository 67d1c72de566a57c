"""Exact search over cells against the scan of all vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from test_search import collected

from trawlnet.deploy import ship
from trawlnet.operators import cells, search
from trawlnet.sources.scratch import scratch_path

SCHEMA = "chunk_id string, embedding array<double>"


def stored(spark, vectors, n_pivots):
    ship(spark)
    path = scratch_path(spark, "cells")
    cells.write_cells(vectors, path, n_pivots)
    return cells.read_cells(spark, path, T.StringType(), T.DoubleType())


def frames(spark, vectors, questions):
    v = spark.createDataFrame([(f"c{i:04}", x) for i, x in enumerate(vectors)], SCHEMA)
    return v.repartition(3), spark.createDataFrame(list(enumerate(questions)), "query_id int, vector array<double>")


def clustered(rng, n, middles=20, dim=8):
    centre = rng.normal(size=(middles, dim))
    return (centre[rng.integers(0, middles, n)] + rng.normal(scale=0.05, size=(n, dim))).tolist()


@pytest.mark.parametrize("k, n_pivots", [(1, 5), (7, 16), (500, 8)])
def test_equals_a_scan(spark, k, n_pivots):
    rng = np.random.default_rng(k)
    vectors = [*clustered(rng, 300), *rng.normal(size=(60, 8)).tolist(), [0.0] * 8, None, [1.0] * 8, [1.0] * 8, [2.0] * 8]
    questions = [*clustered(rng, 6), *rng.normal(size=(4, 8)).tolist(), [0.0] * 8, [1.0] * 8]
    v, q = frames(spark, vectors, questions)
    assert collected(cells.search_cells(q, stored(spark, v, n_pivots), k), "query_id") == collected(search.search_dense(q, v, k), "query_id")


def test_odd_tables(spark):
    v, q = frames(spark, [[1.0, 0.0], [0.0, 1.0]], [[1.0, 1.0]])
    assert cells.search_cells(q, stored(spark, v.where("false"), 4), 3).collect() == []
    assert cells.search_cells(q.where("false"), stored(spark, v, 4), 3).collect() == []
    none = spark.createDataFrame([("a", None), ("b", [0.0, 0.0])], SCHEMA)
    assert collected(cells.search_cells(q, stored(spark, none, 4), 3), "query_id") == collected(search.search_dense(q, none, 3), "query_id")


def test_most_cells_are_left_out(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vectors = clustered(rng, 2000, middles=40)
    v, q = frames(spark, vectors, [vectors[i] for i in range(0, 2000, 250)])
    visited, original = [], cells._visit

    def noted(vectors, ids, questions, wanted, *rest):
        visited.append(wanted.sum() / wanted.size)
        return original(vectors, ids, questions, wanted, *rest)

    monkeypatch.setattr(cells, "_visit", noted)
    index = stored(spark, v, 40)
    assert collected(cells.search_cells(q, index, 5), "query_id") == collected(search.search_dense(q, v, 5), "query_id")
    assert sum(visited) < 0.25
    assert index[0].where(F.col("cell") == 3).count() == next(r["n"] for r in index[1].to_pylist() if r["cell"] == 3)


def test_bounds_hold():
    rng = np.random.default_rng(4)
    x, p = (search._unit_rows(rng.normal(size=(n, 6))) for n in (500, 12))
    near = (x @ p.T).argmax(axis=1)
    radius = np.array([np.arccos(np.clip((x[near == c] @ p[c]), -1, 1)).max(initial=0) for c in range(12)])
    q = search._unit_rows(rng.normal(size=(50, 6)))
    assert ((q @ x.T) <= cells.bounds(q, p, radius)[:, near] + 1e-9).all()
