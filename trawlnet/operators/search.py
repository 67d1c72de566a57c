"""Batch retrieval: many queries against a corpus that fits on no single machine.

Scoring is a matrix product of corpus rows and queries. Spark partitions the corpus;
each task scores its Arrow batches against a block of queries and lets only the best k
rows per query leave, so no (query, chunk) pair table is ever shuffled or stored. What a
block takes to the tasks is bounded by ``BLOCK_BYTES`` of words and vectors, tens of thousands
of usual questions; more mean more blocks, each with its own scan, and the same results.

Columns: queries (query_id, prompt, optional years, optional vector); chunks (chunk_id,
chunk, optional year, optional embedding).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawlnet.functions.batches import as_lists, pieces, split_words
from trawlnet.operators import lexical, ranking
from trawlnet.operators.joins import BROADCAST_ROWS, bounded
from trawlnet.operators.lexical import Bm25
from trawlnet.sources.scratch import materialize

BLOCK_BYTES = 32 << 20  # words and vectors of queries scored in one scan; bounds the broadcast
_CELLS = 1 << 21  # entries of one work matrix inside a task
_ASKED = 1 << 16  # (row, word) cells whose queries are added up at a time
_ROUNDING = 2e-9  # by which a rounded score can be below a floor that it reaches
_HELD_ROWS = 1 << 18  # candidate rows a task holds before it cuts back to k per query


@dataclass(eq=False)
class _Group:
    """Queries of a block that share a year filter; one column per query."""

    years: list[str]
    ids: pa.Array
    vectors: np.ndarray | None = None
    weights: np.ndarray | None = None  # of all (term, query) pairs, by term
    columns: np.ndarray | None = None  # the query of each of them
    first: np.ndarray | None = None  # where those of each word of the block begin
    avg_length: float = 1.0
    bounds: dict[str, np.ndarray] = field(default_factory=dict)
    floors: np.ndarray | None = None  # by alpha and query: what the best k have in any case

    def rows(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        if not self.years:
            return batch
        wanted = pc.is_in(batch.column("year"), value_set=pa.array(self.years, pa.string()))
        return batch.filter(wanted)


@dataclass(eq=False)
class _Block:
    """What one scan takes to the tasks."""

    groups: list[_Group]
    vocabulary: pa.Array | None = None


def canonical_years(queries: DataFrame) -> DataFrame:
    """Give every query a sorted, distinct, never NULL list of years."""
    if "years" not in queries.columns:
        return queries.withColumn("years", F.array().cast("array<string>"))
    years = F.coalesce(F.col("years"), F.array().cast("array<string>"))
    return queries.withColumn("years", F.array_sort(F.array_distinct(years)))


def _in_asked_years(chunks: DataFrame, asked: DataFrame) -> DataFrame:
    """The chunks of years that any query asks for; all if one asks for all."""
    if not asked.where(F.size("years") == 0).isEmpty():
        return chunks
    years = asked.select(F.explode("years").alias("year")).distinct()
    return chunks.join(bounded(years), "year", "left_semi")


def _blocks(queries: DataFrame) -> Iterator[pa.Table]:
    """Bring the queries to the driver in blocks of about ``BLOCK_BYTES``, one at a time.

    They are written first, so a model that embeds them is called once, and cut by a hash of
    their id.
    """
    queries = materialize(queries, "queries")
    sizes = [F.lit(64)]
    if "prompt" in queries.columns:
        sizes.append(F.coalesce(F.octet_length("prompt") * 4, F.lit(0)))
    if "vector" in queries.columns:
        sizes.append(F.coalesce(F.size("vector") * 8, F.lit(0)))
    total = queries.agg(F.sum(reduce(Column.__add__, sizes).cast("long"))).first()[0] or 0
    n_blocks = -(-total // BLOCK_BYTES)
    for block in range(n_blocks):
        here = F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == block
        table = queries.where(here).toArrow()
        if table.num_rows:
            yield table


def _grouped(rows: pa.Table, dense: bool) -> _Block:
    places: dict[tuple[str, ...], list[int]] = {}
    for place, years in enumerate(rows.column("years").to_pylist()):
        places.setdefault(tuple(years), []).append(place)
    groups = []
    for years, members in sorted(places.items()):
        part = rows.take(members)
        group = _Group(list(years), part.column("query_id").combine_chunks())
        if dense:
            group.vectors = _unit_rows(np.array(part.column("vector").to_pylist(), dtype=float)).T
        groups.append(group)
    return _Block(groups)


def _add_weights(rows: pa.Table, block: _Block, statistics: DataFrame, params: Bm25) -> None:
    """Compute the BM25 term weights of a block in Spark and place them in its groups."""
    spark, groups = statistics.sparkSession, block.groups
    number = {tuple(g.years): i for i, g in enumerate(groups)}
    ids = [number[tuple(years)] for years in rows.column("years").to_pylist()]
    numbered = rows.select(["query_id", "prompt"]).append_column(
        "filter_id", pa.array(ids, pa.int32())
    )
    filtered = lexical.filter_statistics(statistics, [g.years for g in groups])
    totals = lexical.corpus_totals(filtered).toArrow()
    terms = lexical.query_terms(spark.createDataFrame(numbered))
    local_totals = spark.createDataFrame(totals)
    weights = lexical.query_weights(terms, filtered, params, local_totals).toArrow()
    lengths = dict(zip(*(totals.column(c).to_pylist() for c in ("filter_id", "avg_length"))))
    words = weights.column("term").combine_chunks().dictionary_encode()
    block.vocabulary = words.dictionary
    for i, group in enumerate(groups):
        group.avg_length = lengths.get(i) or 1.0
        column = pc.index_in(weights.column("query_id"), value_set=group.ids)
        mine = column.is_valid().to_numpy()
        word = words.indices.to_numpy()[mine]
        order = np.argsort(word, kind="stable")
        group.columns = column.drop_null().to_numpy()[order].astype(np.int64)
        group.weights = weights.column("weight").to_numpy()[mine][order]
        # a place more, for words that no query has
        group.first = np.searchsorted(word[order], np.arange(len(block.vocabulary) + 2))


def _unit_rows(matrix: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; a zero row turns into NaN."""
    with np.errstate(invalid="ignore"):
        return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def _dense(batch: pa.RecordBatch, group: _Group) -> np.ndarray:
    lists = batch.column("embedding")
    present = lists.is_valid().to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    matrix = np.full((len(lists), len(group.vectors)), np.nan)
    matrix[present] = flat.reshape(int(present.sum()), len(group.vectors))
    return _unit_rows(matrix) @ group.vectors


def _encode(batch: pa.RecordBatch, vocabulary: pa.Array) -> pa.RecordBatch:
    """Add ``words``: the place of each token in the vocabulary, or the vocabulary's length."""
    flat, lengths = split_words(batch.column("text"))
    codes = pc.fill_null(pc.index_in(flat, value_set=vocabulary), len(vocabulary))
    return batch.append_column("words", as_lists(codes, lengths))


def _sparse(batch: pa.RecordBatch, group: _Group, params: Bm25) -> np.ndarray:
    """Only words that a query of the group has are looked at, each with its queries."""
    words, width = batch.column("words"), len(group.ids)
    n = len(words)
    lengths = pc.list_value_length(words).to_numpy(zero_copy_only=False)
    word, row = words.flatten().to_numpy(), np.repeat(np.arange(n), lengths)
    asked = group.first[word + 1] > group.first[word]
    cell, tf = np.unique(row[asked] * len(group.first) + word[asked], return_counts=True)
    row, word = np.divmod(cell, len(group.first))
    length = params.k1 * (1 - params.b + params.b * lengths / group.avg_length)
    score = tf * (params.k1 + 1) / (tf + length[row])
    out = np.zeros(n * width)
    counts = group.first[word + 1] - group.first[word]
    for at in range(0, len(cell), _ASKED):
        part = slice(at, at + _ASKED)
        ends = np.cumsum(counts[part])
        inside = np.arange(ends[-1]) - np.repeat(ends - counts[part], counts[part])
        pair = np.repeat(group.first[word[part]], counts[part]) + inside
        values = np.repeat(score[part], counts[part]) * group.weights[pair]
        out += np.bincount(np.repeat(row[part] * width, counts[part]) + group.columns[pair], values, n * width)
    return out.reshape(n, width)


Scored = tuple[_Group, pa.Array, np.ndarray | None, np.ndarray | None]


def _scored(batches: Iterator[pa.RecordBatch], block: _Block, params: Bm25) -> Iterator[Scored]:
    """Dense and sparse scores, chunks down and queries across, in bounded pieces."""
    for batch in (piece for whole in batches for piece in pieces(whole)):
        if block.vocabulary is not None:
            batch = _encode(batch, block.vocabulary)
        for group in block.groups:
            mine = group.rows(batch)
            step = max(1, _CELLS // len(group.ids))
            for start in range(0, mine.num_rows, step):
                piece = mine.slice(start, step)
                dense = None if group.vectors is None else _dense(piece, group)
                sparse = None if group.weights is None else _sparse(piece, group, params)
                yield group, piece.column("chunk_id"), dense, sparse


def _candidates(chunks: DataFrame, block: _Block, dense: bool, sparse: bool) -> DataFrame:
    """The columns that scoring reads, cut to the years that any query asks for."""
    columns = [F.col("chunk_id")]
    years = sorted({y for g in block.groups for y in g.years})
    if years:
        columns.append(F.col("year"))
        if all(g.years for g in block.groups):
            chunks = chunks.where(F.col("year").isin(years))
    if dense:
        columns.append(F.col("embedding"))
    if sparse:
        columns.append(F.lower("chunk").alias("text"))
    return chunks.select(*columns)


_NAMES = ("dense", "sparse")
_ENDS = ["dense_min", "dense_max", "sparse_min", "sparse_max"]


def _fused(group: _Group, alpha: float, dense: np.ndarray, sparse: np.ndarray, ends: dict[str, np.ndarray]) -> np.ndarray:
    norm = [_scaled(x, ends[f"{n}_min"], ends[f"{n}_max"]) for n, x in zip(_NAMES, (dense, sparse), strict=True)]
    return alpha * norm[0] + (1 - alpha) * norm[1]


def _keep_best(group: _Group, state: dict, alphas: Sequence[float], dense: np.ndarray, sparse: np.ndarray) -> None:
    """Per question and alpha, the scores of a row that is the best so far by the range so far."""
    every = np.arange(len(group.ids))
    for alpha in alphas:
        held = state.get(alpha, np.full((2, len(every)), np.nan))
        both = [np.vstack([x, h]) for x, h in zip((dense, sparse), held, strict=True)]
        fused = _fused(group, alpha, *both, state)
        at = np.where(np.isnan(fused), -np.inf, fused).argmax(axis=0)
        state[alpha] = np.array([x[at, every] for x in both])


def _scan_bounds(
    corpus: DataFrame, block: _Block, id_type, params: Bm25, k: int = 0, alphas: Sequence[float] = ()
) -> DataFrame:
    """Per query: candidates and the range of both scores over all of them.

    With alphas also ``floors``: for each, a fused score that ``k`` candidates reach, or NULL. Every
    task names one row that seems good to it; once the ranges are known, so are their
    fused scores, and the k-th best of them is a proven floor.
    """
    shared = corpus.sparkSession.sparkContext.broadcast(block)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[_Group, dict] = {}
        for group, ids, *scores in _scored(batches, shared.value, params):
            if not len(ids):
                continue
            state = seen.setdefault(group, {"n": np.zeros(len(group.ids), dtype=np.int64)})
            state["n"] += len(ids)
            for name, score in zip(_NAMES, scores, strict=True):
                if score is None:
                    continue
                low = np.fmin.reduce(score, axis=0)
                high = np.fmax.reduce(score, axis=0)
                state[f"{name}_min"] = np.fmin(state.get(f"{name}_min", low), low)
                state[f"{name}_max"] = np.fmax(state.get(f"{name}_max", high), high)
            _keep_best(group, state, alphas, *scores)
        for group, state in seen.items():
            empty = np.full(len(group.ids), np.nan)
            arrays = [group.ids, pa.array(state["n"])]
            arrays += [pa.array(state.get(end, empty), from_pandas=True) for end in _ENDS]
            rows = np.array([state[alpha] for alpha in alphas]).reshape(-1, len(group.ids)).T.ravel()
            ends = pa.array(np.arange(len(group.ids) + 1, dtype=np.int32) * 2 * len(alphas))
            arrays.append(pa.ListArray.from_arrays(ends, pa.array(rows)))
            yield pa.RecordBatch.from_arrays(arrays, ["query_id", "n_candidates", *_ENDS, "best"])

    schema = T.StructType(
        [T.StructField("query_id", id_type), T.StructField("n_candidates", T.LongType())]
        + [T.StructField(name, T.DoubleType()) for name in _ENDS]
        + [T.StructField("best", T.ArrayType(T.DoubleType()))]
    )
    partial = corpus.mapInArrow(scan, schema)
    found = partial.groupBy("query_id").agg(
        F.sum("n_candidates").alias("n_candidates"),
        *[(F.min if c.endswith("min") else F.max)(c).alias(c) for c in _ENDS],
        *([F.collect_list("best").alias("best")] if alphas else []),
    )
    if not alphas:
        return found

    def norm(row: Column, place: int, name: str) -> Column:
        low, high, x = F.col(f"{name}_min"), F.col(f"{name}_max"), row[place]
        return F.when(high > low, (x - low) / (high - low)).otherwise(x * 0.0)

    def floor(i: int, alpha: float) -> Column:
        fused = F.transform("best", lambda row: alpha * norm(row, 2 * i, "dense") + (1 - alpha) * norm(row, 2 * i + 1, "sparse"))
        known = F.filter(fused, lambda x: ~F.isnan(x) & x.isNotNull())
        return F.when(F.size(known) >= k, F.sort_array(known, asc=False)[k - 1])

    floors = F.array(*[floor(i, alpha) for i, alpha in enumerate(alphas)])
    return found.withColumn("floors", floors).drop("best")


def _place_bounds(block: _Block, rows: DataFrame) -> None:
    table = rows.toArrow()
    for group in block.groups:
        at = pc.index_in(group.ids, value_set=table.column("query_id").combine_chunks())
        for name in _ENDS:
            group.bounds[name] = table.column(name).take(at).to_numpy().astype(np.float64)
        floors = table.column("floors").take(at).to_pylist()
        group.floors = np.array([[-np.inf if x is None else x for x in row or []] for row in floors]).T - _ROUNDING


def _scaled(score: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Min-max per query; a flat range gives 0 and NaN stays NaN."""
    spread = high - low
    flat = ~(spread > 0)
    return np.where(flat, score * 0.0, (score - low) / np.where(flat, 1.0, spread))


def _best(order: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the k largest entries per column; among equals the upper rows win.

    ``floor`` holds per column what k rows of an earlier piece have reached. Entries below
    it are left out, and it is raised to what this piece reaches.
    """
    n, keep = len(order), order >= floor
    if n > k:
        kth = np.partition(order, n - k, axis=0)[n - k]
        above, equal = order > kth, order == kth
        keep &= above | (equal & (equal.cumsum(axis=0) <= k - above.sum(axis=0)))
        np.maximum(floor, kth, out=floor)
    return np.nonzero(keep)


def _cut(table: pa.Table, k: int) -> pa.Table:
    """Keep the best k candidate rows per query and alpha."""
    keys = [("query_id", "ascending"), ("alpha", "ascending")]
    table = table.sort_by([*keys, ("order", "descending"), ("chunk_id", "ascending")])
    new = np.ones(table.num_rows, dtype=bool)
    query, alpha = (table.column(c).combine_chunks() for c in ("query_id", "alpha"))
    same = pc.and_(pc.equal(query[1:], query[:-1]), pc.equal(alpha[1:], alpha[:-1]))
    new[1:] = ~same.to_numpy(zero_copy_only=False)
    starts = np.flatnonzero(new)
    place = np.arange(table.num_rows) - starts[np.cumsum(new) - 1]
    return table.filter(pa.array(place < k))


def _scan_best(
    corpus: DataFrame, block: _Block, id_type, params: Bm25, k: int, alphas: Sequence[float]
) -> DataFrame:
    """The best k rows of each task per query and alpha, with both component scores."""
    shared = corpus.sparkSession.sparkContext.broadcast(block)

    def pick(floors: dict, group: _Group, ids: pa.Array, dense, sparse) -> Iterator[pa.Table]:
        by_id = pc.sort_indices(ids).to_numpy()
        ids = ids.take(pa.array(by_id))
        parts = {}
        for name, score in (("dense", dense), ("sparse", sparse)):
            if score is None:
                continue
            score = parts[name] = score[by_id]
            if group.bounds:
                ends = group.bounds[f"{name}_min"], group.bounds[f"{name}_max"]
                parts[f"{name}_norm"] = _scaled(score, *ends)
        for i, alpha in enumerate(alphas):
            if group.bounds:
                score = alpha * parts["dense_norm"] + (1 - alpha) * parts["sparse_norm"]
            else:
                score = parts["sparse"] if dense is None else parts["dense"]
            order = np.round(score, ranking.TIE_PLACES)
            order[np.isnan(order)] = -np.inf
            proven = np.full(len(group.ids), -np.inf) if group.floors is None else group.floors[i].copy()
            floor = floors.setdefault((group, alpha), proven)
            row, column = _best(order, k, floor)
            values = {"query_id": group.ids.take(pa.array(column)), "alpha": pa.repeat(float(alpha), len(row))}
            values |= {"chunk_id": ids.take(pa.array(row)), "order": order[row, column]}
            for name in names:
                source = score if name == "score" else parts.get(name)
                values[name] = (
                    pa.nulls(len(row), pa.float64())
                    if source is None
                    else pa.array(source[row, column], from_pandas=True)
                )
            yield pa.table(values)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_held, floors = [], 0, {}
        for scored in _scored(batches, shared.value, params):
            for found in pick(floors, *scored):
                held.append(found)
                n_held += found.num_rows
            if n_held > _HELD_ROWS:
                held = [_cut(pa.concat_tables(held), k)]
                n_held = 0
        if held:
            rows = _cut(pa.concat_tables(held), k)
            yield from rows.select(["query_id", "alpha", "chunk_id", *names, "order"]).to_batches()

    names = ["score", "dense", "sparse", "dense_norm", "sparse_norm"]
    schema = T.StructType(
        [
            T.StructField("query_id", id_type),
            T.StructField("alpha", T.DoubleType()),
            T.StructField("chunk_id", corpus.schema["chunk_id"].dataType),
        ]
        + [T.StructField(name, T.DoubleType()) for name in (*names, "order")]
    )
    return corpus.mapInArrow(scan, schema)


def _ranked(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The tasks' best rows by the order that the tasks have cut by."""
    return ranking.top_k(found, keys, k, "order", places=None)


def _run(
    queries: DataFrame,
    chunks: DataFrame,
    dense: bool,
    sparse: bool,
    statistics: DataFrame | None,
    params: Bm25,
    finish: Callable[[DataFrame, _Block], DataFrame],
) -> DataFrame:
    """Prepare each block of queries, hand it to ``finish``, and union the results."""
    needed = ["query_id", "years"] + ["vector"] * dense + ["prompt"] * sparse
    asked = canonical_years(queries).select(*needed)
    if sparse and statistics is None:
        counted = chunks
        if "year" not in chunks.columns:
            counted = chunks.withColumn("year", F.lit(None).cast("string"))
        if "years" in queries.columns:
            counted = _in_asked_years(counted, asked)
        statistics = materialize(lexical.year_statistics(counted), "term-statistics")
    answers = []
    for rows in _blocks(asked):
        block = _grouped(rows, dense)
        if sparse:
            _add_weights(rows, block, statistics, params)
        answers.append(finish(_candidates(chunks, block, dense, sparse), block))
    if not answers:
        answers.append(finish(_candidates(chunks, _Block([]), dense, sparse), _Block([])))
    return reduce(DataFrame.unionByName, answers)


def search_sparse(
    queries: DataFrame,
    chunks: DataFrame,
    k: int = 10,
    statistics: DataFrame | None = None,
    params: Bm25 = Bm25(),
) -> DataFrame:
    """BM25 top k: (query_id, rank, chunk_id, score). One scan of the corpus.

    ``statistics`` may be a stored :func:`lexical.year_statistics` of the same chunks.
    """
    id_type = queries.schema["query_id"].dataType

    def finish(corpus: DataFrame, block: _Block) -> DataFrame:
        found = _scan_best(corpus, block, id_type, params, k, [0.0])
        return _ranked(found, ["query_id"], k)

    hits = _run(queries, chunks, False, True, statistics, params, finish)
    return hits.select("query_id", "rank", "chunk_id", "score")


def search_dense(queries: DataFrame, chunks: DataFrame, k: int = 10) -> DataFrame:
    """Cosine top k: (query_id, rank, chunk_id, score). A zero vector ranks last."""
    id_type = queries.schema["query_id"].dataType

    def finish(corpus: DataFrame, block: _Block) -> DataFrame:
        found = _scan_best(corpus, block, id_type, Bm25(), k, [1.0])
        return _ranked(found, ["query_id"], k)

    hits = _run(queries, chunks, True, False, None, Bm25(), finish)
    return hits.select("query_id", "rank", "chunk_id", "score")


def score_bounds(
    queries: DataFrame,
    chunks: DataFrame,
    statistics: DataFrame | None = None,
    params: Bm25 = Bm25(),
) -> DataFrame:
    """Per query: number of candidates and the range of its dense and sparse scores."""
    id_type = queries.schema["query_id"].dataType
    return _run(
        queries, chunks, True, True, statistics, params,
        lambda corpus, block: _scan_bounds(corpus, block, id_type, params),
    )


def search_hybrid(
    queries: DataFrame,
    chunks: DataFrame,
    k: int = 10,
    alphas: Sequence[float] = (0.5,),
    statistics: DataFrame | None = None,
    params: Bm25 = Bm25(),
) -> DataFrame:
    """Weighted fusion of min-max scaled cosine and BM25, top k per query and alpha.

    Gives (query_id, alpha, rank, chunk_id, score, dense, sparse, dense_norm,
    sparse_norm). Two scans: the first finds the score ranges, which need every
    candidate, and a floor for the best k; the second ranks what reaches the floor, so the rows that
    leave its tasks do not grow with the number of tasks times k. All alphas share both.
    """
    id_type = queries.schema["query_id"].dataType

    def finish(corpus: DataFrame, block: _Block) -> DataFrame:
        if block.groups:
            _place_bounds(block, _scan_bounds(corpus, block, id_type, params, k, list(alphas)))
        found = _scan_best(corpus, block, id_type, params, k, list(alphas))
        return _ranked(found, ["query_id", "alpha"], k)

    hits = _run(queries, chunks, True, True, statistics, params, finish)
    first = ["query_id", "alpha", "rank", "chunk_id", "score"]
    return hits.select(*first, "dense", "sparse", "dense_norm", "sparse_norm")


def fetch(hits: DataFrame, chunks: DataFrame, most_hits: int | None = None) -> DataFrame:
    """Join the hits back to the chunk rows.

    ``most_hits`` is a proven bound (queries times alphas times k). Up to
    ``BROADCAST_ROWS`` the keys are broadcast and the texts stay where they are; beyond
    that, or without a bound, the join is left to the optimiser.
    """
    small = most_hits is not None and most_hits <= BROADCAST_ROWS
    keys = F.broadcast(hits) if small else hits
    payload = chunks.drop("embedding") if "embedding" in chunks.columns else chunks
    return payload.join(keys, "chunk_id")
