"""Golden questions to scores, for one or several fusion weights at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawlnet.functions import text
from trawlnet.operators import metrics, search
from trawlnet.operators.relevance import containing_chunks
from trawlnet.sources.scratch import materialize


def with_years(queries: DataFrame) -> DataFrame:
    """Read the year filter of each question off its prompt."""
    return queries.withColumn("years", text.years("prompt"))


def retrieve(
    queries: DataFrame,
    chunks: DataFrame,
    k: int = 10,
    alphas: Sequence[float] = (0.5,),
    statistics: DataFrame | None = None,
) -> DataFrame:
    """Hybrid hits with their chunk rows; see :func:`search.search_hybrid`."""
    hits = search.search_hybrid(queries, chunks, k, alphas, statistics)
    return search.fetch(hits, chunks, queries.count() * len(alphas) * k)


def evaluate(
    gold: DataFrame,
    queries: DataFrame,
    chunks: DataFrame,
    predictions: DataFrame,
    k: int = 10,
    alphas: Sequence[float] = (0.5,),
    statistics: DataFrame | None = None,
) -> DataFrame:
    """Scores of every run: alpha, retriever{recall_k, mrr}, generator{exact_match_score}.

    ``gold`` has query_id, full_sentence, gt_text, gt_list. Passages are looked for in
    the whole store, not only in the years a question asks for. ``predictions`` with an
    ``alpha`` hold the answers of each run, others those of all runs. The hits are written
    once, since three metrics read them; that and the search run before the result is returned.
    """
    hits = retrieve(queries, chunks, k, alphas, statistics)
    kept = hits.select("query_id", "alpha", "rank", "chunk", text.text_key("chunk").alias("text_key"))
    kept = materialize(kept, "hits")
    relevant = containing_chunks(gold, chunks)
    recall = metrics.recall_per_query(gold, relevant, kept, alphas)
    ranks = metrics.reciprocal_rank_per_query(gold, kept, alphas)
    per_run = alphas if "alpha" in predictions.columns else None
    matches = metrics.answer_matches(gold, predictions, per_run)
    return metrics.bundle(
        metrics.mean_recall(recall),
        metrics.mean_reciprocal_rank(ranks),
        metrics.exact_match(matches),
    )


def flat_scores(bundles: DataFrame) -> DataFrame:
    """Nested scores as plain columns."""
    return bundles.select(
        "alpha",
        F.col("retriever.recall_k").alias("recall_k"),
        F.col("retriever.mrr").alias("mrr"),
        F.col("generator.exact_match_score").alias("exact_match_score"),
    )
