"""Retrieval and answer metrics, averaged over all golden questions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawlnet.functions import text


def _frame(gold: DataFrame, alphas: Sequence[float]) -> DataFrame:
    """Every question once per run, so that questions without any hit count as 0."""
    runs = F.array(*[F.lit(float(a)) for a in alphas])
    return gold.select("query_id", F.explode(runs).alias("alpha"))


def _mean(score: Column) -> Column:
    """Macro average to three places, half to even."""
    return F.bround(F.avg(score), 3)


def recall_per_query(
    gold: DataFrame, relevant: DataFrame, retrieved: DataFrame, alphas: Sequence[float]
) -> DataFrame:
    """(query_id, alpha, n_relevant, n_hits, recall); 0 where nothing is relevant.

    Chunks are the same if their texts are the same: ``relevant`` (query_id, text_key)
    and ``retrieved`` (query_id, alpha, text_key) are made distinct, so a text copied
    into many chunks counts once and is shuffled once per task.
    """
    texts = relevant.select("query_id", "text_key").distinct()
    found = retrieved.groupBy("query_id", "text_key").agg(F.collect_set("alpha").alias("found_by"))
    marked = texts.join(found, ["query_id", "text_key"], "left")
    hits = [F.count_if(F.array_contains("found_by", float(a))) for a in alphas]
    totals = marked.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_relevant"),
        F.map_from_arrays(F.array(*[F.lit(float(a)) for a in alphas]), F.array(*hits)).alias("hits"),
    )
    joined = _frame(gold, alphas).join(totals, "query_id", "left")
    counted = joined.select(
        "query_id",
        "alpha",
        F.coalesce("n_relevant", F.lit(0)).alias("n_relevant"),
        F.coalesce(F.col("hits")[F.col("alpha")], F.lit(0)).alias("n_hits"),
    )
    share = F.try_divide(F.col("n_hits"), F.col("n_relevant"))
    return counted.withColumn("recall", F.coalesce(share, F.lit(0.0)))


def reciprocal_rank_per_query(
    gold: DataFrame, retrieved: DataFrame, alphas: Sequence[float]
) -> DataFrame:
    """(query_id, alpha, first_rank, reciprocal_rank) of the first chunk with the passage;
    ``retrieved`` has (query_id, alpha, rank, chunk). A blank passage is in no chunk, as for recall."""
    passages = gold.select("query_id", "full_sentence").where(text.strip("full_sentence") != "")
    checked = retrieved.join(passages, "query_id").where(
        F.contains(F.col("chunk"), F.col("full_sentence"))
    )
    first = checked.groupBy("query_id", "alpha").agg(F.min("rank").alias("first_rank"))
    joined = _frame(gold, alphas).join(first, ["query_id", "alpha"], "left")
    inverse = F.coalesce(F.lit(1.0) / F.col("first_rank"), F.lit(0.0))
    return joined.withColumn("reciprocal_rank", inverse)


def answer_matches(
    gold: DataFrame, predictions: DataFrame, alphas: Sequence[float] | None = None
) -> DataFrame:
    """(query_id, is_match): text answers by :func:`text.same_text`, list answers as sets.

    ``gold`` has gt_text and gt_list; a question without prediction, or a list that
    cannot be read, is no match. With ``alphas``, predictions have an ``alpha``: they answer
    several runs, every question counts in each of them, and so the result has the ``alpha``.
    """
    keys = ["query_id"]
    if alphas is not None:
        keys = ["query_id", "alpha"]
        gold = gold.join(_frame(gold, alphas), "query_id")
    joined = gold.join(predictions.select(*keys, "pred_answer"), keys, "left")
    as_list = text.same_set("gt_list", text.printed_list("pred_answer"))
    as_text = text.same_text("gt_text", "pred_answer")
    match = F.when(F.col("gt_list").isNotNull(), as_list).otherwise(as_text)
    return joined.select(*keys, match.alias("is_match"))


def mean_recall(per_query: DataFrame) -> DataFrame:
    return per_query.groupBy("alpha").agg(_mean(F.col("recall")).alias("recall_k"))


def mean_reciprocal_rank(per_query: DataFrame) -> DataFrame:
    return per_query.groupBy("alpha").agg(_mean(F.col("reciprocal_rank")).alias("mrr"))


def exact_match(matches: DataFrame) -> DataFrame:
    """Share of matches, per ``alpha`` where the matches have one."""
    score = _mean(F.col("is_match").cast("double"))
    keys = ["alpha"] if "alpha" in matches.columns else []
    return matches.groupBy(*keys).agg(score.alias("exact_match_score"))


def bundle(recall: DataFrame, mrr: DataFrame, exact: DataFrame) -> DataFrame:
    """One row per run: alpha, retriever{recall_k, mrr}, generator{exact_match_score}.

    ``exact`` has a row per alpha, or one row for all runs.
    """
    runs = recall.join(mrr, "alpha")
    if "alpha" in exact.columns:
        runs = runs.join(exact, "alpha", "left")
    else:
        runs = runs.withColumn("exact_match_score", exact.scalar())
    return runs.select(
        "alpha",
        F.struct("recall_k", "mrr").alias("retriever"),
        F.struct("exact_match_score").alias("generator"),
    )
