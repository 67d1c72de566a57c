"""From ranked hits to prompts and result rows; each query has at most k hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: what is said to the chat model before the context.
TEMPLATE = "Please answer the user query based on the given context "


def _ranked(*columns: str) -> Column:
    return F.array_sort(F.collect_list(F.struct("rank", *columns)))


def _take(column: str) -> Column:
    return F.transform("hits", lambda hit: hit[column])


def _prompt(chunks: Column) -> dict[str, Column]:
    text = F.array_join(chunks, "\n")
    return {"context": text, "system_prompt": F.concat(F.lit(TEMPLATE), text)}


def context(hits: DataFrame, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Chunk texts of each query joined by newlines in rank order, and the full prompt."""
    lists = hits.groupBy(*keys).agg(_ranked("chunk").alias("hits"))
    return lists.withColumns(_prompt(_take("chunk"))).drop("hits")


def with_prompt(bundle: DataFrame) -> DataFrame:
    """Add the context and the full prompt to the rows of :func:`result_bundle`."""
    return bundle.withColumns(_prompt(F.col("top_k_chunks")))


def result_bundle(
    hits: DataFrame,
    predictions: DataFrame | None = None,
    keys: tuple[str, ...] = ("query_id",),
) -> DataFrame:
    """Chunks, sections and years of each query in rank order, with the answer if known."""
    lists = hits.groupBy(*keys).agg(_ranked("chunk", "section", "year").alias("hits"))
    rows = lists.select(
        *keys,
        _take("chunk").alias("top_k_chunks"),
        _take("section").alias("top_k_sections"),
        _take("year").alias("top_k_years"),
    )
    if predictions is None:
        return rows
    return rows.join(predictions.select("query_id", "pred_answer"), "query_id", "left")
