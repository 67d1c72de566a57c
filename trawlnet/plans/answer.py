"""Plain questions to prompts for a chat model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from trawlnet.operators import context
from trawlnet.operators.embed import Model, embed
from trawlnet.plans.evaluate import retrieve, with_years


def prepare(questions: DataFrame, make_model: Callable[[], Model]) -> DataFrame:
    """Add the year filter and the vector of each question (query_id, prompt)."""
    return embed(with_years(questions), make_model, column="prompt", output="vector")


def answer_prompts(
    questions: DataFrame,
    chunks: DataFrame,
    make_model: Callable[[], Model],
    k: int = 10,
    alpha: float = 0.5,
    statistics: DataFrame | None = None,
) -> DataFrame:
    """One row per question: the system prompt to send with it, and what it was made of.

    ``make_model`` must be the model that embedded ``chunks``. The answers of the chat
    model come back as a table (query_id, pred_answer) for the evaluation.
    """
    hits = retrieve(prepare(questions, make_model), chunks, k, [alpha], statistics)
    return context.with_prompt(context.result_bundle(hits))
