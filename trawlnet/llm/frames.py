"""Schemas and batches of operators that run in Arrow batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from trawlnet.functions.batches import bound_batches, sized

__all__ = ["bound_batches", "extended", "sized"]


def extended(df: DataFrame, keep: list[str], added: str) -> T.StructType:
    """The columns ``keep`` of ``df``, then those of the DDL string ``added``."""
    return T.StructType(df.select(*keep).schema.fields + T.StructType.fromDDL(added).fields)
