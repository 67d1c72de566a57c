"""From wide documents to clean sections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawlnet.operators.joins import bounded

# Section columns of a raw filing.
SECTIONS = (
    "section_1",
    "section_1A",
    "section_1B",
    "section_2",
    "section_3",
    "section_4",
    "section_5",
    "section_6",
    "section_7",
    "section_7A",
    "section_8",
    "section_9",
    "section_9A",
    "section_9B",
    "section_10",
    "section_11",
    "section_12",
    "section_13",
    "section_14",
    "section_15",
)


def entity(df: DataFrame, key: str, column: str = "cik") -> DataFrame:
    """Rows of one entity.

    Keys are strings of digits. Comparing with a string keeps the filter in the parquet
    scan; an integer would cast the column and fail on keys that are no number.
    """
    return df.where(F.col(column) == F.lit(str(key)))


def unpivot_sections(
    df: DataFrame,
    ids: Sequence[str] = ("cik", "year"),
    sections: Sequence[str] = SECTIONS,
) -> DataFrame:
    """One row per document and section. NULL sections are kept; the plan is narrow."""
    return df.unpivot(list(ids), list(sections), "section", "description")


def clean_sections(df: DataFrame, column: str = "description") -> DataFrame:
    """Cut trailing spaces (not tabs or newlines), then drop NULL and empty text."""
    trimmed = df.withColumn(column, F.rtrim(F.col(column)))
    return trimmed.na.drop(subset=[column]).where(F.col(column) != "")


def lookup(df: DataFrame, **values: str) -> DataFrame:
    """Rows whose columns equal the given values; no match gives no row."""
    for name, value in values.items():
        df = df.where(F.col(name) == F.lit(value))
    return df


def lookup_many(df: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose key occurs in ``keys``; the join columns are all columns of ``keys``.

    Few keys are broadcast, so that the rows stay where they are even if one key holds
    many of them; more keys are joined by shuffle.
    """
    return df.join(bounded(keys.distinct()), keys.columns, "left_semi")
