"""Broadcast joins behind a check of the broadcast side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000


def bounded(df: DataFrame, most_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark ``df`` for broadcast if it has at most ``most_rows`` rows.

    The check reads no more than one row beyond the bound. A larger table is returned as
    it is, for the optimiser to join by shuffle. Meant for tables of keys: rows must be
    narrow.
    """
    within = df.limit(most_rows + 1).count() <= most_rows
    return F.broadcast(df) if within else df
