"""Top-k over score tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Scores that agree to this many places are ties, and the lower key comes first. Sums of
# doubles differ in their last bits with the order of addition; this keeps ranks stable.
TIE_PLACES = 9
SALTS = 16


def top_k(
    scores: DataFrame,
    keys: Sequence[str],
    k: int,
    column: str = "score",
    tie: str = "chunk_id",
    places: int | None = TIE_PLACES,
) -> DataFrame:
    """The ``k`` best rows per key with their 1-based ``rank``; NULL scores come last.

    ``places`` is None where the column holds rounded scores already.
    Two rounds: first within salted parts of each key, then within the key. One query
    may have rows from every task of a large scan, and no single task sorts them all.
    """
    score = F.col(column) if places is None else F.round(column, places)
    order = [score.desc_nulls_last(), F.col(tie).asc()]
    salted = scores.withColumn("_salt", F.pmod(F.xxhash64(tie), F.lit(SALTS)))
    part = Window.partitionBy(*keys, "_salt").orderBy(*order)
    whole = Window.partitionBy(*keys).orderBy(*order)
    kept = salted.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= k)
    ranked = kept.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= k)
    return ranked.drop("_salt")
