"""Connected components of an edge table by alternating large and small stars.

Every round is a few shuffles of the edges; the edges never leave the executors. The
number of rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawlnet.sources.scratch import materialize


def _stars(edges: DataFrame) -> DataFrame:
    """One large and one small star round over edges (u, v) with v < u."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("w")).withColumn("m", F.least("u", "w"))
    large = (
        both.join(least, "u")
        .where("v > u and v <> m")
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .unionAll(least.where("m < u").select("u", F.col("m").alias("v")))
        .distinct()
    )
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.unionAll(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _is_done(edges: DataFrame) -> bool:
    """Whether everything hangs on one node each, and nothing hangs on that."""
    none = F.lit(None).cast(edges.schema["v"].dataType)
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("on"), F.lit(0).alias("holds"))
    nodes = nodes.unionAll(edges.select(F.col("v").alias("node"), none.alias("on"), F.lit(1).alias("holds")))
    ends = nodes.groupBy("node").agg(F.min("on").alias("low"), F.max("on").alias("high"), F.max("holds").alias("holds"))
    return ends.where("low <> high or (low is not null and holds = 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every end of an edge (a, b); component is its smallest id.

    NULL ends and loops are left out; repeated edges count once. No edges, no rows.
    """
    ordered = (
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    current = materialize(ordered, "edges")
    while not _is_done(current):
        current = materialize(_stars(current), "edges")
    roots = current.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(roots)
