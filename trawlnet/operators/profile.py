"""One-pass profiles of a table and of its text lengths."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawlnet.functions import batches, text


def preview(df: DataFrame, n: int, width: int = 25) -> DataFrame:
    """First ``n`` rows with every value shortened to ``width`` characters."""
    return df.limit(n).select([text.shorten(name, width).alias(name) for name in df.columns])


def schema_table(df: DataFrame) -> DataFrame:
    """Columns and types of ``df`` as a table."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, column_name string, type string")


def counts(df: DataFrame, predicates: Mapping[str, Column]) -> DataFrame:
    """Rows in all and rows per predicate, in one scan."""
    parts = [F.count_if(test).alias(name) for name, test in predicates.items()]
    return df.agg(F.count(F.lit(1)).alias("n_rows"), *parts)


def null_counts(df: DataFrame) -> DataFrame:
    """Number of NULLs of each column, in one scan."""
    return _per_column(df, lambda c: F.col(c).isNull(), "nulls")


def blank_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Number of empty strings of each given column, in one scan."""
    return _per_column(df.select(*columns), lambda c: F.col(c) == "", "blanks")


def _per_column(df: DataFrame, test, value: str) -> DataFrame:
    row = df.agg(*[F.count_if(test(c)).alias(c) for c in df.columns])
    return row.unpivot([], df.columns, "column_name", value)


def split_sizes(df: DataFrame, tag: str = "split") -> DataFrame:
    return df.groupBy(tag).agg(F.count(F.lit(1)).alias("n_rows"))


def token_counts(df: DataFrame, column: str, counter=None) -> DataFrame:
    """Add ``token_count``; whitespace tokens unless ``counter`` maps a column to a column."""
    count = counter or batches.n_words
    return df.withColumn("token_count", count(F.col(column)).cast("long"))


def histogram(df: DataFrame, column: str) -> DataFrame:
    """Value and number of rows. Quantiles below read this instead of the rows, so the
    one task that ends an exact quantile sees distinct values only."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def _quantiles(*q: float) -> Column:
    return F.percentile(F.col("value"), F.array(*[F.lit(x) for x in q]), F.col("n"))


def token_budget(df: DataFrame, column: str, q: float, chunk_tokens: int) -> DataFrame:
    """Exact quantile (linear, cut to an integer), total, and chunks that total makes."""
    row = histogram(df, column).agg(
        _quantiles(q)[0].cast("long").alias("quantile"),
        F.sum(F.col("value") * F.col("n")).alias("total"),
    )
    return row.withColumn("n_chunks", F.expr(f"total div {int(chunk_tokens)}"))


def summary(df: DataFrame, column: str) -> DataFrame:
    """Largest, smallest, mean (two places, half to even) and median value."""
    mean = F.sum(F.col("value") * F.col("n")) / F.sum("n")
    return histogram(df, column).agg(
        F.max("value").alias("max_value"),
        F.min("value").alias("min_value"),
        F.bround(mean, 2).alias("avg_value"),
        _quantiles(0.5)[0].alias("median_value"),
    )


def _fences(values: DataFrame) -> DataFrame:
    """Quartiles (linear interpolation) and the fences 1.5 interquartile ranges out."""
    row = values.agg(_quantiles(0.25, 0.5, 0.75).alias("q"))
    spread = 1.5 * (F.col("q")[2] - F.col("q")[0])
    return row.select(
        F.col("q")[0].alias("q1"),
        F.col("q")[1].alias("median"),
        F.col("q")[2].alias("q3"),
        (F.col("q")[0] - spread).alias("low"),
        (F.col("q")[2] + spread).alias("high"),
    )


def box(df: DataFrame, column: str) -> DataFrame:
    """The numbers of a box plot: quartiles, whiskers, number of outliers."""
    values = histogram(df, column)
    fences = _fences(values)
    inside = F.col("value").between(fences.select("low").scalar(), fences.select("high").scalar())
    whiskers = values.select(
        "value", "n", inside.alias("inside")
    ).agg(
        F.min(F.when(F.col("inside"), F.col("value"))).alias("whisker_low"),
        F.max(F.when(F.col("inside"), F.col("value"))).alias("whisker_high"),
        F.coalesce(F.sum(F.when(~F.col("inside"), F.col("n"))), F.lit(0)).alias("n_outliers"),
    )
    return whiskers.select(
        *[fences.select(name).scalar().alias(name) for name in ("q1", "median", "q3")],
        *whiskers.columns,
    )


def outliers(df: DataFrame, column: str) -> DataFrame:
    """Rows outside the fences of :func:`box`. ``df`` is read more than once: pass a stored
    table if the column is dear to compute."""
    fences = _fences(histogram(df, column))
    low, high = fences.select("low").scalar(), fences.select("high").scalar()
    return df.where((F.col(column) < low) | (F.col(column) > high))


def random_rows(df: DataFrame, n: int, seed: int | None = None) -> DataFrame:
    """``n`` rows in random order; the sort keeps only ``n`` rows per task."""
    return df.orderBy(F.rand(seed)).limit(n)


def hashed_rows(df: DataFrame, n: int, key: str) -> DataFrame:
    """Like :func:`random_rows` but the same rows each time, whatever the partitioning."""
    return df.orderBy(F.md5(F.col(key).cast("string")), F.col(key)).limit(n)
