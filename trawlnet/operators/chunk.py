"""Overlapping chunks by recursive splitting."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawlnet.functions.batches import once

# Separators from coarse to fine, and the usual size and overlap.
SEPARATORS = ("\n\n", "\n", " ", "")
SIZE, OVERLAP = 2000, 100


def _pieces(text: str, separator: str) -> list[str]:
    """Cut before each separator, so that it begins the next piece."""
    if not separator:
        return list(text)
    first, *rest = text.split(separator)
    return [piece for piece in (first, *(separator + r for r in rest)) if piece]


def _windows(pieces: Sequence[str], size: int, overlap: int) -> Iterator[str]:
    """Runs of pieces up to ``size``; each begins with up to ``overlap`` of the one before."""
    window: deque[str] = deque()
    held = 0
    for piece in pieces:
        if held + len(piece) > size:
            yield "".join(window)
            while held > overlap or (held and held + len(piece) > size):
                held -= len(window.popleft())
        window.append(piece)
        held += len(piece)
    yield "".join(window)


def _raw_chunks(text: str, separators: Sequence[str], size: int, overlap: int) -> Iterator[str]:
    level = next(i for i, s in enumerate(separators) if s in text)
    finer = separators[level + 1 :]
    run: list[str] = []
    for piece in _pieces(text, separators[level]):
        if len(piece) < size:
            run.append(piece)
            continue
        yield from _windows(run, size, overlap)
        run = []
        if finer:
            yield from _raw_chunks(piece, finer, size, overlap)
        else:
            yield piece
    yield from _windows(run, size, overlap)


def split_text(text: str | None, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """Chunks of one text, stripped, blank ones dropped. NULL and empty give none."""
    if not text:
        return []
    stripped = (raw.strip() for raw in _raw_chunks(text, SEPARATORS, size, overlap))
    return [chunk for chunk in stripped if chunk]


def split_column(size: int = SIZE, overlap: int = OVERLAP):
    """A vectorised function from a text column to an array of chunks."""
    if overlap > size:
        raise ValueError(f"overlap {overlap} is larger than chunk size {size}")

    @once
    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_text(t, size, overlap))

    return split


def chunk(
    df: DataFrame,
    column: str = "description",
    keys: Sequence[str] = ("cik", "year", "filename", "section"),
    size: int = SIZE,
    overlap: int = OVERLAP,
    keep_text: bool = False,
) -> DataFrame:
    """One row per chunk with its ``position`` and ``chunk_id`` = keys and position.

    The keys have to name one text; those that ``df`` does not have are left out.
    Narrow: no shuffle, and the source text is not copied to its chunks unless asked for.
    """
    arrays = df.withColumn("_chunks", split_column(size, overlap)(F.col(column)))
    kept = df.columns if keep_text else [c for c in df.columns if c != column]
    rows = arrays.select(*kept, F.posexplode("_chunks").alias("position", "chunk"))
    return rows.withColumn("chunk_id", chunk_id(*(k for k in keys if k in df.columns)))


def chunk_id(*keys: str) -> Column:
    """Keys and zero-padded position, so that text order is document order."""
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]
    return F.concat_ws("/", *parts, F.format_string("%08d", F.col("position")))
