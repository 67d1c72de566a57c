"""Word splitting in Arrow batches, for whole corpora.

It splits on the same code points as :func:`text.words`. The regular expression split of
the JVM takes about a microsecond per word; this takes a tenth of it plus the transfer,
so scans of a corpus use it and expressions over small tables stay on the JVM.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS = 2000  # of a batch of documents; the usual 10,000 long ones fill a worker's memory
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_USUAL = "10000"
PIECE = 4 << 20  # bytes of texts whose words a task looks at together; about 20 times as much memory


def pieces(batch: pa.RecordBatch, most_bytes: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Cut a batch of long texts, whose words take several times the memory."""
    step = max(1, batch.num_rows * most_bytes // max(batch.nbytes, 1))
    for start in range(0, batch.num_rows, step):
        yield batch.slice(start, step)


def bound_batches(spark: SparkSession) -> None:
    """Have the session hand documents to Python in small batches, unless it has a setting of its own."""
    if spark.conf.get(_ROWS, _USUAL) == _USUAL:
        spark.conf.set(_ROWS, str(ROWS))


def sized(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``size`` bytes: small ones together, large ones cut."""
    held: list[pa.RecordBatch] = []
    n_bytes = 0
    for batch in batches:
        held.append(batch)
        n_bytes += batch.nbytes
        if n_bytes >= size:
            yield from _together(held, size)
            held, n_bytes = [], 0
    yield from _together(held, size)


def _together(held: list[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    held = [b for b in held if b.num_rows]
    if len(held) > 1:
        held = pa.Table.from_batches(held).combine_chunks().to_batches()
    for batch in held:
        yield from pieces(batch, size)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All whitespace tokens of a batch in one flat array, and the number in each text.

    NULL and blank texts have none.
    """
    trimmed = pc.utf8_trim_whitespace(pc.fill_null(texts, ""))
    lists = pc.utf8_split_whitespace(trimmed)
    blank = pc.equal(trimmed, "").to_numpy(zero_copy_only=False)
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False) - blank
    flat = lists.flatten()
    if blank.any():
        flat = flat.filter(pc.not_equal(flat, ""))
    return flat, lengths.astype(np.int64)


def neighbours(flat: pa.Array, lengths: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Neighbouring tokens of each text joined by a space, and the number in each text."""
    if len(flat) < 2:
        return flat.slice(0, 0), np.zeros_like(lengths)
    joined = pc.binary_join_element_wise(flat[:-1], flat[1:], " ")
    same_text = np.ones(len(joined), dtype=bool)
    ends = np.cumsum(lengths)[:-1]
    same_text[ends[(ends > 0) & (ends < len(flat))] - 1] = False
    return joined.filter(pa.array(same_text)), np.maximum(lengths - 1, 0)


def only(flat: pa.Array, lengths: np.ndarray, wanted: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The tokens that occur in ``wanted``, and the number in each text."""
    mask = pc.is_in(flat, value_set=wanted)
    row = np.repeat(np.arange(len(lengths)), lengths)
    kept = row[mask.to_numpy(zero_copy_only=False)]
    return flat.filter(mask), np.bincount(kept, minlength=len(lengths))


def as_lists(flat: pa.Array, lengths: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), flat)


def once(udf):
    """Keep the optimiser from copying a Python function into filters that it pushes down.

    ``explode`` and later filters on the result would otherwise run the function a second
    time below. Unused results are still pruned.
    """
    return udf.asNondeterministic()


@once
@F.arrow_udf(T.ArrayType(T.StringType()))
def words(texts: pa.Array) -> pa.Array:
    """Whitespace tokens in their own case, as :func:`text.words` gives them."""
    return as_lists(*split_words(texts))


@once
@F.arrow_udf(T.LongType())
def n_words(texts: pa.Array) -> pa.Array:
    """Number of whitespace tokens."""
    return pa.array(split_words(texts)[1])
