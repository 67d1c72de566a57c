"""Pack token sequences into as few fixed-size sequences as can be.

Method: exact-complement hashing. Texts are counted by length; from the longest on, the gap
that a length leaves is looked up among the single lengths, then among sums of two and of
three lengths, and combinations that fill it exactly are consumed as often as all of their
lengths are available. What has no exact complement is packed by best fit.

Only the counts per length, at most ``size`` of them, are planned on the driver; Spark numbers
the pieces of every length and gives each its place.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trawlnet.llm.frames import extended, sized
from trawlnet.llm.units import byte_level, cut_units
from trawlnet.llm.windows import ranges, starts_of
from trawlnet.sources.scratch import materialize

SIZE = 2048
END = 0  # id that ends a document
BATCH_BYTES = 4 << 20  # of texts that are encoded together
PART_ROWS = 20_000  # pieces of one length that are numbered together


def token_ids(texts: pa.Array, tokenizer: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a batch in one array, and their number per text."""
    units, n_units = cut_units(pc.fill_null(texts, ""))
    ids, counts = byte_level(tokenizer).encode(units.dictionary)
    code = units.indices.to_numpy()
    sizes = counts[code]
    ids = ids[np.repeat(starts_of(counts)[code], sizes) + ranges(sizes)]
    return ids, np.diff(starts_of(sizes)[starts_of(n_units)])


def token_pieces(docs: DataFrame, tokenizer: str, size: int, keep: list[str]) -> DataFrame:
    """One row per piece: ``piece``, ``start``, ``length`` and ``ids_crc32`` after ``keep``."""

    def run(batches):
        for batch in sized(batches, BATCH_BYTES):
            ids, lengths = token_ids(batch.column("text"), tokenizer)
            counts = (lengths + 1 + size - 1) // size
            full = np.full(int(lengths.sum()) + len(lengths), END, "<u4")
            first = starts_of(lengths + 1)
            full[np.repeat(first[:-1], lengths) + ranges(lengths)] = ids
            row = np.repeat(np.arange(len(lengths)), counts)
            piece = ranges(counts)
            head = (lengths + 1) - (counts - 1) * size  # length of the first piece
            start = np.where(piece == 0, 0, head[row] + (piece - 1) * size)
            length = np.where(piece == 0, head[row], size)
            begin = first[row] + start
            crc = [zlib.crc32(full[b : b + n].tobytes()) for b, n in zip(begin, length, strict=True)]
            kept = batch.select(keep).take(pa.array(row))
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                names=[*keep, "piece", "start", "length", "ids_crc32"],
            )

    schema = extended(docs, keep, "piece int, start long, length long, ids_crc32 long")
    return docs.select(*[c for c in keep if c != "text"], "text").mapInArrow(run, schema)


def plan(counts: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths that share a sequence, and how many sequences follow each.

    Uses every length as often as ``counts`` says. Patterns are far fewer than pieces: every
    step uses a length up, or opens bins of one kind.
    """
    left = np.zeros(size + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    found: list[tuple[tuple[int, ...], int]] = []

    def consume(pattern: tuple[int, ...]) -> int:
        times = min(left[x] // n for x, n in Counter(pattern).items())
        if times > 0:
            for x in pattern:
                left[x] -= times
            found.append((pattern, int(times)))
        return int(times)

    if left[size]:
        consume((size,))
    for long in range(size - 1, 0, -1):
        gap = size - long
        if left[long] and gap <= long and left[gap]:
            consume((long, gap))
        for a in np.flatnonzero(left[1:gap])[::-1] + 1:
            if not left[long]:
                break
            if a >= gap - a > 0 and left[a] and left[gap - a]:
                consume((long, int(a), int(gap - a)))
        for a in np.flatnonzero(left[1:gap])[::-1] + 1:
            if not left[long]:
                break
            rest = gap - int(a)
            if rest < 2 or not left[a]:
                continue
            b = np.arange(min(int(a), rest - 1), (rest - 1) // 2, -1)
            for x in b[(left[b] > 0) & (left[rest - b] > 0)]:
                if not left[long] or not left[a]:
                    break
                consume((long, int(a), int(x), int(rest - x)))
    open_bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    gaps: list[int] = []

    def add(gap: int, pattern: tuple[int, ...], times: int) -> None:
        if gap not in open_bins:
            open_bins[gap] = []
            bisect.insort(gaps, gap)
        open_bins[gap].append((pattern, times))

    for length in np.flatnonzero(left)[::-1]:
        length, n = int(length), int(left[length])
        while n:
            at = bisect.bisect_left(gaps, length)
            if at == len(gaps):
                each = size // length
                times, each = (n // each, each) if n >= each else (1, n)
                add(size - each * length, (length,) * each, times)
                n -= times * each
                continue
            gap = gaps[at]
            pattern, times = open_bins[gap].pop()
            if not open_bins[gap]:
                del open_bins[gap], gaps[at]
            used = min(n, times)
            add(gap - length, (*pattern, length), used)
            if used < times:
                add(gap, pattern, times - used)
            n -= used
    return found + [x for bins in open_bins.values() for x in bins]


def _slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """Runs of numbers per length: where they begin, their first sequence and their offset."""
    rows, used, sequence = [], Counter(), 0
    for pattern, times in patterns:
        offset = 0
        for length in pattern:
            rows.append((length, used[length], sequence, offset))
            used[length] += times
            offset += length
        sequence += times
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 4)
    return {"key": table[:, 0] << 44 | table[:, 1], "rank": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3]}


def pack(pieces_of: DataFrame, size: int = SIZE) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a table of pieces (doc_id, piece, start, length, ...).

    Sequences hold at most ``size`` and have no holes. Equal rows get different places. No
    rows, no sequences. The lengths are counted and the packing is planned before the result
    is returned.
    """
    rows = materialize(pieces_of, "pieces")
    spark, keep = rows.sparkSession, rows.columns
    counted = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = max(16, sum(counted.values()) // PART_ROWS + 1)
    patterns = plan(counted, size)
    inside = spark.sparkContext.broadcast(_slots(patterns))
    parted = rows.withColumn("_part", F.pmod(F.xxhash64(*keep), F.lit(parts)).cast("int"))
    numbers = parted.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("_part")) - F.col("n")
    numbers = numbers.select("length", "_part", before.alias("_before"))
    own = F.row_number().over(Window.partitionBy("length", "_part").orderBy(*keep)) - 1
    ranked = parted.withColumn("_own", own).join(numbers, ["length", "_part"])
    ranked = ranked.select(*keep, (F.col("_before") + F.col("_own")).alias("_rank"))

    def place(batches):
        slots = inside.value
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("_rank").to_numpy()
            at = np.searchsorted(slots["key"], length << 44 | rank, side="right") - 1
            sequence = slots["sequence"][at] + rank - slots["rank"][at]
            yield pa.RecordBatch.from_arrays(
                [*batch.select(keep).columns, pa.array(sequence), pa.array(slots["offset"][at])],
                names=[*keep, "sequence_id", "offset"],
            )

    return ranked.mapInArrow(place, extended(rows, keep, "sequence_id long, offset long"))


def pack_documents(docs: DataFrame, tokenizer: str, size: int = SIZE) -> DataFrame:
    """Tokenize (doc_id, text), end every document with id 0, cut and pack.

    A document of more than ``size`` tokens is cut into pieces of ``size``; only its first may
    be shorter. A NULL or empty text is a document of one token. Repeated rows and rows
    without a doc_id are packed like others; other columns are ignored. One row per piece:
    doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    """
    return pack(token_pieces(docs.select("doc_id", "text"), tokenizer, size, ["doc_id"]), size)
