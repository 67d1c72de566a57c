"""Which tokens of two tokenizers stand for the same bytes, and how often over a corpus.

Method: inverted pair bitmaps. A text is cut where tokens of both end, and all tokens of either
side between two cuts are linked. Texts are numbered within blocks; every linked pair of ids
has a compressed bitmap of the texts of a block that hold it (places of single texts while that
is shorter, else one bit a text), into which the bits of its texts are OR-ed, and multiplicity
planes: bit ``j`` of the number of links of a text stands in plane ``j``. The popcounts of the
bitmaps add up to the number of texts of a pair; read back, the postings of a block return
to each of its texts the scores of its links.

Bitmaps never leave their block, so a pair that occurs in every text is one short row per
block; what Spark adds up by pair are their popcounts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from trawlnet.llm.frames import extended, sized
from trawlnet.llm.units import byte_level, cut_units, piece_model
from trawlnet.llm.windows import ranges, starts_of
from trawlnet.sources.scratch import materialize

BLOCK_BYTES = 4 << 20  # of texts that share a block
BLOCK_ROWS = 1 << 16  # texts of a block; their numbers take two bytes
_B = 20  # bits of an id of the second tokenizer
_POSTING = "a int, b int, n_docs long, docs binary, planes binary"


class _Aligned:
    """Both token rows of distinct units, their groups and links; units as in ``cut_units``."""

    def __init__(self, units: pa.Array, first, second):
        self.a, self.n_a = first.encode(units)
        self.b, self.n_b = second.encode(units)
        n = len(units)
        _, offsets, data = units.buffers()
        ends = np.frombuffer(offsets, np.int32)[units.offset : units.offset + n + 1].astype(np.int64)
        raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if n else np.empty(0, np.uint8)
        size = np.diff(ends)
        self.good = self._spells(self.a, self.n_a, first, raw, size) & self._spells(self.b, self.n_b, second, raw, size)
        self.a, self.b = self.a[np.repeat(self.good, self.n_a)], self.b[np.repeat(self.good, self.n_b)]
        self.n_a, self.n_b = self.n_a * self.good, self.n_b * self.good
        end_a, end_b = np.cumsum(first.sizes[self.a]), np.cumsum(second.sizes[self.b])
        both = np.intersect1d(end_a, end_b)  # a group ends where tokens of both end
        self.group_a, self.group_b = np.searchsorted(both, end_a), np.searchsorted(both, end_b)
        self.n_groups = np.zeros(n, np.int64)
        if len(both):
            last = np.searchsorted(np.cumsum(size * self.good), both)
            self.n_groups = np.bincount(last, minlength=n)
        self.groups = len(both)

    @staticmethod
    def _spells(ids, counts, vocabulary, raw, size) -> np.ndarray:
        """Whether the bytes of the tokens are those of the unit."""
        spelled = np.frombuffer(b"".join([vocabulary.bytes[i] for i in ids.tolist()]), np.uint8)
        own = np.diff(np.concatenate([[0], np.cumsum(vocabulary.sizes[ids])])[starts_of(counts)])
        good = own == size
        if len(spelled) == len(raw) and good.all():
            wrong = np.flatnonzero(spelled != raw)
            good[np.searchsorted(np.cumsum(size), wrong, side="right")] = False
            return good
        begin, place = starts_of(own), starts_of(size)
        for i in np.flatnonzero(good & (size > 0)):
            good[i] = np.array_equal(spelled[begin[i] : begin[i + 1]], raw[place[i] : place[i + 1]])
        return good

    def printed(self) -> pa.Array:
        """The groups of each unit as ``a1,a2|b1;`` one after the other."""
        group = np.concatenate([self.group_a, self.group_b])
        side = np.repeat([0, 1], [len(self.a), len(self.b)])
        last = np.concatenate([np.diff(g, append=-1) != 0 for g in (self.group_a, self.group_b)])
        order = np.argsort(group * 2 + side, kind="stable")
        ids = np.concatenate([self.a, self.b])
        width = int(ids.max(initial=0)) + 1
        forms = pa.array([f"{i}{mark}" for mark in ",|;" for i in range(width)])
        mark = np.where(last, 1 + side, 0)
        flat = forms.take(pa.array((mark * width + ids)[order]))
        _, offsets, data = flat.buffers()
        ends = np.frombuffer(offsets, np.int32)[: len(flat) + 1]
        return pa.StringArray.from_buffers(len(self.n_a), pa.py_buffer(ends[starts_of(self.n_a + self.n_b)].astype(np.int32)), data)

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Linked pairs of ids by unit, how often, and how many per unit."""
        (ga, a, ca), (gb, b, cb) = (_counted(g, x) for g, x in ((self.group_a, self.a), (self.group_b, self.b)))
        na, nb = np.bincount(ga, minlength=self.groups), np.bincount(gb, minlength=self.groups)
        pairs = na * nb
        group = np.repeat(np.arange(self.groups), pairs)
        inside = ranges(pairs)
        left = starts_of(na)[group] + inside // np.maximum(nb[group], 1)
        right = starts_of(nb)[group] + inside % np.maximum(nb[group], 1)
        unit = np.repeat(np.arange(len(self.n_groups)), self.n_groups)
        per_unit = np.bincount(unit, weights=pairs, minlength=len(self.n_groups)).astype(np.int64)
        return a[left] << _B | b[right], ca[left] * cb[right], per_unit


def _counted(group: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ids of each group and how often they occur there."""
    key, n = np.unique(group << 32 | ids, return_counts=True)
    return key >> 32, key & 0xFFFFFFFF, n


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of ``n`` of each."""
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    return key[first], np.add.reduceat(n, first) if len(first) else n


def pack_postings(pair: np.ndarray, doc: np.ndarray, times: np.ndarray, width: int) -> pa.RecordBatch:
    """One row per pair from (pair, doc, times) in that order; ``width`` texts in the block."""
    first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.empty(0, np.int64)
    count = np.diff(np.append(first, len(pair)))
    row = np.repeat(np.arange(len(first)), count)
    rank = ranges(count)
    whole = -(-width // 8)
    dense = 2 * count > whole
    length = np.where(dense, whole, 2 * count)
    begin = starts_of(length)
    bits = np.zeros(int(begin[-1]) * 8, bool)
    held = dense[row]
    bits[begin[row[held]] * 8 + doc[held]] = True
    docs = np.packbits(bits)
    at = begin[row[~held]] + 2 * rank[~held]
    docs[at], docs[at + 1] = doc[~held] & 255, doc[~held] >> 8
    most = np.maximum.reduceat(times, first) if len(first) else times
    n_planes = np.where(most > 1, np.frexp(most.astype(float))[1], 0)
    plane = -(-count // 8)
    base = starts_of(n_planes * plane)
    bits = np.zeros(int(base[-1]) * 8, bool)
    for j in range(int(n_planes.max(initial=0))):
        on = (n_planes[row] > j) & (times >> j & 1 > 0)
        bits[(base[row[on]] + j * plane[row[on]]) * 8 + rank[on]] = True
    key = pair[first]
    return pa.RecordBatch.from_arrays(
        [
            pa.array((key >> _B).astype(np.int32)), pa.array((key & ((1 << _B) - 1)).astype(np.int32)),
            pa.array(count), _binary(docs, begin), _binary(np.packbits(bits), base),
        ],
        names=["a", "b", "n_docs", "docs", "planes"],
    )


def _binary(data: np.ndarray, begin: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(begin) - 1, [None, pa.py_buffer(begin.astype(np.int32)), pa.py_buffer(data)])


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    _, offsets, data = column.buffers()
    begin = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw, begin


def unpack_postings(n_docs: np.ndarray, docs: pa.Array, planes: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, doc, times) of packed postings."""
    raw, begin = _bytes(docs)
    length = np.diff(begin)
    dense = length != 2 * n_docs
    row = np.repeat(np.arange(len(n_docs)), n_docs)
    rank, first = ranges(n_docs), starts_of(n_docs)
    doc = np.empty(len(row), np.int64)
    sparse = ~dense[row]
    at = begin[:-1][row[sparse]] + 2 * rank[sparse]
    doc[sparse] = raw[at] | raw[at + 1].astype(np.int64) << 8
    for i in np.flatnonzero(dense):
        doc[first[i] : first[i + 1]] = np.flatnonzero(np.unpackbits(raw[begin[i] : begin[i + 1]]))
    raw, begin = _bytes(planes)
    plane = -(-n_docs // 8)
    n_planes = np.diff(begin) // np.maximum(plane, 1)
    times = np.where(n_planes[row] > 0, 0, 1)
    for j in range(int(n_planes.max(initial=0))):
        on = np.flatnonzero(n_planes[row] > j)
        at = begin[:-1][row[on]] + j * plane[row[on]] + (rank[on] >> 3)
        times[on] += (raw[at] >> (7 - (rank[on] & 7)) & 1).astype(np.int64) << j
    return row, doc, times


def _block(texts: pa.Array, first, second) -> tuple[pa.RecordBatch, pa.RecordBatch]:
    """Counts and printed groups of each text, and the postings of all."""
    given = pa.array([" " + t if t else "" for t in texts.to_pylist()], pa.string())
    coded, n_units = cut_units(given)
    n = len(given)
    aligned = _Aligned(coded.dictionary, first, second)
    code, doc = coded.indices.to_numpy().astype(np.int64), np.repeat(np.arange(n), n_units)
    odd = np.unique(doc[~aligned.good[code]]) if len(code) else np.empty(0, np.int64)
    kept = ~np.isin(doc, odd)
    code, doc = code[kept], doc[kept]
    totals = [np.bincount(doc, weights=x[code], minlength=n).astype(np.int64) for x in (aligned.n_a, aligned.n_b, aligned.n_groups)]
    flat = aligned.printed().take(pa.array(code))
    raw, begin = _bytes(flat)
    ends = begin[starts_of(np.bincount(doc, minlength=n))]
    view = memoryview(raw)
    digest = [
        hashlib.sha256(view[s : e - 1]).hexdigest() if e > s else "" for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)
    ]
    info = pa.RecordBatch.from_arrays([*map(pa.array, totals), pa.array(digest, pa.string())], names=["n_a", "n_b", "n_groups", "groups_sha256"])
    pair, times, per_unit = aligned.links()
    held, n_held = np.unique(doc * max(len(aligned.n_a), 1) + code, return_counts=True)
    of, unit = held // max(len(aligned.n_a), 1), held % max(len(aligned.n_a), 1)
    each = per_unit[unit]
    at = np.repeat(starts_of(per_unit)[unit], each) + ranges(each)
    key, sums = _summed(pair[at] * n + np.repeat(of, each), times[at] * np.repeat(n_held, each))
    return info, pack_postings(key // max(n, 1), key % max(n, 1), sums, n)


def build_index(docs: DataFrame, first: str, second: str, keep: list[str]) -> DataFrame:
    """Blocks of texts and the postings of their linked pairs, written to the shared folder.

    Rows with ``slot`` are texts, with the columns ``keep``; the others postings. ``first`` is
    the file of a byte-level tokenizer, ``second`` one of pieces.
    """
    added = f"block string, slot int, n_a long, n_b long, n_groups long, groups_sha256 string, {_POSTING}"
    schema = extended(docs, keep, added)
    kinds = {f.name: f.type for f in to_arrow_schema(schema)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def filled(part: pa.RecordBatch, block: str) -> pa.RecordBatch:
            part = part.append_column("block", pa.repeat(block, part.num_rows))
            columns = [part.column(c).cast(kinds[c]) if c in part.schema.names else pa.nulls(part.num_rows, kinds[c]) for c in kinds]
            return pa.RecordBatch.from_arrays(columns, names=list(kinds))

        tokens, pieces = byte_level(first, True), piece_model(second)
        for whole in sized(batches, BLOCK_BYTES):
            for start in range(0, whole.num_rows, BLOCK_ROWS):
                batch = whole.slice(start, BLOCK_ROWS)
                info, postings = _block(batch.column("_text"), tokens, pieces)
                names = [*keep, "slot", *info.schema.names]
                slots = pa.array(np.arange(batch.num_rows, dtype=np.int32))
                rows = pa.RecordBatch.from_arrays([*batch.select(keep).columns, slots, *info.columns], names=names)
                block = uuid4().hex  # written before anyone reads it
                yield filled(rows, block)
                for at in range(0, postings.num_rows, 1 << 16):
                    yield filled(postings.slice(at, 1 << 16), block)

    return materialize(docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, schema), "pairs")


def pair_counts(postings: DataFrame) -> DataFrame:
    """(a, b, count, best): texts that hold a pair linked, and if no pair of ``a`` is in more."""
    counted = postings.groupBy("a", "b").agg(F.sum("n_docs").alias("count"))
    most = F.max("count").over(Window.partitionBy("a"))
    return counted.withColumn("best", F.col("count") == most)


def align(docs: DataFrame, first: str, second: str, keep: list[str]) -> DataFrame:
    """Per row of ``docs`` (text, and the columns ``keep``): tokens, groups and scores of its links.

    Columns after ``keep``: n_a, n_b (tokens), n_groups, n_links, n_best (links to a partner
    that no other of the first token's exceeds in texts), count_sum (texts of the pairs, over
    links), groups_sha256. The second tokenizer's blank in front of a text counts for both.
    NULL and empty texts, and those that one of the tokenizers does not spell byte by byte,
    have no tokens: zeros and an empty digest. Each row is a text of its own, whether it repeats or
    not, and a missing id is kept. Other columns are ignored; no rows give no rows.
    The index is built before the result is returned.
    """
    index = build_index(docs, first, second, keep)
    postings = index.where("a is not null").select("block", "a", "b", "n_docs", "docs", "planes")
    scored = postings.join(pair_counts(postings), ["a", "b"]).select("block", "n_docs", "docs", "planes", "count", "best")
    texts = index.where("slot is not null").select(F.col("block").alias("home"), "slot", *keep, "n_a", "n_b", "n_groups", "groups_sha256")
    schema = extended(docs, keep, "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")

    def score(one: pa.Table, other: pa.Table) -> pa.Table:
        one, other = one.combine_chunks(), other.combine_chunks()
        n = other.num_rows
        totals = np.zeros((3, n), np.int64)
        if one.num_rows:
            n_docs, count, best = (one.column(c).to_numpy().astype(np.int64) for c in ("n_docs", "count", "best"))
            row, doc, times = unpack_postings(n_docs, one.column("docs").chunk(0), one.column("planes").chunk(0))
            for total, value in zip(totals, (times, times * best[row], times * count[row]), strict=True):
                np.add.at(total, doc, value)
        slot = other.column("slot").to_numpy()
        links = dict(zip(("n_links", "n_best", "count_sum"), totals[:, slot], strict=True))
        return pa.table({c: links[c] if c in links else other.column(c) for c in schema.names})

    return scored.groupBy("block").cogroup(texts.groupBy("home")).applyInArrow(score, schema)

