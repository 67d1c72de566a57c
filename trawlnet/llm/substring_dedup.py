"""Remove passages that repeat across documents.

Method: fixed-block anchors. A passage of ``length`` words holds a whole block of
``length / 2`` words wherever the blocks of its document fall, so the non-overlapping blocks
of all documents are the index and every rolling window of the block length is a probe. Hits
are extended to maximal repeats: every window of ``length`` words around a hit is looked up
with a 128-bit hash, and runs of windows that another document has are one repeat.

Probes travel in packed rows, one per batch of texts and range of hashes: five or six bytes a
window. Windows that a sample shows to be very frequent do not travel; they count as hits at
once, which costs a lookup and cannot change a result, since the lookups decide.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawlnet.functions.batches import as_lists
from trawlnet.llm.frames import extended, sized
from trawlnet.llm.windows import (
    ascii_words,
    ranges,
    starts_of,
    window_hashes,
    window_starts,
    word_hashes,
)
from trawlnet.sources.scratch import materialize

LENGTH = 50  # words of the shortest passage removed
TASK_WINDOWS = 1 << 21  # windows that one task looks up
HOT_SAMPLE = 5000  # documents whose windows tell which ones are frequent
HOT_SHARE = 0.002  # of the sample's documents that make a window frequent
MOST_HOT = 1 << 18
_PACKED = "bucket int, kind int, batch long, ids binary, counts binary, hashes binary, places binary"


def _pack(gaps: np.ndarray) -> bytes:
    """Non-negative gaps, a byte or two each; the first byte tells which."""
    step = 255 if not len(gaps) or gaps.mean() < 160 else 65535
    more, last = np.divmod(gaps, step)
    ends = np.cumsum(more + 1) - 1
    out = np.full(int(ends[-1]) + 1 if len(gaps) else 0, step, np.uint8 if step == 255 else np.uint16)
    out[ends] = last
    return bytes([out.itemsize]) + out.tobytes()


def _unpack(data: bytes) -> np.ndarray:
    kind = np.uint8 if data[0] == 1 else np.uint16
    raw = np.frombuffer(data[1:], kind)
    total = np.cumsum(raw, dtype=np.int64)[raw != np.iinfo(kind).max]
    return np.diff(total, prepend=0)


def _rows(schema_names: list[str], rows: list[tuple], types: list) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(schema_names)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=schema_names
    )


_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
_NAMES = ["bucket", "kind", "batch", "ids", "counts", "hashes", "places"]


def _frequent(docs: DataFrame, block: int) -> np.ndarray:
    part = min(1.0, HOT_SAMPLE / max(docs.count(), 1))
    chosen = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1_000_000)) < int(part * 1_000_000)

    def run(batches):
        for batch in sized(batches, 3 << 20):
            flat, lengths = ascii_words(batch.column("text"))
            hashes = window_hashes(word_hashes(flat), block)
            text, at = window_starts(lengths, block)
            h = hashes[at]
            order = np.lexsort((text, h))
            h, text = h[order], text[order]
            new = (np.diff(h, prepend=h[:1] ^ np.uint64(1)) != 0) | (np.diff(text, prepend=-1) != 0)
            h, n = np.unique(h[new], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    counted = docs.where(chosen).select("text").mapInArrow(run, "h long, n long")
    least = max(8, int(HOT_SHARE * HOT_SAMPLE))
    found = counted.groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    found = found.orderBy(F.desc("n"), "h").limit(MOST_HOT).select("h").toArrow()
    return np.sort(found.column("h").to_numpy().view(np.uint64))


def _probes(block: int, buckets: int, hot):
    """Packed rows of all windows of the batches; which texts a batch has; hits known at once."""

    def run(batches):
        frequent = hot.value
        for batch in sized(batches, 3 << 20):
            flat, lengths = ascii_words(batch.column("text"))
            text, at = window_starts(lengths, block)
            if not len(at):
                continue
            hashes = window_hashes(word_hashes(flat), block)[at]
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            keys = batch.column("key").to_numpy(zero_copy_only=False).astype(np.int64)
            own = hashlib.sha256(ids.tobytes() + keys.tobytes() + lengths.tobytes()).digest()
            name = int.from_bytes(own[:8], "little", signed=True)
            is_block = ((at - starts_of(lengths)[text]) % block == 0).astype(np.uint32)
            near = np.minimum(np.searchsorted(frequent, hashes), max(len(frequent) - 1, 0))
            known = frequent[near] == hashes if len(frequent) else np.zeros(len(hashes), bool)
            lanes = np.stack([ids, keys]).tobytes()
            rows = [(name % buckets, 1, name, lanes, lengths.tobytes(), None, None)]
            if known.any():
                rows.append((name % buckets, 2, name, None, None, None, at[known].astype(np.uint32).tobytes()))
            at, hashes, is_block = at[~known], hashes[~known], is_block[~known]
            bucket = (hashes >> np.uint64(40)) % np.uint64(buckets)
            short = (hashes.astype(np.uint32) & np.uint32(0xFFFFFFFE)) | is_block
            order = np.argsort(bucket.astype(np.uint16 if buckets < 1 << 16 else np.uint32), kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(cuts)):
                mine = order[cuts[b] : cuts[b + 1]]
                gaps = np.diff(at[mine], prepend=0)
                rows.append((int(b), 0, name, None, None, short[mine].tobytes(), _pack(gaps)))
                if len(rows) >= 256:
                    yield _rows(_NAMES, rows, _TYPES)
                    rows = []
            yield _rows(_NAMES, rows, _TYPES)

    return run


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows that equal a block somewhere else; other rows pass."""
    names, hashes, places = [], [], []
    for batch in batches:
        kind = batch.column("kind").to_numpy()
        passed = batch.filter(pa.array(kind != 0))
        if passed.num_rows:
            yield passed
        looked = batch.filter(pa.array(kind == 0))
        names += looked.column("batch").to_pylist()
        hashes += [np.frombuffer(x, np.uint32) for x in looked.column("hashes").to_pylist()]
        places += [x for x in looked.column("places").to_pylist()]
    if not names:
        return
    sizes = [len(x) for x in hashes]
    h = np.concatenate(hashes)
    order = np.argsort(h, kind="stable")
    word, flag = h[order] >> np.uint32(1), (h[order] & np.uint32(1)).astype(np.int64)
    first = np.flatnonzero(np.diff(word, prepend=~word[:1]) != 0)
    count = np.diff(np.append(first, len(word)))
    good = (count > 1) & (np.add.reduceat(flag, first) > 0)
    hit = np.zeros(len(h), bool)
    hit[order[np.repeat(good, count)]] = True
    at, rows = 0, []
    for name, size, packed in zip(names, sizes, places, strict=True):
        mine = hit[at : at + size]
        at += size
        if mine.any():
            found = np.cumsum(_unpack(packed))[mine].astype(np.uint32)
            rows.append((0, 2, name, None, None, None, found.tobytes()))
        if len(rows) >= 256:
            yield _rows(_NAMES, rows, _TYPES)
            rows = []
    yield _rows(_NAMES, rows, _TYPES)


def _by_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hits of whole batches to hits of their texts, as places within the text."""
    texts, hits = {}, {}
    for batch in batches:
        for kind, name, ids, counts, places in zip(
            *(batch.column(c).to_pylist() for c in ("kind", "batch", "ids", "counts", "places")), strict=True
        ):
            if kind == 1:
                texts[name] = np.frombuffer(ids, np.int64).reshape(2, -1), np.frombuffer(counts, np.int64)
            else:
                hits.setdefault(name, []).append(np.frombuffer(places, np.uint32))
    for name, parts in hits.items():
        (ids, keys), lengths = texts[name]
        place = np.unique(np.concatenate(parts)).astype(np.int64)
        first = starts_of(lengths)
        text = np.searchsorted(first, place, side="right") - 1
        cuts = np.searchsorted(text, np.arange(len(ids) + 1))
        some = np.flatnonzero(np.diff(cuts))
        inside = (place - first[text]).astype(np.uint32)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids[some]),
                pa.array(keys[some]),
                pa.array([inside[cuts[i] : cuts[i + 1]].tobytes() for i in some], pa.binary()),
            ],
            names=["doc_id", "key", "hits"],
        )


def _around(hits: bytes, n: int, length: int, block: int) -> np.ndarray:
    """Starts of all windows of ``length`` words that contain a hit."""
    at = np.frombuffer(hits, np.uint32).astype(np.int64)
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, np.maximum(at - (length - block), 0), 1)
    np.add.at(steps, np.minimum(at, n - 1) + 1, -1)
    return np.flatnonzero(np.cumsum(steps)[: n - length + 1] > 0)


def _lookups(length: int, block: int, buckets: int):
    """Packed rows of the windows around hits: 128-bit hashes, the texts, places."""

    def run(batches):
        for batch in sized(batches, 3 << 20):
            flat, lengths = ascii_words(batch.column("text"))
            first = starts_of(lengths)
            hits = batch.column("hits").to_pylist()
            around = [
                _around(h, int(n), length, block) if n >= length else np.empty(0, np.int64)
                for h, n in zip(hits, lengths, strict=True)
            ]
            counts = np.array([len(a) for a in around])
            if not counts.sum():
                continue
            text = np.repeat(np.arange(len(around)), counts)
            inside = np.concatenate(around)
            at = inside + first[text]
            one = window_hashes(word_hashes(flat), length)[at]
            two = window_hashes(word_hashes(flat, 7), length, 7)[at]
            ids = batch.column("doc_id").to_numpy().astype(np.int64)
            keys = batch.column("key").to_numpy().astype(np.int64)
            own = hashlib.sha256(ids.tobytes() + keys.tobytes() + counts.tobytes()).digest()
            name = int.from_bytes(own[:8], "little", signed=True)
            bucket = (one >> np.uint64(40)) % np.uint64(buckets)
            order = np.argsort(bucket.astype(np.uint16 if buckets < 1 << 16 else np.uint32), kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            rows = []
            for b in np.flatnonzero(np.diff(cuts)):
                mine = order[cuts[b] : cuts[b + 1]]
                some, number = np.unique(text[mine], return_counts=True)
                lanes = np.stack([ids[some], keys[some]]).tobytes()
                both = np.stack([one[mine], two[mine]]).tobytes()
                gaps = np.diff(at[mine], prepend=0)
                begin = first[some]
                counted = np.concatenate([number, begin]).astype(np.uint32).tobytes()
                rows.append((int(b), 0, name, lanes, counted, both, _pack(gaps)))
                if len(rows) >= 256:
                    yield _rows(_NAMES, rows, _TYPES)
                    rows = []
            yield _rows(_NAMES, rows, _TYPES)

    return run


_GONE = "batch long, ids binary, counts binary, starts binary"


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every packed row, the windows that a document with a smaller id has too."""
    names, ids, lanes, one, two, place, text, row = [], [], [], [], [], [], [], []
    n_texts = 0
    for batch in batches:
        for name, own, counted, both, gaps in zip(
            *(batch.column(c).to_pylist() for c in ("batch", "ids", "counts", "hashes", "places")), strict=True
        ):
            own = np.frombuffer(own, np.int64).reshape(2, -1)
            number, begin = np.frombuffer(counted, np.uint32).astype(np.int64).reshape(2, -1)
            h = np.frombuffer(both, np.uint64).reshape(2, -1)
            row.append(np.full(len(number), len(names)))
            names.append(name)
            ids.append(own[0])
            lanes.append(own)
            one.append(h[0])
            two.append(h[1])
            place.append((np.cumsum(_unpack(gaps)) - np.repeat(begin, number)).astype(np.uint32))
            text.append(np.repeat(np.arange(n_texts, n_texts + len(number)), number))
            n_texts += len(number)
    if not names:
        return
    ids, one, two, place, text, row = (np.concatenate(x) for x in (ids, one, two, place, text, row))
    lanes = np.concatenate(lanes, axis=1)
    order = np.lexsort((two, one))
    a, b = one[order], two[order]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    least = np.minimum.reduceat(ids[text[order]], first)
    smallest = np.empty(len(one), np.int64)
    smallest[order] = np.repeat(least, np.diff(np.append(first, len(a))))
    gone = smallest < ids[text]
    text, place = text[gone], place[gone]
    counts = np.bincount(text, minlength=n_texts)
    cuts = np.searchsorted(row, np.arange(len(names) + 1))
    ends = starts_of(counts)
    for r, name in enumerate(names):
        some = np.flatnonzero(counts[cuts[r] : cuts[r + 1]]) + cuts[r]
        if len(some):
            found = place[ends[cuts[r]] : ends[cuts[r + 1]]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([name], pa.int64()),
                    pa.array([lanes[:, some].tobytes()], pa.binary()),
                    pa.array([counts[some].tobytes()], pa.binary()),
                    pa.array([found.tobytes()], pa.binary()),
                ],
                names=["batch", "ids", "counts", "starts"],
            )


def _per_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per text and batch from the rows of all ranges of hashes."""
    gathered: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
    for batch in batches:
        for name, own, counted, starts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            parts = np.frombuffer(own, np.int64).reshape(2, -1), np.frombuffer(counted, np.int64)
            gathered.setdefault(name, []).append((*parts, np.frombuffer(starts, np.uint32)))
    for parts in gathered.values():
        lanes = np.concatenate([p[0] for p in parts], axis=1)
        text, number = np.unique(lanes, axis=1, return_inverse=True)
        of = np.repeat(number, np.concatenate([p[1] for p in parts]))
        order = np.argsort(of, kind="stable")
        starts = np.concatenate([p[2] for p in parts])[order]
        cuts = np.searchsorted(of[order], np.arange(text.shape[1] + 1))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(text[0]),
                pa.array(text[1]),
                pa.array([starts[cuts[i] : cuts[i + 1]].tobytes() for i in range(text.shape[1])], pa.binary()),
            ],
            names=["doc_id", "key", "starts"],
        )


def _cut(length: int, keep: list[str]):
    def run(batches):
        for batch in sized(batches, 3 << 20):
            flat, lengths = ascii_words(batch.column("text"))
            first = starts_of(lengths)
            steps = np.zeros(len(flat) + 1, np.int64)
            for i, parts in enumerate(batch.column("starts").to_pylist()):
                for part in parts or ():
                    at = np.frombuffer(part, np.uint32).astype(np.int64) + first[i]
                    np.add.at(steps, at, 1)
                    np.add.at(steps, at + length, -1)
            left = np.cumsum(steps)[:-1] == 0
            text = np.repeat(np.arange(len(lengths)), lengths)
            kept = np.bincount(text[left], minlength=len(lengths))
            joined = pc.binary_join(as_lists(flat.filter(pa.array(left)), kept), " ")
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep]
                + [pa.array(lengths), pa.array(lengths - kept), joined.cast(pa.string())],
                names=[*keep, "n_words", "n_removed", "kept"],
            )

    return run


def remove_repeats(docs: DataFrame, keep: list[str] | None = None, length: int = LENGTH) -> DataFrame:
    """Add ``n_words``, ``n_removed`` and ``kept`` to the columns ``keep`` (default: doc_id).

    ``docs`` has doc_id and text. Words are runs without ASCII white space. A word goes if a
    window of ``length`` words that covers it also starts in a document with a smaller
    doc_id; windows are those of the input. ``kept`` joins the other words by one space.
    NULL and empty texts have no words. Rows with the same doc_id never remove each other's
    words. A row without a doc_id neither loses words nor makes others lose any. An empty
    table gives no rows. The index is built and probed before the result is returned.
    """
    keep = keep or ["doc_id"]
    block = length // 2
    spark = docs.sparkSession
    context = spark.sparkContext
    carried = [c for c in keep if c != "text"]
    named = docs.select(
        *carried,
        "text",
        F.col("doc_id").alias("_id"),
        F.xxhash64("text").alias("_key"),
    )
    known = docs.where("doc_id is not null").select("doc_id", "text", F.xxhash64("text").alias("key"))
    n_words = known.agg(F.sum(F.length("text") / 6)).first()[0] or 0
    parts = int(max(context.defaultParallelism, n_words // TASK_WINDOWS + 1))
    hot = context.broadcast(_frequent(known, block))
    probes = known.mapInArrow(_probes(block, parts, hot), _PACKED).repartition(parts, "bucket")
    matched = probes.mapInArrow(_match, _PACKED).repartition(parts, "batch")
    hits = materialize(matched.mapInArrow(_by_text, "doc_id long, key long, hits binary"), "hits")
    hits = hits.groupBy("doc_id", "key").agg(F.max("hits").alias("hits"))
    asked = known.join(hits, ["doc_id", "key"])
    looked = asked.mapInArrow(_lookups(length, block, parts), _PACKED).repartition(parts, "bucket")
    gone = looked.mapInArrow(_decide, _GONE).repartition(parts, "batch")
    gone = gone.mapInArrow(_per_text, "doc_id long, key long, starts binary")
    gone = gone.groupBy("doc_id", "key").agg(F.collect_list("starts").alias("starts"))
    gone = gone.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "starts")
    gone = materialize(gone, "repeats")
    joined = named.join(gone, ["_id", "_key"], "left").select(*carried, "text", "starts")
    schema = extended(docs, keep, "n_words long, n_removed long, kept string")
    return joined.mapInArrow(_cut(length, keep), schema)
