"""Near-duplicate classes: documents linked by the Jaccard similarity of word shingles.

Method: a T-occurrence search. Every set has to share ``T = ceil(t * size)`` shingles with a
partner, so some of its first ``size - T + 1`` shingles, in an order that all sets share, are
shared too: only these are indexed. Following DivideSkip, the longest inverted lists come
last in that order, so that lists of short and middle length are merged and counted, and long
ones are probed: pairs whose count can still reach the required overlap are looked up in each
other's whole sets by binary search. Before a pair leaves its list, the parity bitmaps of both sets
bound how many shingles they can share.

Groups of copies are not expanded into all pairs. Equal sets are one class; classes that
agree in a minimal shingle are compared with the first of them, then each class with the one in
its lists whose bitmap is closest, and what that proves to be connected is not compared again. No other pair is
left out, so components are exact.

Sets hold 64-bit hashes of shingles. Two different sets with the same 64-bit signature are
recognised by a second signature, and then everything starts anew under another seed.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawlnet.llm.components import components
from trawlnet.llm.frames import sized
from trawlnet.llm.windows import ascii_words, mix, starts_of, window_hashes, word_hashes
from trawlnet.operators.joins import bounded
from trawlnet.sources.scratch import materialize

PIECE = 1 << 20  # bytes of a batch that are looked at together; words and hashes take some 20 times as much
ORDER_SHARE = 0.05  # of the documents, whose shingles tell which lists are long; order only
LONG_LIST = 2  # documents of that sample that make a list long
MOST_LONG = 1 << 21  # long lists known to every task, the longest ones
TASK_POSTINGS = 1 << 19  # index entries of one task
TASK_ENTRIES = 1 << 18  # entries of shared lists, each with its bitmap, that one task merges
SEEN_PAIRS = 1 << 16  # pairs whose bitmaps a task compares at a time
MOST_PAIRS = 1 << 18  # pairs counted at a time in one task
BITS = 512  # of the parity bitmap of a set
NEAREST_ROUNDS = 2  # in which a set is compared with the closest one of another cluster only
_NOBODY = np.int64((1 << 63) - 1)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def least_overlap(size: int, percent: int) -> int:
    """Shingles that a set of ``size`` must share with any partner."""
    return -(-size * percent // 100)


def shingle_sets(texts: pa.Array, k: int, seed: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; of the whole text if it has fewer words."""
    flat, lengths = ascii_words(texts, lower=True)
    words = word_hashes(flat, seed)
    hashed = window_hashes(words, k, seed)
    for start, n in zip(starts_of(lengths)[:-1], lengths, strict=True):
        if n >= k:
            yield np.unique(hashed[start : start + n - k + 1])
        else:
            yield window_hashes(words[start : start + n], int(n), seed + 1000 * int(n)) if n else words[:0]


class _Signer:
    """Two 64-bit signatures of a sorted set."""

    def __init__(self, seed: int):
        self.seed, self.powers = seed, None

    def __call__(self, x: np.ndarray) -> tuple[int, int]:
        with np.errstate(over="ignore"):
            if self.powers is None or len(self.powers[0]) < len(x):
                n = np.arange(1, 2 * len(x) + 2, dtype=np.uint64) + np.uint64(self.seed << 40)
                self.powers = mix(n * _ODD[0]) | np.uint64(1), mix(n * _ODD[1]) | np.uint64(1)
            both = [(x * p[: len(x)]).sum(dtype=np.uint64) for p in self.powers]
            both = mix(np.array(both, np.uint64) + np.uint64(len(x))).view(np.int64)
        return int(both[0]), int(both[1])


def _parity(x: np.ndarray) -> bytes:
    """A bit per hash class of shingles: whether the set has an odd number of them.

    Two bitmaps differ in no more bits than the sets have different shingles.
    """
    return np.packbits(np.bincount((x >> np.uint64(20)).astype(np.int64) % BITS, minlength=BITS) & 1).tobytes()


def _long_lists(docs: DataFrame, k: int, seed: int) -> np.ndarray:
    """Shingles of some tens of documents or more, by a sample."""
    chosen = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(ORDER_SHARE * 1_000_000)

    def run(batches):
        for batch in sized(batches, PIECE):
            sets = list(shingle_sets(batch.column("text"), k, seed))
            h, n = np.unique(np.concatenate(sets), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    counted = docs.where(chosen).select("text").mapInArrow(run, "h long, n long")
    frequent = counted.groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= LONG_LIST)
    found = frequent.orderBy(F.desc("n"), "h").limit(MOST_LONG).select("h").toArrow()
    return np.sort(found.column("h").to_numpy().view(np.uint64))


def _described(docs: DataFrame, k: int, percent: int, seed: int) -> DataFrame:
    """One row per document: size, signatures, minimal shingles, and the prefix to index."""
    inside = docs.sparkSession.sparkContext.broadcast(_long_lists(docs, k, seed))

    def run(batches):
        signer, long = _Signer(seed), inside.value
        for batch in sized(batches, PIECE):
            rows = [[], [], [], [], [], []]
            for x in shingle_sets(batch.column("text"), k, seed):
                n = len(x)
                if not n:
                    for column, value in zip(rows, (0, None, None, None, None, None), strict=True):
                        column.append(value)
                    continue
                at = np.minimum(np.searchsorted(long, x), max(len(long) - 1, 0))
                is_long = long[at] == x if len(long) else np.zeros(n, bool)
                prefix = np.concatenate([x[~is_long], x[is_long]])[: n - least_overlap(n, percent) + 1]
                with np.errstate(over="ignore"):
                    least = np.array([x[0], x[-1], (x * _ODD[1]).min(), (x * _ODD[2]).min()])
                for column, value in zip(rows, (n, *signer(x), least.view(np.int64), prefix.tobytes(), _parity(x)), strict=True):
                    column.append(value)
            kinds = pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary()
            kept = batch.select(["doc_id", "key"]).columns
            yield pa.RecordBatch.from_arrays(
                [*kept, *(pa.array(c, t) for c, t in zip(rows, kinds, strict=True))],
                names=["doc_id", "key", "n", "sig", "other", "least", "prefix", "bits"],
            )

    schema = "doc_id long, key long, n long, sig long, other long, least array<long>, prefix binary, bits binary"
    return docs.select("doc_id", F.xxhash64("text").alias("key"), "text").mapInArrow(run, schema)


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, k: int, percent: int, seed: int) -> DataFrame:
    """The pairs (a, b) of classes whose whole sets are similar enough."""
    needed = pairs.select(F.col("a").alias("sig")).union(pairs.select("b")).distinct()
    firsts = materialize(classes.join(needed, "sig").select("doc_id", "sig"), "needed")
    texts = docs.select("doc_id", "text").join(bounded(firsts, 1_000_000), "doc_id")

    def sets(batches):
        signer = _Signer(seed)
        for batch in sized(batches, PIECE):
            found = list(shingle_sets(batch.column("text"), k, seed))
            own = [signer(x)[0] for x in found]  # another row may have the same doc_id
            same = [s == t for s, t in zip(own, batch.column("sig").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([s for s, ok in zip(own, same, strict=True) if ok], pa.int64()),
                    pa.array([x.tobytes() for x, ok in zip(found, same, strict=True) if ok], pa.binary()),
                ],
                names=["sig", "members"],
            )

    table = texts.mapInArrow(sets, "sig long, members binary").dropDuplicates(["sig"])
    left = table.select(F.col("sig").alias("a"), F.col("members").alias("x"))
    right = table.select(F.col("sig").alias("b"), F.col("members").alias("y"))

    def probe(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                both = int((large[at] == small).sum())
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            kept = batch.filter(pa.array(good, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column("a"), kept.column("b")], names=["a", "b"])

    return pairs.join(right, "b").join(left, "a").mapInArrow(probe, "a long, b long")


def _gathered(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    rows = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(rows).combine_chunks() if rows else None


def _shared_lists(batches):
    """Index entries whose shingle occurs in more than one class."""
    table = _gathered(batches)
    if table is None:
        return
    h = table.column("h").to_numpy()
    order = np.argsort(h, kind="stable")
    h = h[order]
    same = h[1:] == h[:-1]
    kept = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
    yield from table.take(pa.array(kept)).to_batches(max_chunksize=1 << 16)


def _merge_lists(percent: int, nearest: bool):
    """Count how often two classes of different clusters meet in the lists of a task.

    ``nearest``: instead, for each class that it meets any in, the one of the closest bitmap.
    """

    def counted(parts: list[np.ndarray], sig, size, place):
        left, right = np.concatenate(parts[::2]), np.concatenate(parts[1::2])
        a, b = np.where(sig[left] < sig[right], (left, right), (right, left))
        order = np.lexsort((sig[b], sig[a]))
        a, b = a[order], b[order]
        first = np.flatnonzero((np.diff(sig[a], prepend=0) != 0) | (np.diff(sig[b], prepend=0) != 0))
        if len(a) and (not len(first) or first[0] != 0):
            first = np.concatenate([[0], first])
        columns = [sig[a[first]], sig[b[first]], size[a[first]], size[b[first]]]
        columns += [np.diff(np.append(first, len(a)))]
        columns += [np.maximum.reduceat(place[x], first) for x in (a, b)]
        return _sliced(columns, ["a", "b", "size_a", "size_b", "times", "last_a", "last_b"])

    def closest(best: np.ndarray, sig):
        """The pair of each class over all lists of the task."""
        one = np.flatnonzero(best < _NOBODY)
        differ, other = best[one] >> 32, best[one] & 0xFFFFFFFF
        order = np.lexsort((sig[other], differ, sig[one]))
        one, other, differ = one[order], other[order], differ[order]
        first = np.concatenate([[True], sig[one[1:]] != sig[one[:-1]]])[: len(one)]
        one, other, differ = one[first], other[first], differ[first]
        return _sliced([sig[one], sig[other], differ], ["one", "other", "differ"])

    def run(batches):
        table = _gathered(batches)
        if table is None:
            return
        h, sig, cluster, packed = (table.column(c).to_numpy() for c in ("h", "sig", "cluster", "packed"))
        order = np.lexsort((sig, packed >> 32, h))
        order = order[_mixed(h[order], cluster[order])]
        if not len(order):
            return
        h, sig, cluster, packed = (x[order] for x in (h, sig, cluster, packed))
        size, place = packed >> 32, packed & 0xFFFFFFFF
        bits = _fixed(table.column("bits"), BITS // 64)[order]
        del table, packed, order
        # partners of an entry: later ones of its list that are at most so much larger
        reach = np.minimum(np.searchsorted(h, h, side="right"), _last_fitting(h, size, percent))
        index = np.arange(len(h))
        counts = reach - index - 1
        total = np.cumsum(counts)
        best = np.full(len(h) if nearest else 0, _NOBODY)
        parts, held = [], 0
        i = 0
        while i < len(h):
            before = total[i] - counts[i]
            j = max(i + 1, int(np.searchsorted(total, before + SEEN_PAIRS)))
            left = np.repeat(index[i:j], counts[i:j])
            right = left + 1 + np.arange(len(left)) - np.repeat(total[i:j] - counts[i:j] - before, counts[i:j])
            apart = cluster[left] != cluster[right]
            left, right = left[apart], right[apart]
            differ = np.bitwise_count(bits[left] ^ bits[right]).sum(axis=1, dtype=np.int64)
            both = size[left] + size[right]
            can = (both - differ) // 2 * (100 + percent) >= both * percent
            left, right = left[can], right[can]
            if nearest:
                np.minimum.at(best, left, differ[can] << 32 | right)
                np.minimum.at(best, right, differ[can] << 32 | left)
            else:
                parts += [left, right]
                held += len(left)
            if held >= MOST_PAIRS:
                yield from counted(parts, sig, size, place)
                parts, held = [], 0
            i = j
        if held:
            yield from counted(parts, sig, size, place)
        if nearest:
            yield from closest(best, sig)

    return run


def _fixed(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Values of a binary column, all of ``width`` 64-bit words, as rows of a matrix without a copy."""
    rows = [c for c in column.chunks if len(c)]
    parts = [np.frombuffer(c.buffers()[2], np.uint64, len(c) * width, c.offset * width * 8) for c in rows]
    flat = parts[0] if len(parts) == 1 else np.concatenate(parts)
    return flat.reshape(-1, width)


def _sliced(columns: list[np.ndarray], names: list[str]) -> Iterator[pa.RecordBatch]:
    batch = pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=names)
    return (batch.slice(at, 1 << 16) for at in range(0, batch.num_rows, 1 << 16))


def _mixed(h: np.ndarray, cluster: np.ndarray) -> np.ndarray:
    """Entries of lists, one list after the other, that hold more than one cluster."""
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    low, high = np.minimum.reduceat(cluster, first), np.maximum.reduceat(cluster, first)
    return np.repeat(low != high, np.diff(np.append(first, len(h))))


def _last_fitting(h: np.ndarray, size: np.ndarray, percent: int) -> np.ndarray:
    """Per entry, sorted by (h, size): where entries of its list become too large for it."""
    list_no = np.cumsum(np.diff(h, prepend=h[:1]) != 0)
    key = list_no * (int(size.max()) + 2) + size
    most = np.minimum(size * 100 // percent, int(size.max()) + 1)
    return np.searchsorted(key, list_no * (int(size.max()) + 2) + most, side="right")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, key) of every row of ``docs`` (doc_id, text).

    ``key`` is a hash of the text, which tells rows with the same doc_id, or with none, apart.
    Words are runs without ASCII white space, A-Z lower-cased. Two documents link when their
    shingle sets have a Jaccard similarity of at least ``percent`` / 100; ``component_id`` is
    the smallest doc_id that links reach. Texts without words have no shingles and stay
    alone. Repeated rows are classified alike; a NULL doc_id belongs to the class of its text
    but is never its smallest. Other columns are ignored. An empty table gives no rows. The
    searches run before the result is returned.
    """
    docs = docs.select("doc_id", "text")
    for seed in itertools.count():
        described = materialize(_described(docs, k, percent, seed), "shingles")
        known = described.where("n > 0 and doc_id is not null")
        classes = known.groupBy("sig").agg(
            F.min("doc_id").alias("doc_id"),
            F.max("n").alias("n"),
            F.max("least").alias("least"),
            F.max("bits").alias("bits"),
            (F.min("other") != F.max("other")).alias("clash"),
        )
        classes = materialize(classes, "classes")
        if not classes.where("clash").limit(1).count():
            break
    # classes that share a minimal shingle, each against the first of them
    least = classes.select("sig", "n", F.posexplode("least").alias("band", "h"))
    first = least.groupBy("band", "h").agg(F.min(F.struct("sig", "n")).alias("f"), F.count(F.lit(1)).alias("m"))
    fits = F.least("n", "f.n") * 100 >= F.greatest("n", "f.n") * percent
    star = least.join(first.where("m > 1"), ["band", "h"]).where(fits & (F.col("f.sig") < F.col("sig")))
    star = materialize(star.select(F.col("f.sig").alias("a"), F.col("sig").alias("b")).distinct(), "pairs")
    proved = materialize(_verified(docs, classes, star, k, percent, seed), "links")
    cluster = components(proved)
    # the index: one row per class and shingle of its prefix
    entries = described.select("doc_id", "sig", "n", "prefix").join(
        classes.select("doc_id", "sig"), ["doc_id", "sig"]
    )
    total = described.agg(F.sum(F.length("prefix")).alias("bytes")).first()["bytes"] or 0
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, total // 8 // TASK_POSTINGS + 1)

    def explode(batches):
        for batch in sized(batches, PIECE):
            counts = np.array([len(p.as_buffer()) // 8 for p in batch.column("prefix")], np.int64)
            if not counts.sum():
                continue
            h = np.frombuffer(b"".join(batch.column("prefix").to_pylist()), np.int64)
            place = np.arange(len(h)) - np.repeat(np.cumsum(counts) - counts, counts)
            size = np.repeat(batch.column("n").to_numpy(), counts)
            sig = np.repeat(batch.column("sig").to_numpy(), counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h), pa.array(sig), pa.array(size << 32 | place)], names=["h", "sig", "packed"]
            )

    entry = "h long, sig long, packed long"
    index = entries.select("sig", "n", "prefix").mapInArrow(explode, entry).repartition(parts, "h")
    lists = materialize(index.mapInArrow(_shared_lists, entry), "lists")
    # a pair leaves every task in whose lists it meets: no more tasks than the shared lists fill
    merging = max(docs.sparkSession.sparkContext.defaultParallelism, lists.count() // TASK_ENTRIES + 1)

    def merged(nearest: bool, schema: str) -> DataFrame:
        known = classes.select("sig", "bits").join(cluster.withColumnRenamed("id", "sig"), "sig", "left")
        named = lists.join(known, "sig").select(
            "h", "sig", "packed", F.coalesce("component", "sig").alias("cluster"), "bits"
        )
        return named.repartition(merging, "h").mapInArrow(_merge_lists(percent, nearest), schema)

    # every class and the one of another cluster that is closest by its bitmap: if any links to it,
    # that one most likely does. This joins the clusters of copies, and pairs inside one need no look
    for _ in range(NEAREST_ROUNDS):
        ends = merged(True, "one long, other long, differ long")
        best = ends.groupBy("one").agg(F.min(F.struct("differ", "other")).alias("best"))
        best = best.select(F.least("one", "best.other").alias("a"), F.greatest("one", "best.other").alias("b"))
        best = materialize(best.distinct(), "best")
        proved = proved.unionAll(materialize(_verified(docs, classes, best, k, percent, seed), "links"))
        cluster = components(proved)
    met = merged(False, "a long, b long, size_a long, size_b long, times long, last_a long, last_b long")
    met = met.groupBy("a", "b", "size_a", "size_b").agg(
        F.sum("times").alias("times"), F.max("last_a").alias("last_a"), F.max("last_b").alias("last_b")
    )
    rest = F.least(F.expr("size_a - 1 - last_a"), F.expr("size_b - 1 - last_b"))
    both = F.expr("size_a + size_b")
    can = (F.col("times") + rest) * (100 + percent) >= both * percent
    pairs = materialize(met.where(can).select("a", "b"), "pairs")
    found = materialize(_verified(docs, classes, pairs, k, percent, seed), "links")
    group = components(proved.unionAll(found))
    rooted = classes.join(group.withColumnRenamed("id", "sig"), "sig", "left").select(
        "sig", "doc_id", F.coalesce("component", "sig").alias("root")
    )
    smallest = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    answer = materialize(rooted.join(smallest, "root").select("sig", "component_id"), "components")
    worded = described.where("n > 0").select("doc_id", "n", "sig", "key").join(answer, "sig", "left")
    alone = described.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"), "key")
    return (
        worded.select("doc_id", "n", "component_id", "key")
        .unionAll(alone)
        .withColumnRenamed("n", "n_shingles")
    )
