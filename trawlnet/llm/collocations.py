"""Phrases whose words occur together more often than the parts of the phrase would.

Method: weighted acyclic automata. Every word of a text begins a row of up to four words, which
ends early where a piece of text ends. A task counts the rows of a shard, puts them in order, and
builds a transducer from them: a minimal acyclic automaton over words that gives a row its
count. Transducers are cut at sampled prefixes; those of one prefix range are brought together
and united, and counts of equal rows are added up. A phrase stands before all rows that it begins,
so its count is the sum of the weights in its range. Parts of phrases are looked up by
composing them, as an acceptor, with the transducers of the frequent phrases.

The sampled prefixes reach three words deep. A word or pair that begins a third of all rows is
spread over many ranges; equal rows are one row per shard, however many there are.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trawlnet.llm.frames import sized
from trawlnet.llm.windows import mix, ranges, starts_of
from trawlnet.sources.scratch import materialize

WIDTH = 4  # words of the longest phrase
LEAST = 30
INSIDE = 80  # percent of its occurrences within a longer phrase that make a phrase a part of it
BEST = 2000
SHARD_BYTES = 3 << 20  # of texts that are counted together
RANGE_BYTES = 5 << 20  # of texts, about, whose rows meet in one prefix range
PICKED = 16  # sampled prefixes per range
CLIPPED = 48  # bytes of a word of a sampled prefix
SALTS = 16
NO_LANG = "und"

# What ends a piece of text, and what ends a word.
_ENDS, _BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
_CLASS = np.zeros(256, np.uint8)
_CLASS[list(_BLANKS)], _CLASS[list(_ENDS)] = 1, 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words of a batch, the text and the piece that each is in."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if not len(texts) or ends[-1] == ends[0]:
        return pa.array([], pa.string()), np.empty(0, np.int64), np.empty(0, np.int64)
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    kind = _CLASS[raw]
    inside = kind == 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    opened = np.zeros(len(raw), bool)
    opened[ends[:-1][np.diff(ends) > 0]] = True
    begins |= opened & inside
    start = np.flatnonzero(begins)
    place = np.append(start, len(raw))
    size = np.add.reduceat(inside, start, dtype=np.int64) if len(start) else np.empty(0, np.int64)
    piece = np.cumsum((kind == 2) | opened)[start]
    letters = pa.py_buffer(_LOWER[raw[inside]])
    words = pa.StringArray.from_buffers(len(start), pa.py_buffer(starts_of(size).astype(np.int32)), letters)
    return words, np.searchsorted(ends, place[:-1], side="right") - 1, piece


def coded(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct words in the order of their bytes, and the place of each word from 1 on."""
    found = words.dictionary_encode()
    order = pc.sort_indices(found.dictionary.cast(pa.binary())).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(1, len(order) + 1)
    return found.dictionary.take(pa.array(order)), place[found.indices.to_numpy()]


def rows_of(code: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """The row of words from each word on; 0 stands behind the end of a piece."""
    out = np.zeros((WIDTH, len(code)), np.int32)
    out[0] = code
    for k in range(1, min(WIDTH, len(code))):
        out[k, :-k] = np.where(piece[k:] == piece[:-k], code[k:], 0)
    return out


def counted(rows: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in order and how often they occur, or the sum of their weights."""
    if not rows.shape[1]:
        return rows, np.empty(0, np.int64)
    high = int(rows.max()) + 1
    first, second = (rows[k].astype(np.int64) * high + rows[k + 1] for k in (0, 2))
    order = np.lexsort((second, first))
    rows = rows[:, order]
    first = np.flatnonzero(np.concatenate([[True], (rows[:, 1:] != rows[:, :-1]).any(axis=0)]))
    if weights is None:
        return rows[:, first], np.diff(np.append(first, len(order)))
    return rows[:, first], np.add.reduceat(weights[order], first)


def _opens(rows: np.ndarray) -> list[np.ndarray]:
    """Per depth, where a prefix of so many words begins in rows in order."""
    changed, out = np.zeros(rows.shape[1], bool), []
    changed[:1] = True
    for column in rows:
        changed = changed.copy()
        changed[1:] |= column[1:] != column[:-1]
        out.append(changed)
    return out


def _shared(counts: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """States with the same arcs are one: the states that stay, and the new number of each."""
    first = starts_of(counts)
    state, place = np.repeat(np.arange(len(counts)), counts), ranges(counts)
    with np.errstate(over="ignore"):
        arc = place.astype(np.uint64)
        for column in columns:
            arc = mix(arc * np.uint64(0x9E3779B97F4A7C15) + column.astype(np.uint64) + np.uint64(1))
        key = np.add.reduceat(arc, first[:-1])
    _, stays, number = np.unique(key, return_index=True, return_inverse=True)
    alike = counts == counts[stays[number]]
    other = first[stays[number]][state] + place
    same = alike[state]
    for column in columns:
        same[same] = column[same] == column[other[same]]
    odd = np.unique(state[~same])  # the same key by chance
    number[odd] = len(stays) + np.arange(len(odd))
    return np.concatenate([stays, odd]), number


class Transducer:
    """A minimal acyclic automaton: rows of words to weights."""

    def __init__(self, labels: list[np.ndarray], counts: list[np.ndarray], targets: list[np.ndarray]):
        self.labels, self.counts, self.targets = labels, counts, targets  # the last targets are weights

    @classmethod
    def of(cls, rows: np.ndarray, weights: np.ndarray) -> Transducer:
        """From distinct rows in order."""
        opens = _opens(rows)
        labels, counts, targets = [], [], []
        target, at = weights, np.arange(rows.shape[1])  # one arc per row
        for depth in range(WIDTH - 1, 0, -1):
            label = rows[depth][at]
            begin = np.flatnonzero(opens[depth - 1][at])
            n = np.diff(np.append(begin, len(at)))
            stays, number = _shared(n, label, target)
            arcs = np.repeat(begin[stays], n[stays]) + ranges(n[stays])
            labels.append(label[arcs])
            targets.append(target[arcs])
            counts.append(n[stays])
            target, at = number, at[begin]
        labels.append(rows[0][at])
        targets.append(target)
        counts.append(np.array([len(at)]))
        return cls(labels[::-1], counts[::-1], targets[::-1])

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        """All rows in order, and their weights."""
        columns, state = [], np.zeros(1, np.int64)
        for label, count, target in zip(self.labels, self.counts, self.targets, strict=True):
            n = count[state]
            arcs = np.repeat(starts_of(count)[state], n) + ranges(n)
            columns = [np.repeat(c, n) for c in columns] + [label[arcs]]
            state = target[arcs]
        return np.array(columns), state

    def weights(self, rows: np.ndarray) -> np.ndarray:
        """Compose with rows: the weight of each, 0 for those that it does not have."""
        state, known = np.zeros(rows.shape[1], np.int64), np.ones(rows.shape[1], bool)
        for row, label, count, target in zip(rows, self.labels, self.counts, self.targets, strict=True):
            high = int(max(label.max(initial=0), row.max(initial=0))) + 1
            arcs = np.repeat(np.arange(len(count)), count) * high + label
            at = np.minimum(np.searchsorted(arcs, state * high + row), len(arcs) - 1)
            known &= arcs[at] == state * high + row
            state = np.where(known, target[at], 0)
        return np.where(known, state, 0)

    def to_bytes(self) -> bytes:
        arrays = [*self.labels, *self.counts, *self.targets]
        kinds = [np.min_scalar_type(int(a.max(initial=0))) for a in arrays]
        head = np.array([x for a, k in zip(arrays, kinds, strict=True) for x in (len(a), k.itemsize)], np.int64)
        return head.tobytes() + b"".join(a.astype(k).tobytes() for a, k in zip(arrays, kinds, strict=True))

    @classmethod
    def from_bytes(cls, data: bytes) -> Transducer:
        head = np.frombuffer(data, np.int64, 6 * WIDTH)
        at, arrays = head.nbytes, []
        for n, size in head.reshape(-1, 2).tolist():
            arrays.append(np.frombuffer(data, f"u{size}", n, at).astype(np.int64))
            at += n * size
        return cls(arrays[:WIDTH], arrays[WIDTH : 2 * WIDTH], arrays[2 * WIDTH :])


def _cuts(vocabulary: pa.Array, rows: np.ndarray, limits: list[tuple[bytes, ...]]) -> np.ndarray:
    """Where rows in order are cut by limits in order."""
    known = vocabulary.cast(pa.binary()).to_pylist()
    high = 2 * len(known) + 4
    wanted = np.zeros((WIDTH - 1, len(limits)), np.int64)
    for i, limit in enumerate(limits):
        for k, word in enumerate(limit):
            if word:
                at = bisect_left(known, word)
                exact = at < len(known) and known[at] == word
                wanted[k, i] = 2 * (at + 1) if exact else 2 * at + 1
    key = np.zeros(rows.shape[1], np.int64)
    want, at = np.zeros(len(limits), np.int64), np.zeros(len(limits), np.int64)
    open_ = np.ones(len(limits), bool)
    for k in range(WIDTH - 1):
        key = key * high + 2 * rows[k].astype(np.int64)
        key_want = want * high + wanted[k]
        found = np.searchsorted(key, key_want)
        at = np.where(open_, found, at)
        met = np.minimum(found, max(len(key) - 1, 0))
        open_ &= (key[met] == key_want) if len(key) else False
        node = np.cumsum(np.diff(key, prepend=key[:1]) != 0)  # the number of the prefix
        want = node[met] if len(key) else want
        key = node
    return at


def _packed(vocabulary: pa.Array, rows: np.ndarray, weights: np.ndarray) -> tuple[bytes, bytes]:
    used = np.unique(rows)
    used = used[used > 0]
    rows = np.where(rows > 0, np.searchsorted(used, rows) + 1, 0)
    words = "\n".join(vocabulary.take(pa.array(used - 1)).to_pylist()).encode()
    held = Transducer.of(rows, weights).to_bytes()
    return tuple(len(x).to_bytes(8, "little") + pa.compress(x, "zstd", asbytes=True) for x in (words, held))


def _unpacked(words: bytes, held: bytes) -> tuple[bytes, Transducer]:
    words, held = (pa.decompress(x[8:], int.from_bytes(x[:8], "little"), "zstd", asbytes=True) for x in (words, held))
    return words, Transducer.from_bytes(held)


def union(parts: list[tuple[bytes, Transducer]]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words in order, and the rows of all transducers in order with the sums of their weights.

    The words of a transducer are one string, a line each.
    """
    starts = starts_of(np.array([words.count(b"\n") + 1 for words, _ in parts]))
    lines = pc.split_pattern(pa.array([b"\n".join(words for words, _ in parts)], pa.binary()).cast(pa.large_string()), "\n")
    vocabulary, code = coded(lines.flatten().cast(pa.string()))
    rows, weights = [], []
    for begin, end, (_, held) in zip(starts, starts[1:], parts, strict=False):
        row, weight = held.rows()
        rows.append(np.concatenate([[0], code[begin:end]]).astype(np.int32)[row])
        weights.append(weight)
    return vocabulary, *counted(np.concatenate(rows, axis=1), np.concatenate(weights))


def phrases(vocabulary: pa.Array, rows: np.ndarray, weights: np.ndarray, least: int) -> pa.RecordBatch:
    """(phrase, size, n) of all prefixes that occur ``least`` times, and of those at either end.

    The prefixes at the ends may go on in other ranges. The empty one counts all rows.
    """
    texts, sizes, sums = [pa.array([""])], [np.zeros(1, np.int64)], [weights.sum(keepdims=True)]
    for depth, opens in enumerate(_opens(rows)):
        first = np.flatnonzero(opens)
        n = np.add.reduceat(weights, first)
        kept = (n >= least) & (rows[depth, first] > 0)
        kept[[0, -1]] = rows[depth, first[[0, -1]]] > 0
        at = first[kept]
        words = [vocabulary.take(pa.array(rows[k, at] - 1)).cast(pa.string()) for k in range(depth + 1)]
        texts.append(pc.binary_join_element_wise(*words, " ") if depth else words[0])
        sizes.append(np.full(len(at), depth + 1))
        sums.append(n[kept])
    return pa.RecordBatch.from_arrays(
        [pa.concat_arrays(texts), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(sums))], names=["phrase", "size", "n"]
    )


class Limits:
    """Prefixes in order that cut all rows into ranges; a range is the number of limits before it."""

    def __init__(self, picked: list[tuple[bytes, ...]], parts: int):
        picked = sorted(picked)
        step = max(1, len(picked) // parts)
        self.all = sorted(set(picked[step::step]))

    def of(self, lang: str) -> tuple[int, list[tuple[bytes, ...]]]:
        """The range that a language begins in, and the limits inside it."""
        name = lang.encode()
        begin, end = bisect_left(self.all, (name,)), bisect_left(self.all, (name + b"\0",))
        return begin, [x[1:] for x in self.all[begin:end]]


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.Array]]:
    lang = pc.fill_null(batch.column("lang"), NO_LANG)
    for name in pc.unique(lang).to_pylist():
        yield name, batch.column("text").filter(pc.equal(lang, name))


def _pick(docs: DataFrame, parts: int, total: int) -> Limits:
    """Sampled prefixes; they say only which rows meet where."""
    every = max(1, total // 8 // (parts * PICKED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized(batches, SHARD_BYTES):
            for lang, texts in _by_lang(batch):
                words, _, piece = words_of(texts)
                at = np.arange(0, len(words), every)
                columns = [words.take(pa.array(at))]
                for k in range(1, WIDTH - 1):
                    there = np.minimum(at + k, max(len(words) - 1, 0))
                    columns.append(pc.if_else(pa.array((piece[there] == piece[at]) & (there == at + k)), words.take(pa.array(there)), ""))
                columns = [pc.binary_slice(c.cast(pa.binary()), 0, CLIPPED) for c in columns]
                yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(at)), *columns], names=["lang", "a", "b", "c"])

    rows = docs.mapInArrow(run, "lang string, a binary, b binary, c binary").toArrow()
    names = [x.encode() for x in rows.column("lang").to_pylist()]
    return Limits(list(zip(names, *(rows.column(c).to_pylist() for c in "abc"), strict=True)), parts)


def frequent_phrases(docs: DataFrame, least: int = LEAST, range_bytes: int = RANGE_BYTES) -> tuple[DataFrame, Limits]:
    """(lang, phrase, size, n) of all phrases that occur ``least`` times, and the ranges they are in.

    A row of size 0 per language counts all words. ``docs`` has lang and text. Written to the
    shared folder.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = max(spark.sparkContext.defaultParallelism, -(-total // range_bytes))
    limits = _pick(docs, parts, total)
    shared = spark.sparkContext.broadcast(limits)

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized(batches, SHARD_BYTES):
            for lang, texts in _by_lang(batch):
                words, _, piece = words_of(texts)
                if not len(words):
                    continue
                vocabulary, code = coded(words)
                rows, weights = counted(rows_of(code, piece))
                begin, inside = shared.value.of(lang)
                cuts = [0, *_cuts(vocabulary, rows, inside).tolist(), rows.shape[1]]
                found = [
                    (begin + i, *_packed(vocabulary, rows[:, a:b], weights[a:b]))
                    for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))
                    if b > a
                ]
                columns = [pa.array(c, k) for c, k in zip(zip(*found, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays([columns[0], pa.repeat(lang, len(found)), *columns[1:]], names=["range", "lang", "words", "held"])

    def unite(group: pa.Table) -> pa.Table:
        lang, out = group.column("lang"), []
        for name in pc.unique(lang).to_pylist():
            mine = group.filter(pc.equal(lang, name))
            parts = [_unpacked(*x) for x in zip(mine.column("words").to_pylist(), mine.column("held").to_pylist(), strict=True)]
            found = phrases(*union(parts), least)
            out.append(pa.table([pa.repeat(name, found.num_rows), *found.columns], names=["lang", *found.schema.names]))
        return pa.concat_tables(out)

    pieces = docs.mapInArrow(shard, "range int, lang string, words binary, held binary")
    sums = pieces.groupBy("range").applyInArrow(unite, "lang string, phrase string, size long, n long")
    whole = sums.groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n"))
    return materialize(whole.where((F.col("n") >= least) | (F.col("size") == 0)), "phrases"), limits


def _routed(rows: DataFrame, limits: Limits, schema: str) -> DataFrame:
    """Add the range of each ``phrase``."""
    shared = rows.sparkSession.sparkContext.broadcast(limits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            names = zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist(), strict=True)
            for lang, phrase in names:
                words = phrase.encode().split(b" ")
                row = (lang.encode(), *[*words, b"", b""][: WIDTH - 1])
                found.append(bisect_right(shared.value.all, row))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), *batch.columns], names=["range", *batch.schema.names])

    return rows.mapInArrow(run, schema)


def look_up(parts: DataFrame, known: DataFrame, limits: Limits) -> DataFrame:
    """(lang, phrase, n) of the distinct (lang, phrase) of ``parts``, 0 for unknown ones."""
    asked = _routed(parts.select("lang", "phrase").distinct(), limits, "range int, lang string, phrase string")
    held = _routed(known.where("size > 0").select("lang", "phrase", "n"), limits, "range int, lang string, phrase string, n long")
    asked = asked.withColumnRenamed("range", "place")

    def rows(table: pa.Table, code: np.ndarray) -> np.ndarray:
        out = np.zeros((WIDTH, table.num_rows), np.int64)
        lengths = [p.count(" ") + 1 for p in table.column("phrase").to_pylist()]
        row, place = np.repeat(np.arange(len(lengths)), lengths), ranges(np.array(lengths, np.int64))
        out[place, row] = code[: len(row)]
        return out

    def compose(one: pa.Table, other: pa.Table) -> pa.Table:
        out = [pa.table([pa.array([], pa.string()), pa.array([], pa.string()), pa.array([], pa.int64())], names=["lang", "phrase", "n"])]
        for name in pc.unique(one.column("lang")).to_pylist():
            mine, theirs = (t.filter(pc.equal(t.column("lang"), name)) for t in (one, other))
            words = [w for t in (mine, theirs) for p in t.column("phrase").to_pylist() for w in p.split(" ")]
            _, code = coded(pa.array(words, pa.string()))
            wanted = rows(mine, code)
            given = rows(theirs, code[int((wanted > 0).sum()) :])
            if theirs.num_rows:
                transducer = Transducer.of(*counted(given, theirs.column("n").to_numpy()))
                n = transducer.weights(wanted)
            else:
                n = np.zeros(mine.num_rows, np.int64)
            out.append(pa.table([mine.column("lang"), mine.column("phrase"), pa.array(n)], names=["lang", "phrase", "n"]))
        return pa.concat_tables(out)

    return asked.groupBy("place").cogroup(held.groupBy("range")).applyInArrow(compose, "lang string, phrase string, n long")


def collocations(docs: DataFrame, least: int = LEAST, inside: int = INSIDE, best: int = BEST, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The ``best`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    ``docs`` has text and lang. A-Z are lower-cased; texts are split into pieces, and pieces at blanks
    and tabs into words. ``n`` counts all words of the language and ``a`` the occurrences of the
    phrase within pieces. A phrase of two to four words that occurs ``least`` times is scored at the cut
    with the lowest floor(2000000 * a / (l + r)), where l and r count its two parts; of equal
    cuts the first one counts. Phrases that stand within a longer one in ``inside`` percent of their
    occurrences are left out. Ties of score go to the larger ``a``, then to the phrase whose
    bytes come first. NULL texts are empty, a NULL lang is ``und``; repeated rows count again,
    other columns are ignored, and a table without phrases gives no rows. Counting runs
    before the result is returned.
    """
    docs = docs.select(F.coalesce("lang", F.lit(NO_LANG)).alias("lang"), "text")
    known, limits = frequent_phrases(docs, least, range_bytes)
    candidates = known.where("size >= 2").select("lang", "phrase", "size", F.col("n").alias("a"))
    words = F.split("phrase", " ", -1)
    cut = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cut = cut.select(
        "lang", "phrase", "a", "k",
        F.array_join(F.slice(words, F.lit(1), F.col("k").cast("int")), " ").alias("first"),
        F.array_join(F.slice(words, F.col("k").cast("int") + 1, F.col("size").cast("int")), " ").alias("rest"),
    )
    asked = cut.select("lang", F.explode(F.array("first", "rest")).alias("phrase"))
    answers = materialize(look_up(asked, known, limits), "parts")
    left = answers.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l"))
    right = answers.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
    wide = "CAST(a AS DECIMAL(20, 0)) * 2000000 DIV (CAST(l AS DECIMAL(20, 0)) + r)"
    scored = cut.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).withColumn("score", F.expr(wide))
    lowest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # phrases inside longer ones, each with the most frequent of these
    longer = candidates.where("size > 2").withColumn("m", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
    longer = longer.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)))
    part = F.array_join(F.slice(words, F.col("at").cast("int"), F.col("m").cast("int")), " ")
    around = longer.groupBy("lang", part.alias("phrase")).agg(F.max("a").alias("most"))
    kept = lowest.join(around, ["lang", "phrase"], "left")
    kept = kept.where(F.col("most").isNull() | (F.col("most") * 100 < F.col("a") * inside))
    kept = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = kept.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    part = F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))
    salted = salted.withColumn("rank", part).where(F.col("rank") <= best)
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    ranked = ranked.where(F.col("rank") <= best).withColumn("rank", F.col("rank").cast("long"))
    totals = known.where("size = 0").select("lang", F.col("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
