"""Toxicity by the nearest labelled examples.

Method: texts are TF-IDF vectors over all terms of the examples; the examples nearest by cosine
are found exactly in an inverted index behind bounds. Neighbours vote with their similarity,
and votes of all labelled texts, of the examples with themselves left out, calibrate the vote.

The few heavy terms of a text go first: what an example can have beside them is at most the product of both
lengths in the other terms. Where that leaves few examples these are compared in full and no slice of the index is
unpacked. All other texts go through the slices, in each of which lists of few postings go first in the same way; only texts that
these leave many examples there take all lists and the rows of frequent terms. Examples of like texts stand together.

Terms are words and first letters of longer words, so that compounds of a word are known. Terms
that tell bad texts from others have their whole weight and all others a faint one, so that these
decide where nothing else does. Document frequencies and shares of bad texts are counted by Spark
over all rows; the index holds a bounded sample of the labelled examples. Workers get it packed, keep the
terms of each example and unpack the lists of one slice of the examples at a time.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawlnet.functions.batches import split_words
from trawlnet.llm.frames import sized
from trawlnet.llm.langid import _letters
from trawlnet.llm.windows import mix, ranges, starts_of
from trawlnet.operators.joins import bounded
from trawlnet.sources.scratch import materialize

EXAMPLES = 20_000  # labelled examples with a term that the index holds
LEAST_DOCS = 4  # labelled texts that a telling term must occur in
PREFIXES = (3, 4, 5, 6, 7, 8)  # so many first letters are terms of their own
LEAST_ODDS = 3.0  # times the odds of all texts that texts with a telling term are bad
FAINT = 0.02  # weight of other terms
HEAVY = 1.0  # weight of a term from which on it goes first; telling terms have it
FEW = 4, 16, 64  # postings of a term in a slice up to which it goes second, third and so on
SHARE = 0.06  # of the examples of a slice that have a term from which on a row is cheaper than a list
NEIGHBOURS = 15
BLOCK = 64  # examples that a term of a row of the matrix has at least
SLICE = 4096  # examples whose index a worker holds at a time
PLAIN = 0.9  # length in the other terms above which examples are ordered by likeness
COMMON = 1024  # most frequent terms, which tell which texts are alike
SKETCH = 32  # numbers that stand for them
DEPTH = 4  # times that a group of examples is cut in two
HELD = 1 << 23  # terms of texts that a task takes from one slice to the next
ROWS = 2048  # most frequent terms, whose weights are rows of a matrix
MARGIN = 2.5e-4  # more than 32-bit products of that many rows can be wrong by
PART = 50_000  # terms that make up as many ranges of terms, each with about as many postings, which one task packs
CHUNK = 128  # texts multiplied with them at once
MANY = 200  # examples up to which those that the heavy terms leave are compared at once
LEFT = 100  # examples of a slice that are compared one by one rather than through the whole index
SEEN = 1 << 15  # texts whose votes a task remembers
BINS = 20  # of the vote, for calibration
PRIOR = 0.5  # weight of the base rate in a vote, as a similarity
THRESHOLD = 0.3


def _encoded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Index of the distinct word at each place, words per text; (word, term) of the distinct words.

    The terms of a word: its letters, lower-cased, and its first ``PREFIXES`` letters if it has more.
    """
    flat, lengths = split_words(pc.utf8_lower(pc.fill_null(texts.cast(pa.string()), "")))
    coded = flat.dictionary_encode()
    distinct, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
    if not len(distinct):
        return codes, lengths, np.empty(0, np.int64), np.empty(0, np.int64)
    one = pa.ListArray.from_arrays(pa.array([0, len(distinct)], pa.int32()), distinct)
    joined = pc.binary_join(one, "\n")[0].as_py() + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    points = points[(points == 10) | _letters()[points]]
    sizes = np.diff(np.flatnonzero(points == 10), prepend=-1) - 1
    letters = points[points != 10].astype(np.uint64)
    first, every = starts_of(sizes)[:-1], np.arange(len(sizes))
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(sizes.max()) + 1, 0x9E3779B97F4A7C15, np.uint64))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(letters * powers[ranges(sizes)], dtype=np.uint64)])
        said = np.flatnonzero(sizes > 0)
        word, term = [said], [mix(sums[(first + sizes)[said]] - sums[first[said]])]
        for n in PREFIXES:
            longer = every[sizes > n]
            word.append(longer)
            term.append(mix(sums[first[longer] + n] - sums[first[longer]] + np.uint64(n)))
    return codes, lengths, np.concatenate(word), np.concatenate(term).view(np.int64)


def _terms(
    texts: pa.Array, known: np.ndarray | None = None, numbers: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, count) of the terms of each text, in order; of ``known`` (sorted) ones as their index or number."""
    codes, lengths, word, term = _encoded(texts)
    if known is None:
        names, number = np.unique(term, return_inverse=True)
    elif len(known):
        order = np.argsort(term)  # in order each search is near the one before
        number = np.empty(len(term), np.int64)
        number[order] = np.searchsorted(known, term[order])
        number = np.minimum(number, len(known) - 1)
        good = known[number] == term
        names, word, number = None, word[good], number[good]
        number = number if numbers is None else numbers[number]
    else:
        return (np.empty(0, np.int64),) * 3
    # the terms of each distinct word stand together
    order = np.argsort(word, kind="stable")
    number = number[order]
    of_word = np.bincount(word, minlength=int(codes.max()) + 1 if len(codes) else 0)
    begin = starts_of(of_word)[:-1]
    text = np.repeat(np.arange(len(lengths)), lengths)
    some = of_word[codes] > 0
    codes, text = codes[some], text[some]
    counts = of_word[codes]
    entry = np.repeat(begin[codes], counts) + ranges(counts)
    width = max(len(known if names is None else names), 1)
    key, count = np.unique(np.repeat(text, counts) * width + number[entry], return_counts=True)
    text, number = np.divmod(key, width)
    return text, number if names is None else names[number], count


def _count(terms):
    """Per task and known term: texts, labelled texts and bad ones that it occurs in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = terms.value
        docs, n, bad = (np.zeros(len(known)) for _ in range(3))
        for batch in sized(batches, 3 << 20):
            text, at, _ = _terms(batch.column("text"), known)
            docs += np.bincount(at, minlength=len(known))
            for sums, name in ((n, "n"), (bad, "bad")):
                labels = batch.column(name).to_numpy(zero_copy_only=False)
                sums += np.bincount(at, labels[text], len(known))
        at = np.flatnonzero(docs)
        for some in np.array_split(at, len(at) // 100_000 + 1):
            yield pa.RecordBatch.from_arrays(
                [pa.array(some.astype(np.int32)), *(pa.array(x[some].astype(np.int64)) for x in (docs, n, bad))],
                names=["term", "docs", "n", "bad"],
            )

    return run


def telling(n: np.ndarray, bad: np.ndarray, n_all: int, n_bad: int) -> np.ndarray:
    """Whether the share of bad texts among those with a term is high and cannot be chance.

    By the odds, which have no upper end at any base rate, and a chi-square test whose bar rises
    with the number of terms tested.
    """
    tested = (n >= LEAST_DOCS) & (n < n_all)
    if not n_bad or n_bad == n_all:
        return np.zeros(len(n), bool)
    bar = 2 * np.log(max(int(tested.sum()), 2)) + 4
    n, bad = n.astype(float), bad.astype(float)
    chi = n_all * (bad * n_all - n * n_bad) ** 2 / np.where(tested, n * (n_all - n) * n_bad * (n_all - n_bad), 1.0)
    return tested & (chi >= bar) & (bad * (n_all - n_bad) >= LEAST_ODDS * n_bad * (n - bad))


_POSTING = np.dtype([("example", np.int32), ("weight", np.float32)])
_LAST = 0xFFFF
_SAID = 1 + np.log(np.maximum(np.arange(256), 1))


@dataclass
class Own:
    """The terms of every example, in the order of the slices, and how often they occur."""

    first: np.ndarray  # where those of each example begin
    term: np.ndarray
    count: np.ndarray  # in a byte, 255 for more
    more: np.ndarray  # the places of these, in order, and their counts
    counts: np.ndarray
    gain: np.ndarray  # weight of each term
    norm: np.ndarray  # length of each example, by which its weights are divided
    dense: np.ndarray  # a zero for each term, to be set and cleared again
    met: np.ndarray  # whether a text has terms of these last 16 bits, to be set and cleared again

    def best(self, term, weight, k: int, found: np.ndarray, bound: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Those of the examples ``found`` that can be among the k best, and their cosines: at most ``bound`` and ``MARGIN``."""
        if not len(found):
            return found, np.empty(0)
        near, cosine, some, last = np.empty(0, np.int64), np.empty(0), k, term & _LAST
        self.dense[term], self.met[last] = weight, True
        while len(found) > some:  # those of the highest bounds tell which others can be among the best
            order = np.argpartition(-bound, some)
            first, order = order[:some], order[some:]
            near = np.concatenate([near, found[first]])
            cosine = np.concatenate([cosine, self._products(found[first])])
            least, some = max(least, np.partition(cosine, -k)[-k]), 2 * k
            order = order[bound[order] > least - MARGIN]
            found, bound = found[order], bound[order]
        near, cosine = np.concatenate([near, found]), np.concatenate([cosine, self._products(found)])
        self.dense[term], self.met[last] = 0.0, False
        return near, cosine

    def _products(self, found: np.ndarray) -> np.ndarray:
        if not len(found):
            return np.empty(0)
        first, end = self.first[found], self.first[found + 1]
        cuts = [slice(*x) for x in zip(first.tolist(), end.tolist(), strict=True)]
        own = np.concatenate([self.term[x] for x in cuts])
        shared = np.flatnonzero(self.met.take(own & _LAST))  # most terms end here, by a small table
        own = own[shared]
        ends = np.cumsum(end - first)
        sizes = np.searchsorted(shared, ends)
        sizes[1:] -= sizes[:-1].copy()
        row = np.repeat(np.arange(len(found)), sizes)
        place = shared + (end - ends)[row]
        count = self.count[place]
        values = _SAID[count]
        for i in np.flatnonzero(count == 255).tolist():
            values[i] = 1 + np.log(self.counts[np.searchsorted(self.more, place[i])])
        values *= self.gain[own]
        values /= self.norm[found][row]
        values = values.astype(np.float32) * self.dense[own]  # weights have 32 bits
        return np.bincount(row, values, len(found)).astype(float, copy=False)


class Pool:
    """Examples that can be among the k nearest of a text, from the slices so far."""

    def __init__(self, floor: float) -> None:
        self.floor = floor  # a cosine that k examples reach
        self.best = np.empty(0)  # the k highest sums
        self.near: list = []

    def add(self, near: tuple[np.ndarray, np.ndarray, np.ndarray], k: int) -> None:
        """Take ``near``: examples, what they reach at least and at most, but for ``MARGIN``."""
        if not len(near[0]):
            return
        self.near.append((near[0].astype(np.int32), *near[1:]))
        best = np.concatenate([self.best, near[1]])
        if len(best) >= k:
            best = np.partition(best, -k)[-k:]
            self.floor = max(self.floor, best[0] - MARGIN)
        self.best = best

    def all(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found, score, bound = (np.concatenate(x) for x in zip(*self.near, strict=True)) if self.near else (self.best,) * 3
        some = bound > self.floor - MARGIN
        return found[some].astype(np.int64), score[some], bound[some]


@dataclass
class Index:
    """Weighted postings of a slice of the examples, by term.

    Terms that many examples have are rows of a matrix instead.
    """

    ids: np.ndarray
    lists: pa.BinaryArray  # by term: example and weight of the postings
    row: np.ndarray  # of each term in the matrix, or -1
    matrix: np.ndarray
    level: np.ndarray  # of each term: 0 heavy, then by ``FEW``, other lists, rows
    lengths: np.ndarray  # by level and example, in the terms of higher levels
    sorted: np.ndarray  # the same by length
    own: Own
    start: int  # of the slice among the examples
    number: np.ndarray  # of each example, as :meth:`nearest` gives it

    def products(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """What the terms of the matrix add to the cosine of every text (term, weight) and example."""
        asked = np.zeros((len(texts), len(self.matrix)), np.float32)
        for i, (term, weight) in enumerate(texts):
            at = self.row[term]
            asked[i, at[at >= 0]] = weight[at >= 0]
        used = np.flatnonzero(asked.any(axis=0))
        if len(used) < len(self.matrix) * 3 // 4:
            return asked[:, used] @ self.matrix[used]
        return asked @ self.matrix

    def n_rows(self, term: np.ndarray) -> int:
        return int((self.row[term] >= 0).sum())

    def scored(self, term: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """What the postings of the terms add to the cosine of every example."""
        lists = self.lists.take(pa.array(term))
        first = np.frombuffer(lists.buffers()[1], np.int32, len(term) + 1)
        posting = np.frombuffer(lists.buffers()[2] or b"", _POSTING)
        added = np.repeat(weight, (first[1:] - first[:-1]) // _POSTING.itemsize)
        added *= posting["weight"]
        return np.bincount(posting["example"], added, len(self.ids)).astype(float, copy=False)

    def few(self, term: np.ndarray, weight: np.ndarray, without: int, k: int, least: float) -> tuple | None:
        """Examples that can be among the k best and reach ``least``, the sums of some of their terms and bounds.

        Heavy terms go first and then those of few postings. None if that leaves many examples.
        """
        low, level, score, scored = max(least - MARGIN, 0.0), self.level[term], 0.0, -1
        rest = np.sqrt(np.cumsum(np.bincount(level, weight**2, len(self.lengths) + 1)[:0:-1])[::-1])
        for i, lengths in enumerate(self.lengths):
            # with nothing but these terms
            if rest[i] and len(self.ids) - np.searchsorted(self.sorted[i], low / rest[i]) > LEFT:
                continue
            mine = (level > scored) & (level <= i)
            score = score + self.scored(term[mine], weight[mine])
            scored, bound = i, score + rest[i] * lengths
            found = np.flatnonzero(bound > low)
            found = found[self.ids[found] != without]
            if len(found) > 2 * k:  # k examples reach the k-th highest sum of the scored terms
                found = found[bound[found] >= np.partition(score[found], -k)[-k] - MARGIN]
            if len(found) <= LEFT:
                return found + self.start, score[found], bound[found]
        return None

    def all(self, term: np.ndarray, weight: np.ndarray, without: int, k: int, product: np.ndarray, least: float) -> tuple:
        """As :meth:`few` by all terms, with what those of the matrix add; the sums are the cosines."""
        listed = self.scored(term, weight)
        score = listed + product
        found = np.flatnonzero(score > max(least - MARGIN, 0.0))
        found = found[self.ids[found] != without]
        if len(found) > k:  # all that can be among the k best get products in full precision
            score = score[found]
            found = found[score >= np.partition(score, -k)[-k] - MARGIN]
        row = self.row[term]
        rows = row >= 0
        cosine = listed[found] + weight[rows] @ self.matrix[np.ix_(row[rows], found)]
        return found + self.start, cosine, cosine

    def led(
        self, term: np.ndarray, weight: np.ndarray, without: int, k: int, least: float = 0.0
    ) -> tuple[np.ndarray, np.ndarray] | None:
        """As :meth:`nearest`, or None if the heavy terms and those of few postings leave many examples."""
        found = self.few(term, weight, without, k, least)
        return None if found is None else self._top(term, weight, k, *found, least)

    def nearest(
        self, term: np.ndarray, weight: np.ndarray, without: int, k: int, product: np.ndarray | None = None, least: float = 0.0
    ) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of highest cosine, and the cosines; equal ones by example number.

        Those of less than ``least`` can be left out.
        """
        product = self.products([(term, weight)])[0] if product is None else product
        return self._top(term, weight, k, *self.all(term, weight, without, k, product, least), least)

    def _top(self, term, weight, k: int, found: np.ndarray, _, bound: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        found, cosine = self.own.best(term, weight, k, found, bound, least)
        return _top(self.number[found[cosine > 0] - self.start], cosine[cosine > 0], k)


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sized(batches, 3 << 20):
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(_terms(batch.column("text"))[1]))], names=["term"])


def _sketches(text: np.ndarray, number: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
    """Directions of the texts in their frequent terms, of which those of one language share many."""
    common = number < COMMON
    text, at = text[common], mix(number[common].astype(np.uint64) + np.uint64(1))
    value = (1 + np.log(count[common])) * (1 - 2 * (at >> np.uint64(63)).astype(np.int8))
    place = text * SKETCH + (at % np.uint64(SKETCH)).astype(np.int64)
    sketch = np.bincount(place, value, n * SKETCH).reshape(n, SKETCH)
    return (sketch / np.maximum(np.linalg.norm(sketch, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def _alike(sketch: np.ndarray) -> np.ndarray:
    """An order with like rows together, those of small groups first.

    Groups are cut in two across the direction in which they differ most.
    """

    def cut(rows: np.ndarray, depth: int) -> list[np.ndarray]:
        if depth == 0 or len(rows) < 2 * BLOCK:
            return [rows]
        apart = sketch[rows] - sketch[rows].mean(axis=0)
        side = apart @ np.linalg.eigh(apart.T @ apart)[1][:, -1] > 0
        parts = sorted((rows[side], rows[~side]), key=len)
        return [x for part in parts for x in cut(part, depth - 1)]

    return np.concatenate(cut(np.arange(len(sketch)), DEPTH))


def _leading(terms, numbers, gain):
    """Length of each example in the terms that are not heavy, and its heavy terms with their weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, of_known, gains = terms.value, numbers.value, gain.value
        for batch in sized(batches, 3 << 20):
            text, at, count = _terms(batch.column("text"), known, of_known)
            weight, heavy = (1 + np.log(count)) * gains[at], gains[at] >= HEAVY
            norm = np.sqrt(np.bincount(text, weight**2, batch.num_rows))
            light = np.sqrt(np.bincount(text, weight**2 * ~heavy, batch.num_rows)) / np.maximum(norm, 1e-300)
            sketch = _sketches(text, at, count, batch.num_rows)
            sketch = pa.FixedSizeListArray.from_arrays(pa.array(sketch.ravel()), SKETCH).cast(pa.list_(pa.float32()))
            text, at, weight = text[heavy], at[heavy], (weight / norm[text])[heavy]
            cuts = starts_of(np.bincount(text, minlength=batch.num_rows)).astype(np.int32)
            lists = (pa.ListArray.from_arrays(pa.array(cuts), pa.array(x)) for x in (at.astype(np.int32), weight.astype(np.float32)))
            yield pa.RecordBatch.from_arrays(
                [*batch.select(["doc_id", "label", "same"]).columns, pa.array(light), sketch, *lists],
                names=["doc_id", "label", "same", "light", "sketch", "heavy", "weight"],
            )

    return run


def _postings(terms, numbers, cuts: np.ndarray, of_slice: int):
    """Postings of numbered examples, in pieces by slices of examples and ranges of terms, which begin at ``cuts``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, of_known = terms.value, numbers.value
        for batch in sized(batches, 3 << 20):
            text, at, count = _terms(batch.column("text"), known, of_known)
            example = batch.column("example").to_numpy()[text]
            part = example // of_slice * len(cuts) + np.searchsorted(cuts, at, side="right") - 1
            order = np.argsort(part, kind="stable")
            part = part[order]
            first = np.flatnonzero(np.diff(part, prepend=-1))
            ends = np.append(first, len(part))
            values = (x[order].astype(np.int32) for x in (at, example, count))
            columns = [[x[i:j].tobytes() for i, j in itertools.pairwise(ends)] for x in values]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part[first].astype(np.int32)), *(pa.array(c, pa.binary()) for c in columns)],
                names=["part", "term", "example", "count"],
            )

    return run


def _gathered(cuts: np.ndarray, n_terms: int, of_slice: int):
    """The packed postings of each slice and range of terms; both are numbered from 0 in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        widths = np.diff(cuts, append=n_terms)
        held: dict[int, list] = {}
        for batch in batches:
            for part, *values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.setdefault(part, []).append([np.frombuffer(v, np.int32) for v in values])
        for part in sorted(held):
            term, example, count = (np.concatenate(x) for x in zip(*held.pop(part), strict=True))
            piece, at = divmod(part, len(cuts))
            packed = pack(term - cuts[at].astype(np.int32), example - piece * of_slice, count, widths[at])
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), *(pa.array([x]) for x in packed)], names=["part", *_PACKED]
            )

    return run


def _by_term(heavy: pa.ChunkedArray, weight: pa.ChunkedArray) -> tuple:
    """The terms that occur, where the postings of each begin, and the examples and weights of these."""
    sizes = pc.list_value_length(heavy).to_numpy()
    term, weight = (pc.list_flatten(x).to_numpy() for x in (heavy, weight))
    order = np.argsort(term, kind="stable")
    terms, counts = np.unique(term, return_counts=True)
    return terms, starts_of(counts), np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[order], weight[order]


def build_index(examples: list, terms: np.ndarray, gain: np.ndarray, prior: float) -> Index:
    """``examples``: rows with doc_id, label, terms and counts."""
    sizes = np.array([len(e["terms"]) for e in examples], np.int64)
    term = np.concatenate([np.array(e["terms"], np.int32) for e in examples]) if examples else np.empty(0, np.int32)
    count = np.concatenate([np.array(e["counts"]) for e in examples]) if examples else np.empty(0, np.int32)
    ids, label = (np.array([e[c] for e in examples], t) for c, t in (("doc_id", np.int64), ("label", float)))
    parts = [pack(term, np.repeat(np.arange(len(ids)), sizes), count, len(terms))]
    return next(Packed(ids, label, terms, gain, prior, max(len(ids), 1), [parts]).slices())


_NONE = np.empty(0, np.int32), np.empty(0)
_PACKED = "examples", "counts", "with_term", "of_example", "of_count"


def pack(term: np.ndarray, example: np.ndarray, count: np.ndarray, n_terms: int) -> tuple:
    """Postings by term and example, compressed: examples, counts, postings per term, and the first two's types."""
    order = np.lexsort((example, term))
    example, count = (x[order].astype(np.min_scalar_type(int(x.max(initial=0)))) for x in (example, count))
    with_term = np.bincount(term, minlength=n_terms).astype(np.int32)
    packed = (zlib.compress(x.tobytes(), 1) for x in (example, count, with_term))
    return *packed, example.dtype.str, count.dtype.str


@dataclass
class Packed:
    """What the indexes of all slices of the examples are built from, in few bytes."""

    ids: np.ndarray
    label: np.ndarray
    terms: np.ndarray
    gain: np.ndarray
    prior: float
    of_slice: int
    parts: list  # by slice: postings of ranges of terms, in their order, as :func:`pack` gives them
    order: np.ndarray | None = None  # the examples as the slices hold them, if not in order
    heavy: tuple | None = None  # heavy terms, where their postings begin, examples and weights of these
    numbers: np.ndarray | None = None  # of the terms, if not in order

    own: Own | None = None  # made when it is first asked for, and kept by the worker
    light: np.ndarray | None = None  # length of each example beside its heavy terms, at most
    place: np.ndarray | None = None  # of each example among the slices
    lengths: dict | None = None  # those of the slices

    def ready(self) -> None:
        """Make what all texts need, once for all tasks of a worker."""
        if self.own is None:
            n, order = len(self.ids), self.order
            self.order = order = np.arange(n) if order is None else order
            self.place = np.empty(n, np.int64)
            self.place[order] = np.arange(n)
            if self.heavy is not None:
                square = np.bincount(self.heavy[2], self.heavy[3].astype(float) ** 2, n)
                self.light = np.sqrt(np.maximum(1 - square, 0.0) + 1e-6)  # weights are rounded to 32 bits
            self.lengths = {}
            self.own = self._by_example()

    def _by_example(self) -> Own:
        n, total = len(self.ids), sum(int(np.frombuffer(zlib.decompress(p[2]), np.int32).sum()) for parts in self.parts for p in parts)
        first, norm = np.zeros(n + 1, np.int64), np.zeros(n)
        own_term, own_count, more, counts_of_more = np.empty(total, np.int32), np.empty(total, np.uint8), [], []
        for i, parts in enumerate(self.parts):
            start = i * self.of_slice
            size = min(self.of_slice, n - start)
            squares, each = np.zeros(size), []
            for _, example, _, _, weight in _postings_of(parts, self.gain):
                squares += np.bincount(example, weight**2, size)
                each.append(np.bincount(example, minlength=size))
            norm[start : start + size] = np.sqrt(squares)
            ends = first[start] + np.cumsum(sum(each, np.zeros(size, np.int64)))
            first[start + 1 : start + size + 1] = ends
            left = first[start : start + size].copy()
            for (term, example, _, count, _), counts in zip(_postings_of(parts, self.gain), each, strict=True):
                order = np.argsort(example, kind="stable")
                to = np.repeat(left, counts) + ranges(counts)
                count = count[order]
                own_term[to], own_count[to] = term[order], np.minimum(count, 255)
                many = np.flatnonzero(count >= 255)
                more.append(to[many])
                counts_of_more.append(count[many].astype(np.int64))
                left += counts
        more, counts_of_more = (np.concatenate([np.empty(0, np.int64), *x]) for x in (more, counts_of_more))
        order = np.argsort(more)
        return Own(
            first, own_term, own_count, more[order], counts_of_more[order], self.gain, norm, np.zeros(len(self.terms)), np.zeros(_LAST + 1, bool)
        )

    def slices(self) -> Iterator[Index]:
        """The index of each slice, one at a time."""
        self.ready()
        for i, parts in enumerate(self.parts):
            yield _unpacked(self, i * self.of_slice, parts)

    def _sums(self, term: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """What the heavy terms, which are all that are given, add to the cosine of every example."""
        terms, first, example, weights = self.heavy
        at = np.searchsorted(terms, term)
        known = np.append(terms, -1)[at] == term
        at = at[known]
        size = first[at + 1] - first[at]
        posting = np.repeat(first[at], size) + ranges(size)
        return np.bincount(example[posting], weights[posting] * np.repeat(weight[known], size), len(self.ids))

    def floor(self, term: np.ndarray, weight: np.ndarray, without: int, k: int) -> float:
        """A cosine that k examples reach by their heavy terms alone."""
        if self.heavy is None:
            return 0.0
        mine = self.gain[term] >= HEAVY
        return self._kth(self._sums(term[mine], weight[mine]), without, k)

    def _kth(self, sums: np.ndarray, without: int, k: int) -> float:
        found = np.flatnonzero(sums)
        found = found[self.ids[found] != without]
        return float(np.partition(sums[found], -k)[-k]) if len(found) >= k else 0.0

    def first(self, term: np.ndarray, weight: np.ndarray, without: int, k: int) -> tuple[tuple[np.ndarray, np.ndarray] | None, float]:
        """The k nearest examples, if the heavy terms leave few that can be, else None; and a cosine that k examples reach."""
        mine = self.gain[term] >= HEAVY
        if self.heavy is None or not mine.any():
            return None, 0.0
        sums = self._sums(term[mine], weight[mine])
        floor = self._kth(sums, without, k)
        if not floor:
            return None, 0.0
        bound = sums + np.sqrt((weight[~mine] ** 2).sum()) * self.light
        found = np.flatnonzero(bound > floor - MARGIN)
        found = found[self.ids[found] != without]
        if len(found) > MANY:
            return None, floor
        found, cosine = self.own.best(term, weight, k, self.place[found], bound[found], floor)
        return _top(self.order[found[cosine > 0]], cosine[cosine > 0], k), floor

    def best(self, term: np.ndarray, weight: np.ndarray, pool: Pool, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest examples of all slices, and their cosines."""
        found, score, bound = pool.all()
        whole = score == bound  # all terms are in the sum
        other = ~whole
        more, products = self.own.best(term, weight, k, found[other], bound[other], pool.floor)
        found, cosine = found[whole], score[whole]
        found, cosine = np.append(found, more), np.append(cosine, products)
        return _top(self.order[found[cosine > 0]], cosine[cosine > 0], k)

    def vote(self, found: np.ndarray, cosine: np.ndarray) -> float:
        return float((cosine @ self.label[found] + PRIOR * self.prior) / (cosine.sum() + PRIOR))


def _postings_of(parts: list, gain: np.ndarray) -> Iterator[tuple]:
    """Range by range, which takes little memory: term and example of the postings, postings per term, counts, weights yet to be divided."""
    begin = 0
    for examples, counts, with_term, of_example, of_count in parts:
        sizes = np.frombuffer(zlib.decompress(with_term), np.int32)
        count = np.frombuffer(zlib.decompress(counts), of_count)
        said = 1 + np.log(np.maximum(np.arange(int(count.max(initial=0)) + 1), 1))
        weight = said[count]
        weight *= np.repeat(gain[begin : begin + len(sizes)], sizes)
        term = np.repeat(np.arange(begin, begin + len(sizes), dtype=np.int32), sizes)
        yield term, np.frombuffer(zlib.decompress(examples), of_example), sizes, count, weight
        begin += len(sizes)


def _unpacked(packed: Packed, start: int, parts: list) -> Index:
    number = packed.order[start : start + packed.of_slice]
    n, norm = len(number), packed.own.norm[start : start + packed.of_slice]
    with_term = np.concatenate([np.empty(0, np.int32), *(np.frombuffer(zlib.decompress(p[2]), np.int32) for p in parts)])
    heavy = packed.gain >= HEAVY
    least = np.partition(with_term, -ROWS)[-ROWS] if len(with_term) > ROWS else 0
    many = np.flatnonzero((with_term > max(least, BLOCK, SHARE * n)) & ~heavy)
    row = np.full(len(with_term), -1, np.int32)
    row[many] = np.arange(len(many))
    top = len(FEW) + 2
    level = np.searchsorted(FEW, with_term).astype(np.int8) + np.int8(1)
    level[heavy], level[many], level[with_term == 0] = 0, top, 0
    begin = starts_of(np.where(row < 0, with_term, 0))
    posting = np.empty(begin[-1], _POSTING)
    matrix, at, lengths = np.zeros((len(many), n), np.float32), 0, packed.lengths.get(start)
    squares = np.zeros((top + 1) * n)
    for term, of, _, _, value in _postings_of(parts, packed.gain):
        value /= norm[of]
        if lengths is None:
            squares += np.bincount(level[term] * np.int64(n) + of, value**2, (top + 1) * n)
        rows = row[term]
        listed = np.flatnonzero(rows < 0)
        to = at + len(listed)
        posting["example"][at:to], posting["weight"][at:to] = of[listed], value[listed]
        listed = np.flatnonzero(rows >= 0)
        matrix[rows[listed], of[listed]] = value[listed]
        at = to
    if lengths is None:
        lengths = packed.lengths[start] = np.sqrt(np.cumsum(squares.reshape(top + 1, n)[:0:-1], axis=0)[::-1])
    begin = (begin * _POSTING.itemsize).astype(np.int32)
    lists = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(begin), pa.py_buffer(posting)])
    return Index(packed.ids[number], lists, row, matrix, level, lengths, np.sort(lengths, axis=1), packed.own, start, number)


def _monotone(rate: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The closest non-decreasing values, by pooling neighbours that violate the order."""
    pools: list[list[float]] = []
    for r, w in zip(rate, weight, strict=True):
        pools.append([r, w, 1])
        while len(pools) > 1 and pools[-2][0] > pools[-1][0]:
            r1, w1, n1 = pools.pop()
            r0, w0, n0 = pools.pop()
            pools.append([(r0 * w0 + r1 * w1) / max(w0 + w1, 1e-12), w0 + w1, n0 + n1])
    return np.concatenate([np.full(int(n), r) for r, _, n in pools])


def _top(found: np.ndarray, cosine: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    top = np.lexsort((found, -np.round(cosine, 12)))[:k]
    return found[top], cosine[top]


def _voted(index, k: int, columns: list[str], leave_out: bool, held_terms: int):
    def run(batches):
        own, seen = index.value, {}  # seen: by key, the nearest examples and their cosines
        waiting: dict = {}
        held: list = []

        def settle() -> Iterator[pa.RecordBatch]:
            """Take all texts that wait through the slices, of which one is unpacked at a time."""
            own.ready()
            asked: list = []  # texts that their heavy terms leave many examples

            def text_of(term: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                weight = (1 + np.log(times.astype(float))) * own.gain[term]
                return term, weight / np.sqrt(weight @ weight)

            for key, (*said, without) in waiting.items():
                text = text_of(*said)
                near, floor = own.first(*text, without, k)
                if near is None:
                    asked.append((key, said, without, Pool(floor)))
                else:
                    seen[key] = near
            for part in own.slices() if asked else ():
                left: list = []
                for _, said, without, pool in asked:
                    near = part.few(*text_of(*said), without, k, pool.floor)
                    if near is None:
                        left.append((part.n_rows(said[0]), said, without, pool))
                    else:
                        pool.add(near, k)
                left.sort(key=lambda x: x[0])  # texts of one language and length have like rows
                for i in range(0, len(left), CHUNK):
                    some = [(text_of(*said), *x) for _, said, *x in left[i : i + CHUNK]]
                    for (text, without, pool), product in zip(some, part.products([x[0] for x in some]), strict=True):
                        pool.add(part.all(*text, without, k, product, pool.floor), k)
                del part, left  # before the next one is unpacked
            for key, said, _, pool in asked:
                seen[key] = own.best(*text_of(*said), pool, k)
            for batch, keys in held:
                near = [seen.get(key, _NONE) for key in keys]
                votes = [own.vote(*x) if key else None for key, x in zip(keys, near, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        *batch.columns,
                        pa.array(votes, pa.float64()),
                        pa.array([own.ids[found] for found, _ in near], pa.list_(pa.int64())),
                        pa.array([cosine for _, cosine in near], pa.list_(pa.float64())),
                    ],
                    names=[*columns, "vote", "neighbours", "cosines"],
                )
            waiting.clear()
            held.clear()
            if len(seen) > SEEN:
                seen.clear()

        n_held = 0
        for batch in sized(batches, 3 << 20):
            text, at, count = _terms(batch.column("text"), own.terms, own.numbers)
            cuts = np.searchsorted(text, np.arange(batch.num_rows + 1))
            at, count = at.astype(np.int32), count.astype(np.int32)
            few = count.astype(np.min_scalar_type(int(count.max(initial=0))))
            keys: list = []
            for i, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                term, times = at[cuts[i] : cuts[i + 1]], count[cuts[i] : cuts[i + 1]]
                if not len(term):
                    keys.append(None)
                    continue
                said = hashlib.blake2b(term.tobytes() + times.tobytes(), digest_size=16).digest()
                key = said, doc_id if leave_out else None
                keys.append(key)
                if key not in seen and key not in waiting:
                    waiting[key] = term.copy(), few[cuts[i] : cuts[i + 1]].copy(), doc_id if leave_out else -(1 << 62)
                    n_held += len(term)
            held.append((batch.select(columns), keys))
            if n_held >= held_terms:
                yield from settle()
                n_held = 0
        yield from settle()

    return run


def score(docs: DataFrame, labels: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """Score the texts of (doc_id, text) by examples in ``labels`` (doc_id, label of 0 or 1).

    Labels other than 0 and 1, NULLs and labels of unknown documents are left out; other
    columns are ignored. Columns: doc_id, score (0 to 1), predicted (1 if the score is at least
    ``THRESHOLD``), neighbours (doc_ids of the nearest examples, the evidence) and their
    cosines. A text without a term of the examples, such as a NULL or empty one, gets the rate of such
    labelled texts; without any labels all scores are 0. Repeated rows are scored alike. The index is
    built before the result is returned.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    usable = labels.select("doc_id", F.col("label").cast("int").alias("label"))
    usable = materialize(usable.where("label in (0, 1) and doc_id is not null").distinct(), "labels")
    small = bounded(usable, 1_000_000)
    totals = docs.select("doc_id").join(small, "doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("bad")).first()
    n, n_bad = totals["n"], totals["bad"] or 0
    prior = n_bad / n if n else 0.0
    # ids first: texts and vectors of the chosen ones only go to the driver
    same = F.xxhash64("text").alias("same")
    able = docs.where(F.col("text").rlike(r"\p{L}")).select("doc_id", same).join(small, "doc_id").distinct()
    able = materialize(able.orderBy(F.xxhash64("doc_id"), "doc_id", "label", "same").limit(EXAMPLES), "chosen")
    chosen = docs.select("*", same).join(F.broadcast(able), ["doc_id", "same"]).dropDuplicates(["doc_id", "label", "same"])
    chosen = materialize(chosen.select("doc_id", "label", "same", "text"), "examples")
    terms = np.sort(chosen.mapInArrow(_distinct, "term long").distinct().toArrow().column("term").to_numpy())
    known = spark.sparkContext.broadcast(terms)
    # a text with both labels is one text
    of_text = small.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("bad"))
    marked = docs.join(of_text, "doc_id", "left").select("text", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "bad")))
    counted = marked.mapInArrow(_count(known), "term int, docs long, n long, bad long")
    counted = counted.groupBy("term").agg(*(F.sum(c).alias(c) for c in ("docs", "n", "bad"))).toArrow()
    df, n_with, bad_with = np.zeros((3, len(terms)))
    for sums, name in ((df, "docs"), (n_with, "n"), (bad_with, "bad")):
        sums[counted.column("term").to_numpy()] = counted.column(name).to_numpy()
    idf = np.log((1 + docs.count()) / (1 + df)) + 1
    gain = idf * np.where(telling(n_with, bad_with, n, n_bad), 1.0, FAINT)
    # frequent terms have the first numbers, so that what most texts look up is together
    order = np.argsort(-df, kind="stable")
    numbers = np.empty(len(terms), np.int32)
    numbers[order] = np.arange(len(terms), dtype=np.int32)
    gain, posted = gain[order], np.cumsum(df[order])
    n_ranges = len(terms) // PART + 1
    cuts = np.unique(np.searchsorted(posted, posted[-1:] * np.arange(n_ranges) / n_ranges)) if len(terms) else np.zeros(1, np.int64)
    numbers_of = spark.sparkContext.broadcast(numbers)
    del counted, df, n_with, bad_with, idf, posted, order
    # postings are brought together by term in tasks; what comes to the driver is packed
    rows = chosen.mapInArrow(
        _leading(known, numbers_of, spark.sparkContext.broadcast(gain)),
        "doc_id long, label int, same long, light double, sketch array<float>, heavy array<int>, weight array<float>",
    )
    rows = rows.orderBy("doc_id", "label", "same").toArrow()
    ids, label = rows.column("doc_id").to_numpy(), rows.column("label").to_numpy().astype(float)
    # examples of one slice have much or little beside their heavy terms, and those with much are of like texts
    light = rows.column("light").to_numpy()
    plain = np.flatnonzero(light > PLAIN)
    sketch = pc.list_flatten(rows.column("sketch")).to_numpy().reshape(-1, SKETCH)
    order = np.argsort(-light, kind="stable")
    order[: len(plain)] = plain[_alike(sketch[plain])]
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    heavy = _by_term(rows.column("heavy"), rows.column("weight"))
    rows = spark.createDataFrame(rows.select(["doc_id", "label", "same"]).append_column("example", pa.array(place)))
    numbered = chosen.join(F.broadcast(rows), ["doc_id", "label", "same"]).select("example", "text")
    posted = numbered.mapInArrow(_postings(known, numbers_of, cuts, SLICE), "part int, term binary, example binary, count binary")
    packed = posted.repartition(n_ranges, "part").mapInArrow(
        _gathered(cuts, len(terms), SLICE),
        "part int, examples binary, counts binary, with_term binary, of_example string, of_count string",
    )
    packed = {r["part"]: tuple(r[c] for c in _PACKED) for r in packed.toArrow().to_pylist()}
    none = [np.empty(0, np.int32)] * 3
    parts = [
        [packed.get(i * len(cuts) + j) or pack(*none, width) for j, width in enumerate(np.diff(cuts, append=len(terms)))]
        for i in range(-(-len(ids) // SLICE))
    ]
    index = spark.sparkContext.broadcast(Packed(ids, label, terms, gain, prior, SLICE, parts, order, heavy, numbers))
    del packed, parts
    voted = "vote double, neighbours array<long>, cosines array<double>"
    judged = chosen.drop("same").repartition(spark.sparkContext.defaultParallelism).mapInArrow(
        _voted(index, k, ["doc_id", "label"], True, HELD), f"doc_id long, label int, {voted}"
    )
    scored = materialize(docs.mapInArrow(_voted(index, k, ["doc_id"], False, HELD), f"doc_id long, {voted}"), "votes")
    bare = scored.where("vote is null").select("doc_id").join(small, "doc_id")
    bare = bare.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("bad")).first()
    empty = ((bare["bad"] or 0) + PRIOR * prior) / (bare["n"] + PRIOR)
    bin_of = F.least(F.floor(F.col("vote") * BINS), F.lit(BINS - 1)).cast("int")
    others = scored.join(small, "doc_id").join(F.broadcast(able.select("doc_id").distinct()), "doc_id", "left_anti")
    judged = judged.select("vote", "label").unionByName(others.select("vote", "label"))
    seen = judged.where("vote is not null").groupBy(bin_of.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("bad"), F.avg("vote").alias("vote")
    )
    curve = sorted((r["vote"], r["bad"], r["n"]) for r in seen.collect())
    at = np.array([c[0] for c in curve])
    rate = _monotone(np.array([(c[1] + c[0]) / (c[2] + 1) for c in curve]), np.array([c[2] for c in curve])) if curve else at
    # straight lines between the bins
    value = F.col("vote")
    if len(at):
        value = F.lit(float(rate[-1]))
        for i in range(len(at) - 1, 0, -1):
            slope = (rate[i] - rate[i - 1]) / max(at[i] - at[i - 1], 1e-12)
            line = F.lit(float(rate[i - 1])) + F.lit(float(slope)) * (F.col("vote") - F.lit(float(at[i - 1])))
            value = F.when(F.col("vote") <= float(at[i]), line).otherwise(value)
        value = F.when(F.col("vote") <= float(at[0]), F.lit(float(rate[0]))).otherwise(value)
    value = F.least(F.greatest(F.coalesce(F.when(F.col("vote").isNotNull(), value), F.lit(float(empty))), F.lit(0.0)), F.lit(1.0))
    scored = scored.withColumn("score", value)
    return scored.select("doc_id", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "neighbours", "cosines")
