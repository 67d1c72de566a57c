"""Quality of texts, learned from heuristics that disagree.

Method: weak labels. Heuristic labellers vote good, bad or nothing; expectation-maximisation
over the counts of all vote patterns estimates how accurate each one is; the posterior of a
text's pattern is its label for a hashed linear scorer, which then scores every text, also
where the labellers have nothing to say.

Votes and patterns are counted by Spark over all texts, at most 3^labellers patterns. The
scorer is fitted to a bounded sample of texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawlnet.llm.frames import sized
from trawlnet.llm.windows import ascii_words, mix, starts_of, word_hashes

SAMPLE = 6000  # texts that the scorer is fitted to
BUCKETS = 1 << 17
ROUNDS = 60  # of gradient descent
LEARNERS = 50  # rounds of expectation-maximisation

# Fixed values: (measure, a text is bad beyond this, it is in order up to this).
LIMITS = (
    ("symbols", 0.10, 0.02),
    ("tails", 0.15, 0.02),
    ("capitals", 0.40, 0.15),
    ("shouts", 0.15, 0.05),
    ("digits", 0.20, 0.08),
    ("bare", 0.10, 0.05),
    ("repeats", 0.10, 0.03),
    ("sameness", 0.60, 0.45),
)
MEASURES = tuple(name for name, _, _ in LIMITS)
TIDY = ("symbols", "tails", "capitals", "shouts", "digits", "bare")
VARIED = ("repeats", "sameness")
#: One labeller per measure finds bad texts; one more each says that characters, or words, are in order.
LABELLERS = (*MEASURES, "tidy", "varied")
SHORT, LONG = 10, 500  # words; shorter and longer texts say nothing about sameness


def _table(characters: bytes) -> np.ndarray:
    table = np.zeros(256)
    table[list(characters)] = 1
    return table


_SYMBOLS = _table(b"#$%&*|<>=~^_{}[]\\@+/")
_CAPITALS = _table(bytes(range(65, 91)))
_DIGITS = _table(bytes(range(48, 58)))
_LETTERS = _table(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))
_SHOUTS = _table(b"!?")
_TAILS = _table(b"#$%&*|<>=~^_[]\\@+/")


def _measure(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """(words per text, measures per text, words, their hashes, repeats) of a batch."""
    flat, lengths = ascii_words(texts)
    n_texts, n = len(lengths), len(flat)
    if not n:
        return lengths, np.zeros((n_texts, len(MEASURES))), flat, np.empty(0, np.uint64), np.empty(0, bool)
    hashes = word_hashes(flat)
    text = np.repeat(np.arange(n_texts), lengths)
    ends = np.frombuffer(flat.buffers()[1], np.int32)[flat.offset : flat.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(flat.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    begin = (ends - ends[0])[:-1]

    def total(table: np.ndarray) -> np.ndarray:
        """Of each word: the characters that are in the table."""
        return np.add.reduceat(table[raw], begin)

    letters, size = total(_LETTERS), np.diff(ends)
    of = lambda values: np.bincount(text, values, n_texts)
    again = np.concatenate([[False], (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])])
    order = np.lexsort((hashes, text))
    new = (np.diff(hashes[order], prepend=~hashes[order][:1]) != 0) | (np.diff(text[order], prepend=-1) != 0)
    distinct = np.bincount(text[order][new], minlength=n_texts)
    words, chars = np.maximum(lengths, 1), np.maximum(of(size), 1)
    rows = {
        "symbols": of(total(_SYMBOLS)) / chars,
        "capitals": of(total(_CAPITALS)) / np.maximum(of(letters), 1),
        "digits": of(total(_DIGITS)) / chars,
        "repeats": of(again.astype(float)) / words,
        "sameness": 1 - distinct / words,
        "bare": of((letters == 0).astype(float)) / words,
        "shouts": of((total(_SHOUTS) > 0).astype(float)) / words,
        "tails": of(_TAILS[raw[begin + size - 1]]) / words,
    }
    return lengths, np.stack([rows[m] for m in MEASURES], axis=1), flat, hashes, again


def _votes(lengths: np.ndarray, measures: np.ndarray) -> np.ndarray:
    """1 good, 2 bad, 0 nothing; no labeller votes on a text without words."""
    bad = measures > [limit for _, limit, _ in LIMITS]
    fine = measures <= [limit for _, _, limit in LIMITS]
    same = MEASURES.index("sameness")
    unsure = (lengths < SHORT) | (lengths > LONG)
    bad[unsure, same], fine[unsure, same] = False, True
    votes = np.where(bad, 2, 0)
    good = [fine[:, [MEASURES.index(m) for m in group]].all(1) for group in (TIDY, VARIED)]
    votes = np.column_stack([votes, *(np.where(g, 1, 0) for g in good)])
    votes[lengths == 0] = 0
    return votes


def _pattern(votes: np.ndarray) -> np.ndarray:
    return votes @ (3 ** np.arange(votes.shape[1]))


def _features(lengths, measures, flat, hashes, again) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features and their number per text: words, endings, repeats, coarse measures."""
    n_texts, n = len(lengths), len(flat)
    if not n:
        return np.empty(0, np.int64), np.zeros(n_texts, np.int64)
    ends = np.frombuffer(flat.buffers()[1], np.int32)[flat.offset : flat.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(flat.buffers()[2], np.uint8)
    last = np.zeros(n, np.uint64)
    for back in (1, 2, 3):
        at = np.maximum(ends[1:] - back, ends[:-1])
        last = last * np.uint64(257) + raw[at] * (ends[1:] - back >= ends[:-1])
    with np.errstate(over="ignore"):
        end = mix(last.astype(np.uint64) + np.uint64(1 << 40) + again.astype(np.uint64) * np.uint64(1 << 41))
        coarse = np.minimum((measures * 20).astype(np.uint64), np.uint64(19))
        coarse = mix(coarse + np.arange(len(MEASURES), dtype=np.uint64) * np.uint64(32) + np.uint64(1 << 50))
    text = np.repeat(np.arange(n_texts), lengths)
    some = np.flatnonzero(lengths)
    # a coarse measure weighs as much as all words do
    times = np.maximum(lengths // len(MEASURES), 1)
    rows = np.concatenate([text, text, np.repeat(np.repeat(some, len(MEASURES)), np.repeat(times[some], len(MEASURES)))])
    values = np.concatenate([hashes, end, np.repeat(coarse[some].ravel(), np.repeat(times[some], len(MEASURES)))])
    order = np.argsort(rows, kind="stable")
    return (values[order] % np.uint64(BUCKETS)).astype(np.int64), np.bincount(rows, minlength=n_texts)


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(3 ** len(LABELLERS), np.int64)
    for batch in sized(batches, 3 << 20):
        lengths, measures, *_ = _measure(batch.column("text"))
        counts += np.bincount(_pattern(_votes(lengths, measures)), minlength=len(counts))
    seen = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], names=["pattern", "n"])


@dataclass
class Weak:
    """Share of good texts, and of each labeller how its votes fall on good and bad ones."""

    good: float
    votes: np.ndarray  # (labeller, vote, class): probability
    posterior: np.ndarray  # of good, per pattern


def expectation_maximisation(pattern: np.ndarray, n: np.ndarray, labellers: int, rounds: int = LEARNERS) -> Weak:
    """Fit the model in which votes are independent given the class.

    Starts from labellers that miss most bad texts but seldom call a good one bad, which makes
    class 0 the good one.
    """
    digit = pattern[:, None] // 3 ** np.arange(labellers) % 3
    table = np.empty((labellers, 3, 2))
    table[:] = [[0.48, 0.45], [0.50, 0.25], [0.02, 0.30]]
    good = 0.8
    every = np.arange(3**labellers)[:, None] // 3 ** np.arange(labellers) % 3

    def posterior(digits: np.ndarray) -> np.ndarray:
        log = np.log([good, 1 - good]) + sum(np.log(table[i, digits[:, i]]) for i in range(labellers))
        log -= log.max(1, keepdims=True)
        p = np.exp(log)
        return p[:, 0] / p.sum(1)

    for _ in range(rounds if n.sum() else 0):
        p = posterior(digit)
        weight = np.stack([n * p, n * (1 - p)], axis=1)
        good = float(np.clip(weight[:, 0].sum() / n.sum(), 0.01, 0.99))
        for i in range(labellers):
            for v in range(3):
                table[i, v] = weight[digit[:, i] == v].sum(0) + 1.0
        table /= table.sum(1, keepdims=True)
    return Weak(good, table, posterior(every))


@dataclass
class Model:
    weak: Weak
    weight: np.ndarray
    bias: float


def _fit(features: np.ndarray, sizes: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression on mean feature weights, by adaptive gradient steps."""
    weight, bias = np.zeros(BUCKETS), 0.0
    row = np.repeat(np.arange(len(sizes)), sizes)
    scale = 1.0 / np.maximum(sizes, 1)
    history, bias_history = np.full(BUCKETS, 1e-8), 1e-8
    for _ in range(ROUNDS):
        z = bias + np.bincount(row, weight[features], len(sizes)) * scale
        gap = 1 / (1 + np.exp(-z)) - target
        gradient = np.bincount(features, (gap * scale)[row], BUCKETS) / len(sizes) + 1e-7 * weight
        history += gradient**2
        weight -= 1.0 * gradient / np.sqrt(history)
        bias_history += gap.mean() ** 2
        bias -= 0.5 * gap.mean() / np.sqrt(bias_history)
    return weight, float(bias)


def train(docs: DataFrame) -> Model:
    """Count the votes on all texts of ``docs``, then fit the scorer to a sample of them.

    The sample has about ``SAMPLE`` texts, chosen by a hash of the text. An empty table gives
    a model that scores every text alike.
    """
    texts = docs.select("text").where("text is not null")
    counted = texts.mapInArrow(_vote, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).toArrow()
    pattern, n = counted.column("pattern").to_numpy(), counted.column("n").to_numpy()
    weak = expectation_maximisation(pattern, n, len(LABELLERS))
    share = min(1.0, SAMPLE / max(int(n.sum()), 1))
    chosen = F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(share * 1_000_000)

    def describe(batches):
        for batch in sized(batches, 3 << 20):
            found = _measure(batch.column("text"))
            features, sizes = _features(*found)
            cuts = starts_of(sizes)
            rows = [features[cuts[i] : cuts[i + 1]].astype(np.int32).tobytes() for i in range(len(sizes))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(_pattern(_votes(*found[:2]))), pa.array(rows, pa.binary())], names=["pattern", "features"]
            )

    sample = texts.where(chosen).distinct().mapInArrow(describe, "pattern long, features binary")
    table = sample.where("length(features) > 0").limit(2 * SAMPLE).toArrow()
    if not table.num_rows:
        return Model(weak, np.zeros(BUCKETS), 0.0)
    parts = [np.frombuffer(x.as_buffer(), np.int32) for x in table.column("features")]
    sizes = np.array([len(p) for p in parts])
    weight, bias = _fit(np.concatenate(parts), sizes, weak.posterior[table.column("pattern").to_numpy()])
    return Model(weak, weight, bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted, posterior) of every row of (doc_id, text).

    ``score`` is the scorer's probability of a good text, ``predicted`` whether it is at least
    a half, ``posterior`` what the labellers alone say. Texts without words, NULLs among
    them, score 0. Repeated rows are scored alike; other columns are ignored.
    """
    inside = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = inside.value
        for batch in sized(batches, 3 << 20):
            found = _measure(batch.column("text"))
            features, sizes = _features(*found)
            row = np.repeat(np.arange(len(sizes)), sizes)
            z = own.bias + np.bincount(row, own.weight[features], len(sizes)) / np.maximum(sizes, 1)
            value = np.where(sizes > 0, 1 / (1 + np.exp(-z)), 0.0)
            posterior = np.where(sizes > 0, own.weak.posterior[_pattern(_votes(*found[:2]))], 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(value), pa.array((value >= 0.5).astype(np.int32)), pa.array(posterior)],
                names=["doc_id", "score", "predicted", "posterior"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int, posterior double")
