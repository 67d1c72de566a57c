"""Language of texts, and the spans of mixed ones.

Method: the script of a word (found in code point ranges) narrows the candidate languages;
character trigrams of the word score the candidates; a Viterbi pass over the words of the
text with a penalty for every switch of language labels spans; the language with most
letters wins. The model is counted by Spark over all training texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawlnet.functions.batches import split_words
from trawlnet.llm.frames import extended, sized
from trawlnet.llm.windows import ranges, starts_of

BUCKETS = 1 << 16  # hashed trigrams; with the number of languages the size of the model
PIECE = 2 << 20  # bytes of texts whose words are labelled together; about 50 times as much memory
SWITCH = 12.0  # price of a switch of language, as a difference of log likelihoods
UNKNOWN = "und"

# First code point of ranges, and the script that starts there.
_RANGES = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"),
    (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "other"), (0x0900, "devanagari"),
    (0x0980, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"),
    (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"),
    (0xFB00, "other"),
)
SCRIPTS = tuple(dict.fromkeys(name for _, name in _RANGES))


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _scripts_of(codes: np.ndarray) -> np.ndarray:
    starts = np.array([first for first, _ in _RANGES])
    names = np.array([SCRIPTS.index(name) for _, name in _RANGES])
    return names[np.searchsorted(starts, codes, side="right") - 1]


@dataclass
class _Words:
    """Distinct words of a batch: hashed trigrams, letters and script of each."""

    grams: np.ndarray
    gram_word: np.ndarray
    letters: np.ndarray
    script: np.ndarray


def _words(distinct: pa.Array) -> _Words:
    """Letters of the words only; a word without any has no trigram."""
    n = len(distinct)
    joined = "\n" + "\n".join(distinct.to_pylist()) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    gap = codes == 10
    codes = codes[gap | _letters()[codes]]
    gap = codes == 10
    word = np.cumsum(gap) - 1  # of each letter; a gap belongs to the word that follows it
    inner = np.flatnonzero(~gap)
    letters = np.bincount(word[inner], minlength=n)[:n]
    first = inner[np.flatnonzero(np.diff(word[inner], prepend=-1))]
    script = np.zeros(n, np.int64)
    script[word[first]] = _scripts_of(codes[first])
    c = codes.astype(np.uint64)
    with np.errstate(over="ignore"):
        h = (c[inner - 1] * np.uint64(0x1F123BB5) + c[inner]) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(29))) + c[inner + 1] * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return _Words((h >> np.uint64(48)).astype(np.int64) % BUCKETS, word[inner], letters, script)


def _encoded(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct lower-cased words, the index of each word, and the words of each text."""
    flat, lengths = split_words(pc.utf8_lower(texts.cast(pa.string())))
    coded = flat.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), lengths


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram and script counts per language of what this task reads."""
    totals: dict[str, np.ndarray] = {}
    for batch in sized(batches, PIECE):
        distinct, codes, lengths = _encoded(batch.column("text"))
        if not len(distinct):
            continue
        words = _words(distinct)
        langs = batch.column("lang").dictionary_encode()
        of_word = np.repeat(langs.indices.to_numpy(zero_copy_only=False), lengths)
        for i, lang in enumerate(langs.dictionary.to_pylist()):
            times = np.bincount(codes[of_word == i], minlength=len(distinct))
            sums = totals.setdefault(lang, np.zeros(BUCKETS + len(SCRIPTS)))
            sums[:BUCKETS] += np.bincount(words.grams, times[words.gram_word], BUCKETS)
            sums[BUCKETS:] += np.bincount(words.script, times * words.letters, len(SCRIPTS))
    for lang, sums in totals.items():
        key = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(key), pa.string()), pa.array(key.astype(np.int32)), pa.array(sums[key])],
            names=["lang", "bucket", "n"],
        )


@dataclass
class Model:
    """Log probabilities (bucket, language) and the scripts that a language is written in."""

    langs: list[str]
    logp: np.ndarray
    written: np.ndarray


def train(labelled: DataFrame, least_script: float = 0.001) -> Model:
    """Count a model over all rows of (text, lang); rows with a NULL in either are left out.

    The model has at most ``BUCKETS`` numbers per language whatever the number of rows. A
    language uses a script that holds ``least_script`` of its letters.
    """
    rows = labelled.where("text is not null and lang is not null").select("text", "lang")
    counted = rows.mapInArrow(_count, "lang string, bucket int, n double")
    table = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(table.column("lang").to_pylist()))
    sums = np.zeros((BUCKETS + len(SCRIPTS), len(langs)))
    column = pc.index_in(table.column("lang"), pa.array(langs, pa.string())).to_numpy()
    sums[table.column("bucket").to_numpy(), column.astype(np.int64)] = table.column("n").to_numpy()
    grams, scripts = sums[:BUCKETS], sums[BUCKETS:]
    smooth = 0.5
    logp = np.log(grams + smooth) - np.log(grams.sum(0) + smooth * BUCKETS)
    written = scripts >= least_script * np.maximum(scripts.sum(0), 1)
    written[~written.any(1)] = True  # a script that nobody uses excludes nobody
    return Model(langs, logp.astype(np.float32), written)


def _viterbi(scores: np.ndarray, lengths: np.ndarray, switch: float) -> np.ndarray:
    """Best language of every word; the texts advance together, longest first."""
    total, n_langs = scores.shape
    order = np.argsort(-lengths, kind="stable")
    sizes, first = lengths[order], starts_of(lengths)[:-1][order]
    came = np.empty((total, n_langs), np.int16)
    best = np.empty(total, np.int16)
    longest = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(longest), side="left")  # texts longer than t
    own = np.arange(n_langs, dtype=np.int16)
    value = np.zeros((len(sizes), n_langs), np.float32)
    for t in range(longest):
        a = active[t]
        at, now = first[:a] + t, value[:a]
        top = now.argmax(1).astype(np.int16)
        entry = now[np.arange(a), top] - switch
        stay = now >= entry[:, None]
        came[at] = np.where(stay, own, top[:, None])
        now = np.where(stay, now, entry[:, None])
        now -= now.max(1, keepdims=True)
        value[:a] = now + scores[at]
    state = value.argmax(1).astype(np.int16)
    for t in range(longest - 1, -1, -1):
        a = active[t]
        at, now = first[:a] + t, state[:a]
        best[at] = now
        state[:a] = came[at, now]
    return best


def _label(model: Model, switch: float, texts: pa.Array) -> tuple[list, np.ndarray, list, list, list]:
    n_texts, n_langs = len(texts), len(model.langs)
    distinct, codes, lengths = _encoded(texts)
    none = [UNKNOWN] * n_texts, np.zeros(n_texts), [[]] * n_texts, [[]] * n_texts, [[]] * n_texts
    if not len(distinct) or not n_langs:
        return none
    words = _words(distinct)
    scores = np.zeros((len(distinct), n_langs), np.float32)
    sums = np.add.reduceat(
        model.logp[words.grams], np.flatnonzero(np.diff(words.gram_word, prepend=-1)), axis=0
    ) if len(words.grams) else np.empty((0, n_langs), np.float32)
    scores[words.letters > 0] = sums
    scores[~model.written[words.script]] -= 1000.0
    text_of = np.repeat(np.arange(n_texts), lengths)
    place = ranges(lengths)
    said = words.letters[codes] > 0
    codes, text_of, place = codes[said], text_of[said], place[said]
    if not len(codes):
        return none
    spoken = np.bincount(text_of, minlength=n_texts)
    path = _viterbi(scores[codes], spoken, switch)
    letters = words.letters[codes]
    share = np.bincount(text_of * n_langs + path, letters, n_texts * n_langs).reshape(n_texts, n_langs)
    most = share.argmax(1)
    total = share.sum(1)
    score = share.max(1) / np.maximum(total, 1)
    langs = [model.langs[i] if t else UNKNOWN for i, t in zip(most, total, strict=True)]
    turn = np.flatnonzero((np.diff(path, prepend=-1) != 0) | (np.diff(text_of, prepend=-1) != 0))
    last = np.append(turn[1:], len(path)) - 1
    cuts = starts_of(np.bincount(text_of[turn], minlength=n_texts))
    names = np.array(model.langs, object)[path[turn]]
    begin, end = place[turn], place[last] + 1
    split = [slice(cuts[i], cuts[i + 1]) for i in range(n_texts)]
    return langs, score, [names[s] for s in split], [begin[s] for s in split], [end[s] for s in split]


def identify(docs: DataFrame, model: Model, keep: list[str], switch: float = SWITCH) -> DataFrame:
    """Add language, confidence and spans to the columns ``keep``.

    ``docs`` has a column ``text``; other columns are ignored. ``lang_pred`` is a language of
    the model, ``score`` the share of letters in its spans. ``span_lang``, ``span_start`` and
    ``span_end`` (words, end exclusive) are arrays with one entry per span. A NULL, empty or
    letterless text gives ``und``, 0.0 and no spans, and so does a model without languages.
    """
    inside = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized(batches, PIECE):
            langs, score, names, begin, end = _label(inside.value, switch, batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep]
                + [
                    pa.array(langs, pa.string()),
                    pa.array(score, pa.float64()),
                    pa.array(names, pa.list_(pa.string())),
                    pa.array(begin, pa.list_(pa.int32())),
                    pa.array(end, pa.list_(pa.int32())),
                ],
                names=[*keep, "lang_pred", "score", "span_lang", "span_start", "span_end"],
            )

    added = "lang_pred string, score double, span_lang array<string>, span_start array<int>, span_end array<int>"
    out = extended(docs, keep, added)
    return docs.select(*[c for c in keep if c != "text"], "text").mapInArrow(run, out)


def remainder(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; NULL for a NULL id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts
