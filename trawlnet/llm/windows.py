"""Words and hashes of word windows of many texts at once, in numpy, inside Arrow batches.

A batch of texts becomes one flat array of words; windows are hashed with a handful of
array operations, whatever the number of texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_P = np.uint64(0x9E3779B97F4A7C15)
_M = 0xA0761D6478BD642F
_BYTES = 1 << 19  # bytes of words hashed at a time; about 30 times as much memory


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the entropy of 64-bit values over all bits (a bijection)."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(32))
        h = h * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        h = h * np.uint64(0x9FB21C651E98DF25)
        return h ^ (h >> np.uint64(32))


def ascii_words(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """Runs of characters other than ASCII white space (space, 9 to 13), in one flat array.

    Also the number in each text. ``lower`` changes A-Z only. NULL and blank texts have none.
    """
    texts = pc.fill_null(texts.cast(pa.string()), "")
    trimmed = pc.ascii_trim_whitespace(pc.ascii_lower(texts) if lower else texts)
    lists = pc.ascii_split_whitespace(trimmed)
    blank = pc.equal(trimmed, "").to_numpy(zero_copy_only=False)
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False) - blank
    flat = lists.flatten()
    if blank.any():
        flat = flat.filter(pc.not_equal(flat, ""))
    return flat, lengths.astype(np.int64)


def starts_of(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def word_hashes(flat: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of every (non-empty) word: a polynomial over its bytes, mixed."""
    n = len(flat)
    if n == 0:
        return np.empty(0, np.uint64)
    _, offsets, data = flat.buffers()
    ends = np.frombuffer(offsets, np.int32)[flat.offset : flat.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)
    longest = int(np.diff(ends).max())
    with np.errstate(over="ignore"):
        base = _P + np.uint64(2 * seed)
        powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(longest, base)]).astype(np.uint64))
        out = np.empty(n, np.uint64)
        at = 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + _BYTES, side="right")) - 1)
            first, last = ends[at], ends[to]
            sizes = np.diff(ends[at : to + 1])
            place = np.arange(last - first) - np.repeat(ends[at:to] - first, sizes)
            values = (raw[first:last].astype(np.uint64) + np.uint64(1)) * powers[place]
            out[at:to] = np.add.reduceat(values, ends[at:to] - first)
            at = to
    return mix(out)


def window_hashes(words: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of the ``k`` words from each position on; the last k - 1 positions have none.

    Windows are hashed over the whole array: pick those inside one text with ``window_starts``.
    """
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        base = (_M + 2 * seed) % (1 << 64)
        total, width = None, 0
        power, size = words, 1  # power: hash of the ``size`` words from each position on
        rest = k
        while rest:
            if rest & 1:
                part = power[width : width + n] if width else power[:n]
                factor = np.uint64(pow(base, size, 1 << 64))
                total = part.copy() if total is None else total * factor + part
                width += size
            rest >>= 1
            if rest:
                factor = np.uint64(pow(base, size, 1 << 64))
                power = power[: len(power) - size] * factor + power[size:]
                size *= 2
    return mix(total)


def window_starts(lengths: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, position in the flat array) of every window of ``k`` words within one text."""
    counts = np.maximum(lengths - k + 1, 0)
    text = np.repeat(np.arange(len(lengths)), counts)
    first = np.repeat(starts_of(lengths)[:-1], counts)
    return text, first + ranges(counts)


def ranges(counts: np.ndarray) -> np.ndarray:
    """0 .. c-1 for every count c, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)
