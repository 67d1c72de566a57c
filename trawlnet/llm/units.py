"""Token ids of whole corpora: texts are cut at blanks, and every distinct stretch is encoded once.

A byte-level tokenizer cuts a text where a blank follows something that is no white space, and
merges nothing across such a cut. So a text is a row of units, each a stretch between two such
blanks, and the ids of a batch are those of its distinct units.
"""

from __future__ import annotations

import json
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa

from trawlnet.llm.windows import ranges, starts_of

# Fixed value: how the byte-level tokenizer cuts a text before it merges bytes. No merge
# crosses a cut, so the ids of a text are those of its cuts.
CUTS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG = 1000  # bytes of a unit from which on the slower library with bounded time encodes it


def _is_word_end(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the bytes at these places end a character that is surely no white space."""
    last = raw[at]
    before = raw[np.maximum(at - 1, 0)]
    third = raw[np.maximum(at - 2, 0)]
    odd = (before == 0xC2) | ((third >= 0xE1) & (third <= 0xE3))
    return ((last > 0x20) & (last < 0x7F)) | ((last >= 0x80) & ~odd)


def cut_units(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All units of a batch without NULLs, dictionary encoded, and their number per text."""
    texts = texts.cast(pa.string())
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if not len(texts) or ends[-1] == ends[0]:
        return pa.array([], pa.string()).dictionary_encode(), np.zeros(len(texts), np.int64)
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    blanks = np.flatnonzero(raw == 0x20)
    blanks = blanks[blanks > 0]
    blanks = blanks[_is_word_end(raw, blanks - 1)]
    begins = np.zeros(len(raw), bool)
    begins[blanks] = True
    begins[ends[:-1][np.diff(ends) > 0]] = True
    starts = np.flatnonzero(begins)
    counts = np.diff(np.searchsorted(starts, ends))
    places = pa.py_buffer(np.append(starts, len(raw)).astype(np.int32))
    units = pa.StringArray.from_buffers(len(starts), places, pa.py_buffer(raw))
    return units.dictionary_encode(), counts


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    found = {chr(b): b for b in plain}
    rest = (b for b in range(256) if b not in set(plain))
    return found | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """A byte-level vocabulary; text in the form of its added tokens is plain text if ``plain``."""

    def __init__(self, path: str, plain: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        added = self.tokenizer.get_added_tokens_decoder()
        self.added = [] if plain else [t.content for t in added.values()]
        if any(" " in token for token in self.added):
            raise ValueError("an added token with a blank: texts cannot be cut at blanks")
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        byte_of = _byte_of()
        self.bytes = [b""] * (max(max(vocabulary.values()), *added, 0) + 1)
        for token, i in vocabulary.items():
            if i not in added:
                self.bytes[i] = bytes(byte_of[c] for c in token)
        for i, token in added.items():
            self.bytes[i] = token.content.encode()
        self.sizes = np.array([len(b) for b in self.bytes], np.int64)
        self.fast = self._ranked({self.bytes[i]: i for i in vocabulary.values() if i not in added})

    def _ranked(self, ranks: dict[bytes, int]):
        """The same vocabulary in a faster library, if its ids are in the order of the merges."""
        import tiktoken

        model = json.loads(self.tokenizer.to_str())["model"]
        merged = [a + b for a, b in model["merges"]]
        order = [model["vocab"].get(m, -1) for m in merged]
        if any(a >= b for a, b in zip(order, order[1:], strict=False)) or len({*order}) < len(order):
            return None
        return tiktoken.Encoding("bytes", pat_str=CUTS, mergeable_ranks=ranks, special_tokens={})

    def _slowly(self, units: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]

    def encode(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units in one array, and their number per unit."""
        n = len(units)
        if not n:
            return np.empty(0, np.int64), np.zeros(0, np.int64)
        texts = units.to_pylist()
        _, offsets, data = units.buffers()
        ends = np.frombuffer(offsets, np.int32)[units.offset : units.offset + n + 1].astype(np.int64)
        raw = np.frombuffer(data, np.uint8)
        size = np.diff(ends)
        # those that begin with a blank and end with none can be encoded as one long text
        one = np.zeros(n, bool)
        if self.fast is not None:
            full = np.flatnonzero((size > 1) & (size <= LONG))
            one[full] = (raw[ends[full]] == 0x20) & _is_word_end(raw, ends[full + 1] - 1)
        for token in self.added:
            one &= np.array([token not in t for t in texts])
        rest = np.flatnonzero(~one)
        slow = self._slowly([texts[i] for i in rest]) if len(rest) else []
        together = np.flatnonzero(one)
        ids = np.empty(0, np.int64)
        if len(together):
            joined = "".join(texts) if len(together) == n else "".join([texts[i] for i in together])
            ids = np.array(self.fast.encode_ordinary(joined), np.int64)
        counts = np.zeros(n, np.int64)
        till = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum(size[together])) + 1
        counts[together] = np.diff(till, prepend=0)
        counts[rest] = [len(x) for x in slow]
        first = starts_of(counts)[:-1]
        out = np.empty(int(counts.sum()), np.int64)
        out[np.repeat(first[together], counts[together]) + ranges(counts[together])] = ids
        out[np.repeat(first[rest], counts[rest]) + ranges(counts[rest])] = list(chain.from_iterable(slow))
        return out, counts


class Pieces:
    """A vocabulary of pieces with a blank before every word.

    Units begin with the blank that it adds. No piece may hold a blank behind a letter.
    """

    _BLANK = "▁"

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(n)]
        if any(self._BLANK in p.lstrip(self._BLANK) for p in pieces):
            raise ValueError("pieces with a blank behind a letter: texts cannot be cut at blanks")
        self.blank = self.model.piece_to_id(self._BLANK)
        self.bytes = [
            bytes([int(p[1:-1], 16)]) if self.model.is_byte(i) else p.replace(self._BLANK, " ").encode()
            for i, p in enumerate(pieces)
        ]
        self.sizes = np.array([len(b) for b in self.bytes], np.int64)

    def encode(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units, which begin with a blank, in one array, and their number per unit."""
        texts = units.to_pylist()
        found = self.model.encode([t[1:] for t in texts], num_threads=1)
        found = [f or [self.blank] for f in found]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int64, int(counts.sum())), counts


@lru_cache(4)
def byte_level(path: str, plain: bool = False) -> ByteLevel:
    return ByteLevel(path, plain)


@lru_cache(2)
def piece_model(path: str) -> Pieces:
    return Pieces(path)
