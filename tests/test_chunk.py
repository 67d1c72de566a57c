import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trawlnet.operators import chunk as chunking
from trawlnet.operators.chunk import split_text


def brute(text, size, overlap, separators=("\n\n", "\n", " ", "")):
    """The same rules, written the slow and plain way: rebuild every window from scratch."""
    here = [s for s in separators if s in text][0]
    finer = separators[separators.index(here) + 1 :]
    if here:
        pieces = [p for p in re.split(f"(?={re.escape(here)})", text) if p]
        joined = []
        for piece in pieces:  # a run of separators is cut from the left
            while piece.startswith(here) and piece.find(here, len(here)) > 0:
                cut = piece.find(here, len(here))
                joined.append(piece[:cut])
                piece = piece[cut:]
            joined.append(piece)
        pieces = joined
    else:
        pieces = list(text)
    out, run = [], []

    def flush():
        start = 0
        for end in range(len(run)):
            taken = run[start:end]
            if sum(map(len, taken)) + len(run[end]) > size:
                out.append("".join(taken))
                while start < end and (
                    sum(map(len, run[start:end])) > overlap
                    or sum(map(len, run[start : end + 1])) > size
                ):
                    start += 1
        out.append("".join(run[start:]))
        run.clear()

    for piece in pieces:
        if len(piece) < size:
            run.append(piece)
        else:
            flush()
            out.extend(brute(piece, size, overlap, finer) if finer else [piece])
    flush()
    return [c.strip() for c in out if c.strip()]


texts = st.text(alphabet="ab \n\t", max_size=120)


@settings(max_examples=300, deadline=None)
@given(texts, st.integers(2, 30), st.integers(0, 30))
def test_equals_brute_force(text, size, overlap):
    overlap = min(size, overlap)
    text = re.sub("\n{3,}", "\n\n", text)
    if text:
        assert split_text(text, size, overlap) == brute(text, size, overlap)


@settings(max_examples=200, deadline=None)
@given(texts, st.integers(2, 30))
def test_nothing_is_lost_without_overlap(text, size):
    chunks = split_text(text, size, 0)
    assert all(0 < len(c) <= size for c in chunks)
    assert "".join("".join(chunks).split()) == "".join(text.split())


def test_short_text_is_one_chunk():
    assert split_text("  hello there \n", 100, 10) == ["hello there"]
    assert split_text("   ", 100, 10) == []
    assert split_text("", 100, 10) == split_text(None, 100, 10) == []


def test_text_as_long_as_the_size():
    assert split_text("ab cd", 5, 0) == ["ab cd"]


def test_one_long_word():
    chunks = split_text("x" * 5000, 2000, 100)
    assert [len(c) for c in chunks] == [2000, 2000, 1200]


def test_paragraphs_come_before_lines():
    assert split_text("aaa\nbbb\n\nccc\nddd", 10, 0) == ["aaa\nbbb", "ccc\nddd"]


def test_overlap_carries_whole_pieces():
    assert split_text("aa bb cc dd", 6, 3) == ["aa bb", "bb cc", "cc dd"]


def test_no_word_is_lost_with_overlap():
    rng = random.Random(1)
    words = [f"w{i}{'y' * rng.randint(0, 12)}" for i in range(3000)]
    text = "".join(w + rng.choice([" ", "\n", "\n\n", "  "]) for w in words)
    for size, overlap in ((2000, 100), (200, 20), (50, 10)):
        chunks = split_text(text, size, overlap)
        assert all(len(c) <= size for c in chunks)
        assert {w for c in chunks for w in c.split()} == set(words)


def test_overlap_larger_than_size_is_an_error():
    with pytest.raises(ValueError):
        chunking.split_column(10, 11)


def test_chunk_operator(spark):
    rows = [("1", "1999", "section_1", "aa bb cc dd"), ("1", "2000", "section_2", None)]
    df = spark.createDataFrame(rows, "cik string, year string, section string, description string")
    got = chunking.chunk(df, size=6, overlap=3).orderBy("chunk_id").collect()
    assert [r.chunk for r in got] == ["aa bb", "bb cc", "cc dd"]
    assert got[0].chunk_id == "1/1999/section_1/00000000"
    assert got[0].asDict().keys() == {"cik", "year", "section", "position", "chunk", "chunk_id"}
