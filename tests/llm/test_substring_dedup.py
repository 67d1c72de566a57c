import random

from edge import PASSAGE, TEXTS, key, table, words

from trawlnet.deploy import ship
from trawlnet.llm import substring_dedup
from trawlnet.llm.substring_dedup import _pack, _unpack, remove_repeats


def brute(rows, length):
    first = {}
    for doc_id, text in rows:
        w = words(text)
        for i in range(len(w) - length + 1 if doc_id is not None else 0):
            g = tuple(w[i : i + length])
            first[g] = min(first.get(g, doc_id), doc_id)
    out = []
    for doc_id, text in rows:
        w = words(text)
        left = [True] * len(w)
        for i in range(len(w) - length + 1 if doc_id is not None else 0):
            if first[tuple(w[i : i + length])] < doc_id:
                left[i : i + length] = [False] * length
        kept = [x for x, ok in zip(w, left, strict=True) if ok]
        out.append((doc_id, len(w), len(w) - len(kept), " ".join(kept)))
    return sorted(out, key=key)


def got(spark, rows, length=50):
    ship(spark)
    found = remove_repeats(table(spark, rows), length=length)
    return sorted((tuple(r) for r in found.select("doc_id", "n_words", "n_removed", "kept").collect()), key=key)


def test_odd_rows(spark):
    assert got(spark, TEXTS) == brute(TEXTS, 50)


def test_no_rows(spark):
    assert got(spark, []) == []


def test_passages_at_any_offset(spark):
    draw = random.Random(1)
    passages = [[f"p{draw.randrange(9)}" for _ in range(draw.randrange(6, 40))] for _ in range(8)]
    rows = []
    for doc_id in range(120):
        text = []
        for _ in range(draw.randrange(4)):
            text += [f"u{draw.randrange(2000)}" for _ in range(draw.randrange(12))] + draw.choice(passages)
        rows.append((doc_id * 3 % 120, " ".join(text)))
    for length in (8, 9):
        assert got(spark, rows, length) == brute(rows, length)


def test_frequent_windows(spark, monkeypatch):
    """What the sample takes for frequent does not change the result."""
    rows = [(i, f"u{i} v{i} {PASSAGE}") for i in range(60)] + [(100 + i, f"{PASSAGE} u{i}") for i in range(3)]
    assert got(spark, rows) == brute(rows, 50)
    monkeypatch.setattr(substring_dedup, "HOT_SAMPLE", 0)
    assert got(spark, rows) == brute(rows, 50)


def test_columns_are_carried(spark):
    ship(spark)
    found = remove_repeats(table(spark), ["doc_id", "text", "lang", "score"])
    assert found.columns == ["doc_id", "text", "lang", "score", "n_words", "n_removed", "kept"]
    assert found.where("text is not null").count() == sum(t is not None for _, t in TEXTS)


def test_gaps_round_trip():
    import numpy as np

    for top in (2, 254, 255, 256, 65_534, 65_535, 65_536, 10_000_000):
        gaps = np.random.default_rng(top).integers(0, top, 500)
        assert (_unpack(_pack(gaps)) == gaps).all()
        both = np.array([top, 0, top - 1])
        assert (_unpack(_pack(both)) == both).all()
