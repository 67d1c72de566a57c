import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from edge import LONG, TEXTS, ascii_lower, table

from trawlnet.deploy import ship
from trawlnet.llm import collocations as C


def expected(rows, least, inside=80, best=2000):
    """Every phrase counted one by one, in exact arithmetic."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", ascii_lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in (1, 2, 3, 4) for i in range(len(w) - k + 1))
    found = defaultdict(list)
    candidates = {(lang, g): a for (lang, g), a in f.items() if len(g) > 1 and a >= least}
    for (lang, g), a in candidates.items():
        around = (x for (o, h), x in candidates.items() if o == lang and len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(4)))
        if any(100 * x >= inside * a for x in around):
            continue
        cuts = [(f[lang, g[:k]], f[lang, g[k:]]) for k in range(1, len(g))]
        score, _, (left, right) = min((2000000 * a // (x + y), k, (x, y)) for k, (x, y) in enumerate(cuts))
        found[lang].append((-score, -a, " ".join(g).encode(), left, right))
    return [
        (lang, i + 1, g.decode(), -a, left, right, n[lang], -s)
        for lang, held in found.items()
        for i, (s, a, g, left, right) in enumerate(sorted(held)[:best])
    ]


def check(spark, rows, least, **more):
    ship(spark)
    df = spark.createDataFrame([(*r, 1, "x", 2, b"") for r in rows], "lang string, text string, a int, phrase string, n int, held binary")
    found = C.collocations(df, least, **more)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, found.collect())) == sorted(expected(rows, least, best=more.get("best", 2000)))


def drawn(seed, n, words=9):
    draw = random.Random(seed)
    marks = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", " ; "]
    word = [f"{chr(97 + i)}É" if i % 3 else chr(65 + i) for i in range(words)]
    return [
        (draw.choice(["en", "fr", None, "und"]), "".join(draw.choice(word) + draw.choice(marks) for _ in range(draw.randrange(60))))
        for _ in range(n)
    ]


def test_phrases_equal_counting_one_by_one(spark):
    check(spark, drawn(1, 400), 8)
    check(spark, drawn(2, 400), 30, best=3)


def test_many_ranges_and_a_word_that_begins_most_rows(spark):
    rows = drawn(3, 300) + [("en", "the " + f"the w{i % 7} the of of " * 3) for i in range(200)] + [("en", "all rights reserved by the")] * 100
    check(spark, rows, 5, range_bytes=300)
    check(spark, rows[:50], 1, range_bytes=20)


def test_odd_rows(spark):
    check(spark, [(None if i is None else "en", t) for i, t in TEXTS if t is None or not t.startswith(LONG)], 2)
    check(spark, [], 1)
    check(spark, [("en", None), (None, ""), ("fr", " . ; ")], 1)
    check(spark, [("e\nn", "a b"), ("e", "n a b"), ("", "a b a b"), ("en", "x" * 100 + " " + "y" * 100)] * 3, 1, range_bytes=10)


def test_long_text(spark):
    ship(spark)
    found = C.collocations(table(spark, [(1, LONG), (2, LONG)]))
    assert found.count() > 0


@pytest.mark.parametrize("seed", range(5))
def test_transducers(seed):
    rng = np.random.default_rng(seed)
    words, parts, sums = [f"w{i:03}é" for i in range(30)], [], Counter()
    for _ in range(4):
        n = int(rng.integers(1, 400))
        rows, weights = C.counted(C.rows_of(rng.integers(1, 31, n) % rng.integers(2, 31) + 1, np.sort(rng.integers(0, 40, n))))
        held = C.Transducer.of(rows, weights)
        back = C.Transducer.from_bytes(held.to_bytes())
        got = back.rows()
        assert np.array_equal(got[0], rows) and np.array_equal(got[1], weights)
        assert np.array_equal(back.weights(rows), weights)
        assert not back.weights(rows[::-1] + 40).any()
        assert sum(map(len, held.labels)) <= sum(len(np.unique(rows[:k], axis=1).T) for k in (1, 2, 3, 4))
        used = np.unique(rows[rows > 0])
        packed = C._packed(pa.array(words), rows, weights)
        parts.append(C._unpacked(*packed))
        assert len(used)
        for row, w in zip(rows.T, weights, strict=True):
            sums[tuple(words[x - 1] if x else "" for x in row)] += int(w)
    vocabulary, rows, weights = C.union(parts)
    names = ["", *vocabulary.to_pylist()]
    assert {tuple(names[x] for x in row): int(w) for row, w in zip(rows.T, weights, strict=True)} == sums


def test_states_with_equal_arcs_are_one():
    rows = np.array([[i, 100, 101, 102] for i in range(1, 51)]).T
    held = C.Transducer.of(rows, np.ones(50, np.int64))
    assert [len(x) for x in held.labels] == [50, 1, 1, 1]
