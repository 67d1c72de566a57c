import random

import pytest

from trawlnet.deploy import ship
from trawlnet.operators import relevance
from trawlnet.operators.relevance import containing_chunks

CHUNKS = [
    "the cat sat on the mat",
    "The cat sat on the mat",
    "the cat  sat on the mat",
    "a cat sat",
    "concatenate",
    "x\ny z\n\nend of file",
    "no\xa0break space here",
    "",
    None,
]
PASSAGES = [
    "cat sat on the",  # two inner words
    "cat sat on",  # one inner word
    "he cat sat on the m",  # both ends inside words
    "cat sat",  # two words: no inner one
    "at",  # a piece of a word
    "c",
    "ncatenat",
    "x\ny z",
    "y z\n\nend",
    "no\xa0break space",
    "\xa0break",
    "sat ",
    " on the ",
    "cat  sat",
    "dog",
    "",
    "   ",
    None,
]


def frames(spark, passages, chunks):
    gold = spark.createDataFrame(list(enumerate(passages)), "query_id int, full_sentence string")
    rows = spark.createDataFrame(list(enumerate(chunks)), "chunk_id int, chunk string")
    return gold, rows.repartition(3)


def brute(passages, chunks):
    return sorted(
        (i, j)
        for i, p in enumerate(passages)
        for j, c in enumerate(chunks)
        if p and p.strip() and c and p in c
    )


@pytest.fixture(params=["one block", "many blocks"])
def path(request, spark, monkeypatch):
    ship(spark)
    if request.param == "many blocks":
        monkeypatch.setattr(relevance, "BLOCK_PASSAGES", 4)


def found(gold, chunks):
    return sorted((r.query_id, r.chunk_id) for r in containing_chunks(gold, chunks).collect())


def test_every_kind_of_passage(spark, path):
    gold, chunks = frames(spark, PASSAGES, CHUNKS)
    assert found(gold, chunks) == brute(PASSAGES, CHUNKS)


def test_each_kind_alone(spark, path):
    for passage in ("cat sat on the", "sat on the", "at", "zz"):
        gold, chunks = frames(spark, [passage], CHUNKS)
        assert found(gold, chunks) == brute([passage], CHUNKS)


def test_random_cuts(spark, path):
    rng = random.Random(5)
    words = ["ab", "abc", "b", "ca", "bca", "a"]
    gaps = [" ", "  ", "\n", "\t", "　"]
    make = lambda n: "".join(rng.choice(words) + rng.choice(gaps) for _ in range(n))
    chunks = [make(rng.randint(1, 30)) for _ in range(60)]
    passages = []
    for _ in range(60):
        source = rng.choice(chunks)
        start = rng.randrange(len(source))
        passages.append(source[start : start + rng.randint(1, 20)])
    gold, rows = frames(spark, passages, chunks)
    assert found(gold, rows) == brute(passages, chunks)


def test_no_passages(spark, path):
    gold, chunks = frames(spark, PASSAGES, CHUNKS)
    assert found(gold.where("query_id < 0"), chunks) == []


def test_many_passages_and_no_shuffle_of_texts(spark, capsys):
    ship(spark)
    n = 200_000
    passages = spark.range(n).selectExpr("id AS query_id", "concat('all begin alike, then ', id, ' and they end alike') AS full_sentence")
    chunks = spark.range(400).selectExpr(
        "id AS chunk_id", "concat('here all begin alike, then ', id * 499, ' and they end alike or ', id, ' and they') AS chunk"
    )
    pairs = containing_chunks(passages, chunks)
    pairs.explain()
    assert "Exchange" not in capsys.readouterr().out
    assert sorted((r.query_id, r.chunk_id) for r in pairs.collect()) == [(i * 499, i) for i in range(400)]


def test_anchors_are_rare_stretches():
    passages = ["the same beginning " + end for end in ("of one text", "of two texts")] + ["short", "the same beginning "]
    found = relevance.anchors(passages)
    assert all(p[at : at + len(a)] == a and len(a) <= relevance.ANCHOR for p, (at, a) in zip(passages, found, strict=True))
    assert found[0][1] not in passages[1] and found[1][1] not in passages[0] and found[2] == (0, "short")
