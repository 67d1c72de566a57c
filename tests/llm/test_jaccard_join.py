import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from edge import TEXTS, ascii_lower, key, table, words

from trawlnet.deploy import ship
from trawlnet.llm import jaccard_join
from trawlnet.llm.components import components
from trawlnet.llm.jaccard_join import near_duplicates


def shingles(text):
    w = words(ascii_lower(text))
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(a & b)
            if a and b and 100 * both >= 80 * len(a | b):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    out = []
    for i, (doc_id, _) in enumerate(rows):
        # a row without an id belongs to a group, but is not an id that links reach
        ids = [rows[j][0] for j in range(len(rows)) if group[j] == group[i] and rows[j][0] is not None]
        own = doc_id if not sets[i] else min(ids, default=None)
        out.append((doc_id, len(sets[i]), own))
    return sorted(out, key=key)


def got(spark, rows):
    ship(spark)
    found = near_duplicates(table(spark, rows)).select("doc_id", "n_shingles", "component_id")
    return sorted((tuple(r) for r in found.collect()), key=key)


def test_odd_rows(spark):
    assert got(spark, TEXTS) == brute(TEXTS)


def test_no_rows(spark):
    assert got(spark, []) == []


@pytest.mark.parametrize("seed", range(2))
def test_chains_of_near_copies(spark, seed):
    """Copies of copies, each with a few words changed, so that links form long paths."""
    draw = random.Random(seed)
    rows = []
    for start in range(6):
        text = [f"w{draw.randrange(50)}" for _ in range(draw.choice([5, 30, 80, 200]))]
        for step in range(12):
            rows.append((start * 100 + step, " ".join(text)))
            for _ in range(max(1, len(text) // draw.choice([20, 45, 80]))):
                text[draw.randrange(len(text))] = f"w{draw.randrange(50)}"
    draw.shuffle(rows)
    assert got(spark, rows) == brute(rows)


def test_one_shingle_below_the_bound(spark):
    base = [f"a{i}" for i in range(49)]  # 45 shingles; 5 changed give 40 of 50
    rows = [(1, " ".join(base)), (2, " ".join([*base[:44], *(f"b{i}" for i in range(5))])), (3, " ".join(base[:40]))]
    assert got(spark, rows) == brute(rows)


def test_components(spark):
    edges = [(i + 1, i) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 100), (None, 1)]
    found = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 200: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_copies_that_are_near_their_source_only(spark, monkeypatch):
    """Few of the pairs of copies are compared: their bitmaps tell most of them apart."""
    ship(spark)
    draw, made = random.Random(9), []
    source = [f"s{i}" for i in range(200)]
    rows = [(0, " ".join(source))]
    for i in range(1, 600):
        text = list(source)
        for j, part in enumerate(range(10, 190, 60)):
            text[part + draw.randrange(50)] = f"x{i}y{j}"
        rows.append((i, " ".join(text)))

    def noted(df, label):
        out = original(df, label)
        made.append((label, out.count()))
        return out

    original = jaccard_join.materialize
    monkeypatch.setattr(jaccard_join, "materialize", noted)
    found = near_duplicates(table(spark, rows)).select("component_id").distinct().collect()
    assert [r["component_id"] for r in found] == [0]
    assert max(n for label, n in made if label in ("pairs", "best", "neighbours")) < len(rows) ** 2 / 2 / 10


def test_bitmaps_bound_the_overlap():
    rng = np.random.default_rng(1)
    for n in (1, 5, 200, 3000):
        x = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
        y = np.unique(np.concatenate([x[: n // 2], rng.integers(0, 1 << 63, n // 2 + 1, np.uint64)]))
        one, other = (np.frombuffer(jaccard_join._parity(s), np.uint64) for s in (x, y))
        assert int(np.bitwise_count(one ^ other).sum()) <= len(np.setxor1d(x, y))


def test_copies_near_each_other_leave_few_rows(spark, monkeypatch):
    """Each copy is joined with the closest one first; the lists give away few pairs after that."""
    ship(spark)
    draw = random.Random(4)
    source = [f"s{i}" for i in range(150)]
    rows = []
    for i in range(500):
        text = list(source)
        for part in draw.sample(range(5), 3):
            text[15 + part * 30 + draw.randrange(4)] = f"x{draw.randrange(8)}"
        rows.append((i, " ".join(text)))
    made = spark.sparkContext.accumulator(0)
    original = jaccard_join._merge_lists

    def noted(*args):
        run = original(*args)

        def counting(batches):
            for batch in run(batches):
                made.add(batch.num_rows)
                yield batch

        return counting

    monkeypatch.setattr(jaccard_join, "_merge_lists", noted)
    assert got(spark, rows) == brute(rows)
    assert made.value < 20_000


def test_merging_lists_takes_little_memory():
    """An entry needs little more than itself and its bitmap, whatever number of pairs there is."""
    n, rng = 1 << 17, np.random.default_rng(2)
    columns = {
        "h": np.repeat(np.arange(n // 64), 64),
        "sig": rng.integers(0, 1 << 62, n),
        "packed": np.full(n, 100 << 32),
        "cluster": np.arange(n),
        "bits": [rng.bytes(jaccard_join.BITS // 8) for _ in range(n)],
    }
    batches = pa.table(columns).to_batches(max_chunksize=2000)
    del columns
    tracemalloc.start()
    try:
        assert sum(b.num_rows for b in jaccard_join._merge_lists(80, False)(iter(batches))) == 0
        assert tracemalloc.get_traced_memory()[1] < 300 * n
    finally:
        tracemalloc.stop()


def test_worker_hashes_a_piece_at_a_time(spark, monkeypatch):
    """What a worker holds of the words and shingles of a batch does not grow with batches up to 3 MB."""
    docs, ran = table(spark), []
    monkeypatch.setattr(jaccard_join, "_long_lists", lambda *_: np.empty(0, np.uint64))
    monkeypatch.setattr(type(docs), "mapInArrow", lambda _, run, schema: ran.append(run))
    jaccard_join._described(docs, 5, 80, 0)
    draw = np.random.default_rng(3)
    names = np.array([f"w{i}" for i in range(500)])
    texts = pa.array([" ".join(names[draw.integers(0, 500, 100)]) for _ in range(5500)])
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(5500)), pa.array(np.arange(5500)), texts], names=["doc_id", "key", "text"])
    assert 2 << 20 < texts.nbytes < 3 << 20
    tracemalloc.start()
    try:
        rows = sum(b.num_rows for b in ran[0](iter([batch])))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == 5500 and most < 20_000_000, most
