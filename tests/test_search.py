"""Batch retrieval against a plain loop over all pairs."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from trawlnet.operators import lexical, search

WORDS = [f"w{i}" for i in range(30)]
YEARS = ["1999", "2000", "2001"]


def make_corpus(seed, n=60, dim=5):
    rng = random.Random(seed)
    chunks = []
    for i in range(n):
        # w0 stands in nearly every chunk, so that its idf is negative
        body = ["W0"] * (rng.random() < 0.9) + rng.choices(WORDS[1:], k=rng.randint(0, 12))
        vector = [0.0] * dim if i % 17 == 3 else [rng.gauss(0, 1) for _ in range(dim)]
        chunks.append((f"c{i:03d}", rng.choice(YEARS), " ".join(body), vector))
    chunks.append(("c900", "1999", chunks[0][2], chunks[0][3]))  # a copy: scores tie
    return chunks


def make_queries(seed, n=9, dim=5):
    rng = random.Random(seed)
    filters = [[], ["1999"], ["2000", "1999", "2000"], ["1066"], None]
    return [
        (
            i,
            " ".join(rng.choices(WORDS, k=4) + ["W0", "unknown", "w0"]),
            filters[i % 5],
            [rng.gauss(0, 1) for _ in range(dim)],
        )
        for i in range(n)
    ]


def okapi(prompt, chunks):
    docs = [c[2].lower().split() for c in chunks]
    n, average = len(docs), sum(map(len, docs)) / len(docs) or 1.0
    df = {}
    for doc in docs:
        for term in set(doc):
            df[term] = df.get(term, 0) + 1
    idf = {t: math.log(n - f + 0.5) - math.log(f + 0.5) for t, f in df.items()}
    mean = sum(idf.values()) / len(idf) if idf else 0.0
    idf = {t: 0.25 * mean if v < 0 else v for t, v in idf.items()}
    scores = []
    for doc in docs:
        total = 0.0
        for term in prompt.lower().split():
            tf = doc.count(term)
            total += idf.get(term, 0) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(doc) / average))
        scores.append(total)
    return np.array(scores)


def cosine(vector, chunks):
    out = []
    for chunk in chunks:
        norm = np.linalg.norm(vector) * np.linalg.norm(chunk[3])
        out.append(np.dot(vector, chunk[3]) / norm if norm else np.nan)
    return np.array(out)


def scaled(x):
    low, high = np.nanmin(x), np.nanmax(x)
    return (x - low) / (high - low) if high > low else x * 0.0


def best(scores, chunks, k):
    keyed = [(-round(s, 9) if s == s else math.inf, c[0], s) for s, c in zip(scores, chunks)]
    return [(i, None if s != s else round(s, 8)) for _, i, s in sorted(keyed)[:k]]


def expected(queries, chunks, k, score):
    out = {}
    for qid, prompt, years, vector in queries:
        mine = [c for c in chunks if not years or c[1] in years]
        if mine:
            out[qid] = best(score(prompt, vector, mine), mine, k)
    return out


def collected(hits, *keys):
    out = {}
    for row in sorted(hits.collect(), key=lambda r: r["rank"]):
        key = row[keys[0]] if len(keys) == 1 else tuple(row[k] for k in keys)
        score = None if row.score is None else round(row.score, 8)
        out.setdefault(key, []).append((row.chunk_id, score))
        assert row["rank"] == len(out[key])
    return out


def frames(spark, queries, chunks):
    q = spark.createDataFrame(
        queries, "query_id long, prompt string, years array<string>, vector array<double>"
    )
    c = spark.createDataFrame(
        chunks, "chunk_id string, year string, chunk string, embedding array<double>"
    )
    return q, c.repartition(5)


@pytest.fixture(params=["usual", "small pieces"])
def sizes(request, monkeypatch):
    if request.param == "small pieces":
        monkeypatch.setattr(search, "BLOCK_BYTES", 2000)


@pytest.mark.parametrize("k", [1, 7, 500])
def test_sparse(spark, sizes, k):
    queries, chunks = make_queries(1), make_corpus(2)
    q, c = frames(spark, queries, chunks)
    got = collected(search.search_sparse(q, c, k), "query_id")
    assert got == expected(queries, chunks, k, lambda p, v, m: okapi(p, m))


def test_dense(spark, sizes):
    queries, chunks = make_queries(3), make_corpus(4)
    q, c = frames(spark, queries, chunks)
    got = collected(search.search_dense(q, c, 70), "query_id")
    assert got == expected(queries, chunks, 70, lambda p, v, m: cosine(v, m))


def test_hybrid(spark, sizes):
    queries, chunks = make_queries(5), make_corpus(6)
    q, c = frames(spark, queries, chunks)
    alphas = [0.0, 0.3, 1.0]
    got = collected(search.search_hybrid(q, c, 8, alphas), "query_id", "alpha")
    for alpha in alphas:
        want = expected(
            queries,
            chunks,
            8,
            lambda p, v, m, a=alpha: a * scaled(cosine(v, m)) + (1 - a) * scaled(okapi(p, m)),
        )
        assert {q: rows for (q, a), rows in got.items() if a == alpha} == want


def test_only_some_years_asked(spark):
    queries = [(i, p, ["2000"] if i % 2 else ["1999", "2000"], v) for i, p, _, v in make_queries(1)]
    chunks = make_corpus(2)
    q, c = frames(spark, queries, chunks)
    got = collected(search.search_sparse(q, c, 6), "query_id")
    assert got == expected(queries, chunks, 6, lambda p, v, m: okapi(p, m))


def test_stored_statistics_give_the_same(spark):
    q, c = frames(spark, make_queries(7), make_corpus(8))
    stored = lexical.year_statistics(c)
    fresh, kept = search.search_sparse(q, c, 5), search.search_sparse(q, c, 5, stored)
    assert sorted(fresh.collect()) == sorted(kept.collect())


def test_no_known_term_leaves_the_choice_to_the_vectors(spark):
    chunks = make_corpus(9)
    q, c = frames(spark, [(1, "nothing known", [], [1.0, 0.0, 0.0, 0.0, 0.0])], chunks)
    hybrid = [i for i, _ in collected(search.search_hybrid(q, c, 5), "query_id")[1]]
    dense = [i for i, _ in collected(search.search_dense(q, c, 5), "query_id")[1]]
    assert hybrid == dense


def test_corpus_of_one_chunk(spark):
    q, c = frames(spark, [(1, "w1", [], [1.0])], [("a", "1999", "w1 w2", [2.0])])
    rows = search.search_hybrid(q, c, 5).collect()
    assert [(r.chunk_id, r.score) for r in rows] == [("a", 0.0)]


def test_no_queries(spark):
    q, c = frames(spark, make_queries(1), make_corpus(2))
    none = q.where("query_id < 0")
    assert search.search_hybrid(none, c).collect() == []
    assert search.score_bounds(none, c).collect() == []


def test_queries_without_filter_need_no_year(spark):
    q, c = frames(spark, make_queries(1), make_corpus(2))
    q, c = q.drop("years"), c.drop("year")
    assert search.search_sparse(q, c, 3).count() == 27


def test_bounds(spark):
    queries, chunks = make_queries(11), make_corpus(12)
    q, c = frames(spark, queries, chunks)
    got = {r.query_id: r for r in search.score_bounds(q, c).collect()}
    for qid, prompt, years, vector in queries:
        mine = [x for x in chunks if not years or x[1] in years]
        if not mine:
            assert qid not in got
            continue
        dense, sparse = cosine(vector, mine), okapi(prompt, mine)
        ends = [np.nanmin(dense), np.nanmax(dense), sparse.min(), sparse.max()]
        assert got[qid].n_candidates == len(mine)
        assert np.allclose(list(got[qid])[2:], ends)


def test_best_rows_over_several_pieces():
    """The task code itself: rows left out by an earlier piece are never among the best."""
    rng = np.random.default_rng(0)
    order = np.round(rng.random((50, 4)), 1)
    for k in (1, 3, 10, 49, 50, 80):
        for step in (7, 25, 50):
            floor, kept = np.full(4, -np.inf), []
            for start in range(0, 50, step):
                rows, columns = search._best(order[start : start + step], k, floor)
                kept += list(zip(rows + start, columns))
            for c in range(4):
                best = sorted(range(50), key=lambda r: (-order[r, c], r))[:k]
                mine = sorted((r for r, q in kept if q == c), key=lambda r: (-order[r, c], r))
                assert mine[:k] == best


def test_cut_keeps_the_best_rows_per_query_and_alpha():
    rng = random.Random(2)
    rows = [(rng.randint(1, 3), rng.choice([0.0, 1.0]), rng.randint(0, 5), i) for i in range(90)]
    names = ["query_id", "alpha", "order", "chunk_id"]
    table = pa.table({n: [r[i] for r in rows] for i, n in enumerate(names)})
    got = {tuple(r[n] for n in names) for r in search._cut(table, 4).to_pylist()}
    want = set()
    for key in {r[:2] for r in rows}:
        want |= set(sorted((r for r in rows if r[:2] == key), key=lambda r: (-r[2], r[3]))[:4])
    assert got == want


def test_fetch_keeps_rank_order_and_text(spark):
    q, c = frames(spark, make_queries(1), make_corpus(2))
    hits = search.search_sparse(q, c, 3)
    for bound in (None, 27, 10**9):
        rows = search.fetch(hits, c, bound).collect()
        assert len(rows) == hits.count()
        assert all(r.chunk is not None and "embedding" not in r for r in rows)


def test_ranks_do_not_depend_on_partitions(spark):
    """Scores at half of the ninth place are rounded once, where the rows are cut."""
    scores = [0.2500000005, 0.250000000499, 0.2500000015, 0.25] * 8
    chunks = [(f"c{i:02}", "1999", "w", [s, (1 - s * s) ** 0.5]) for i, s in enumerate(scores)]
    q, c = frames(spark, [(1, "w", [], [1.0, 0.0])], chunks)
    found = {
        tuple((r["rank"], r.chunk_id) for r in search.search_dense(q, c.repartition(n), 5).orderBy("rank").collect())
        for n in (1, 3, 50)
    }
    assert len(found) == 1


def test_many_questions_are_one_scan(spark):
    chunks = make_corpus(2)
    queries = [(i, f"w{i % 30} w{i % 7}", [], [1.0, float(i % 5), 0.0, 1.0, 0.5]) for i in range(5000)]
    q, c = frames(spark, queries, chunks)
    found = search.search_hybrid(q, c, 2)
    assert found._jdf.queryExecution().toString().count("MapInArrow") <= 4 * 2
    assert found.count() == 10_000


def test_very_long_prompts(spark):
    chunks = make_corpus(2)
    prompt = " ".join(f"x{i} w{i % 40}" for i in range(20_000))
    q, c = frames(spark, [(i, prompt, [], [1.0] * 5) for i in range(4)], chunks)
    got = collected(search.search_sparse(q, c, 9), "query_id")
    assert got == expected([(i, prompt, [], [1.0] * 5) for i in range(4)], chunks, 9, lambda p, v, m: okapi(p, m))


def test_floors_are_reached_and_few_rows_leave_the_second_scan(spark, monkeypatch):
    n, k = 4000, 3
    rng = np.random.default_rng(7)
    chunks = [(f"c{i:05}", "1999", " ".join(rng.choice(WORDS[1:], 8)), rng.normal(size=4).tolist()) for i in range(n)]
    q, c = frames(spark, make_queries(8, n=4, dim=4), chunks)
    c = c.repartition(40)
    left = []

    def counted(found, keys, k):
        left.append(found.count())
        return original(found, keys, k)

    original = search._ranked
    monkeypatch.setattr(search, "_ranked", counted)
    hits = search.search_hybrid(q, c, k, [0.0, 0.3, 1.0]).collect()
    asked = len({(h.query_id, h.alpha) for h in hits})
    assert left[0] < 40 * asked * k / 4  # without floors every task lets k rows of each go
    monkeypatch.setattr(search, "_place_bounds", lambda block, rows: (place(block, rows), [setattr(g, "floors", None) for g in block.groups]))
    assert left[0] < left_without(search, q, c, k, left)
    assert sorted(map(str, hits)) == sorted(map(str, search.search_hybrid(q, c, k, [0.0, 0.3, 1.0]).collect()))


place = search._place_bounds


def left_without(search, q, c, k, left):
    search.search_hybrid(q, c, k, [0.0, 0.3, 1.0]).collect()
    return left[-1]
