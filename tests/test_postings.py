"""Search over stored postings against a plain loop over all pairs, and what it does not read."""

import pytest
from pyspark.sql import functions as F
from test_search import collected, expected, frames, make_corpus, make_queries, okapi

from trawlnet.deploy import ship
from trawlnet.operators import lexical, postings, search
from trawlnet.sources.scratch import scratch_path


def indexed(spark, chunks, range_chunks=postings.RANGE_CHUNKS):
    ship(spark)
    path = scratch_path(spark, "postings")
    postings.write_postings(chunks, path, range_chunks)
    statistics = lexical.year_statistics(chunks).cache()
    return postings.read_postings(spark, path, chunks.schema["chunk_id"].dataType), statistics


@pytest.fixture(params=["one range", "two waves"])
def waves(request, monkeypatch):
    if request.param == "one range":
        return postings.RANGE_CHUNKS
    monkeypatch.setattr(postings, "FIRST", 2)
    monkeypatch.setattr(search, "BLOCK_BYTES", 1500)
    return 4


@pytest.mark.parametrize("k", [1, 7, 500])
def test_equals_a_loop(spark, waves, k):
    queries, chunks = make_queries(1), make_corpus(2)
    q, c = frames(spark, queries, chunks)
    got = collected(postings.search_postings(q, *indexed(spark, c, waves), k), "query_id")
    assert got == expected(queries, chunks, k, lambda p, v, m: okapi(p, m))


def test_terms_in_most_chunks(spark, waves):
    """The mean idf is negative, and so are weights: chunks without a term come before some with it."""
    words = "a b c d e f".split()
    chunks = [(f"c{i:02}", "1999", " ".join(w for j, w in enumerate(words) if (i + j) % 5), [0.0]) for i in range(30)]
    queries = [(1, "a b", [], [0.0]), (2, "f zz", None, [0.0]), (3, "zz", [], [0.0]), (4, None, [], [0.0])]
    q, c = frames(spark, queries, chunks)
    got = collected(postings.search_postings(q, *indexed(spark, c, waves), 8), "query_id")
    assert got == collected(search.search_sparse(q, c, 8), "query_id")


def test_statistics_need_no_texts(spark, waves):
    _, c = frames(spark, [], make_corpus(6))
    index, statistics = indexed(spark, c.withColumn("year", F.nullif("year", F.lit("2000"))), waves)
    got, want = (sorted(map(tuple, df.collect()), key=str) for df in (postings.statistics_of(index).select(statistics.columns), statistics))
    assert got == want


def test_odd_tables(spark):
    q, c = frames(spark, make_queries(3), make_corpus(4))
    empty = indexed(spark, c.where("false"))
    assert postings.search_postings(q, *empty).collect() == []
    assert postings.search_postings(q.where("false"), *indexed(spark, c)).collect() == []
    odd = spark.createDataFrame(
        [(1, None, "a b a"), (2, "x", None), (3, None, "  "), (4, "y", "É b"), (5, "y", "a " * 300)], "chunk_id long, year string, chunk string"
    )
    asked = spark.createDataFrame([(1, "A é"), (2, ""), (3, "b zz")], "query_id int, prompt string")
    got = collected(postings.search_postings(asked, *indexed(spark, odd), 9), "query_id")
    assert got == collected(search.search_sparse(asked, odd, 9), "query_id")


def test_blocks_that_cannot_matter_are_not_read(spark, monkeypatch):
    """A rare term decides; blocks of a frequent one are read only where the rare one occurs."""
    monkeypatch.setattr(postings, "FIRST", 4)
    n = 4000
    text = F.concat_ws(" ", F.lit("the"), F.when(F.col("id") % 97 == 0, F.lit("rare")), F.concat(F.lit("w"), F.col("id") % 300))
    chunks = spark.range(n).select(F.col("id").alias("chunk_id"), F.lit("1999").alias("year"), text.alias("chunk")).coalesce(1)
    index, statistics = indexed(spark, chunks, 20)
    asked = spark.createDataFrame([(1, "rare the", [])], "query_id long, prompt string, years array<string>")
    seen = {}

    def counted(blocks, ranges, block, params):
        needed = original(blocks, ranges, block, params)
        seen["blocks"], seen["needed"] = blocks.count(), needed.where("word >= 0").count()
        return needed

    original = postings.needed_blocks
    monkeypatch.setattr(postings, "needed_blocks", counted)
    hits = postings.search_postings(asked, index, statistics, 5)
    assert collected(hits, "query_id") == collected(search.search_sparse(asked, chunks, 5), "query_id")
    assert seen["needed"] < seen["blocks"] / 2
    stored = {c for df in (index.blocks, index.ranges) for c in df.columns}
    assert stored.isdisjoint({"chunk", "text"})


def test_maxima_bound_every_posting(spark):
    _, c = frames(spark, [], make_corpus(5))
    index, _ = indexed(spark, c, 7)
    for r in index.blocks.limit(25).toArrow().to_pylist():
        whole = index.ranges.where(F.col("range") == r["range"]).first()
        tf = [int.from_bytes(r["counts"][i : i + len(r["counts"]) // r["n"]], "little") for i in range(0, len(r["counts"]), len(r["counts"]) // r["n"])]
        places = [int.from_bytes(r["places"][i : i + 2], "little") for i in range(0, 2 * r["n"], 2)]
        assert max(tf) == r["max_tf"] and min(whole["lengths"][p] for p in places) == r["min_length"]
    assert index.blocks.count() > 10
