from pyspark.sql import functions as F

from trawlnet.operators import context, metrics, ranking
from trawlnet.operators.relevance import containing_chunks
from trawlnet.plans.evaluate import evaluate, flat_scores
from trawlnet.functions import text


def test_recall_counts_texts_once_and_misses_as_zero(spark):
    gold = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    relevant = spark.createDataFrame(
        [(1, "a"), (1, "a"), (1, "b"), (2, "c")], "query_id int, text_key string"
    )
    retrieved = spark.createDataFrame(
        [(1, 0.0, "a"), (1, 0.0, "a"), (1, 1.0, "a"), (1, 1.0, "b"), (2, 0.0, "x"), (3, 0.0, "a")],
        "query_id int, alpha double, text_key string",
    )
    rows = metrics.recall_per_query(gold, relevant, retrieved, [0.0, 1.0])
    got = {(r.query_id, r.alpha): (r.n_relevant, r.n_hits, r.recall) for r in rows.collect()}
    assert got == {
        (1, 0.0): (2, 1, 0.5),
        (1, 1.0): (2, 2, 1.0),
        (2, 0.0): (1, 0, 0.0),
        (2, 1.0): (1, 0, 0.0),
        (3, 0.0): (0, 0, 0.0),
        (3, 1.0): (0, 0, 0.0),
    }
    means = {r.alpha: r.recall_k for r in metrics.mean_recall(rows).collect()}
    assert means == {0.0: 0.167, 1.0: 0.333}


def test_reciprocal_rank(spark):
    gold = spark.createDataFrame([(1, "cat"), (2, "dog")], "query_id int, full_sentence string")
    hits = spark.createDataFrame(
        [(1, 0.5, 1, "a bird"), (1, 0.5, 2, "a cat"), (1, 0.5, 3, "cats"), (2, 0.5, 1, "Dog")],
        "query_id int, alpha double, rank int, chunk string",
    )
    rows = metrics.reciprocal_rank_per_query(gold, hits, [0.5])
    got = {r.query_id: (r.first_rank, r.reciprocal_rank) for r in rows.collect()}
    assert got == {1: (2, 0.5), 2: (None, 0.0)}
    assert metrics.mean_reciprocal_rank(rows).first().mrr == 0.25


def test_means_round_half_to_even(spark):
    # one of sixteen: 0.0625 has an even third place below it
    rows = spark.range(16).select((F.col("id") == 0).alias("is_match"))
    assert metrics.exact_match(rows).first()[0] == 0.062


def test_answers(spark):
    gold = spark.createDataFrame(
        [
            (1, "5 percent", None),
            (2, "5 percent", None),
            (3, None, ["A/B", "C/D"]),
            (4, None, ["A/B"]),
            (5, None, ["A/B"]),
            (6, "x", None),
        ],
        "query_id int, gt_text string, gt_list array<string>",
    )
    said = spark.createDataFrame(
        [
            (1, " 5 Percent\n"),
            (2, "6 percent"),
            (3, "['C/D', 'A/B', 'A/B']"),
            (4, "A/B"),
            (5, "['A/B', 'C/D']"),
        ],
        "query_id int, pred_answer string",
    )
    got = {r.query_id: r.is_match for r in metrics.answer_matches(gold, said).collect()}
    assert got == {1: True, 2: False, 3: True, 4: False, 5: False, 6: False}


def test_top_k_ties_and_nulls(spark):
    rows = [("q", f"c{i}", s) for i, s in enumerate([0.5, 0.7, 0.5 + 1e-13, None, 0.1])]
    scores = spark.createDataFrame(rows, "query_id string, chunk_id string, score double")
    top = ranking.top_k(scores, ["query_id"], 5).orderBy("rank").collect()
    assert [r.chunk_id for r in top] == ["c1", "c0", "c2", "c4", "c3"]
    assert [r["rank"] for r in top] == [1, 2, 3, 4, 5]


def test_context_and_result_keep_rank_order(spark):
    hits = spark.createDataFrame(
        [(1, 2, "two", "s2", "y2"), (1, 1, "one", "s1", "y1"), (1, 10, "ten", "s3", "y3")],
        "query_id int, rank int, chunk string, section string, year string",
    )
    row = context.context(hits).first()
    assert row.context == "one\ntwo\nten"
    assert row.system_prompt.endswith("context one\ntwo\nten")
    said = spark.createDataFrame([(1, "yes")], "query_id int, pred_answer string")
    row = context.result_bundle(hits, said).first()
    assert row.top_k_chunks == ["one", "two", "ten"]
    assert row.top_k_sections == ["s1", "s2", "s3"]
    assert row.top_k_years == ["y1", "y2", "y3"]
    assert row.pred_answer == "yes"


def test_relevance_looks_beyond_the_years_of_the_question(spark):
    """A passage found in two years, a question that asks for one: recall is a half."""
    chunks = spark.createDataFrame(
        [
            ("a", "1999", "s", "first the red fox runs", [1.0, 0.0]),
            ("b", "2000", "s", "then the red fox runs", [1.0, 0.1]),
            ("c", "1999", "s", "nothing here", [0.0, 1.0]),
        ],
        "chunk_id string, year string, section string, chunk string, embedding array<double>",
    )
    queries = spark.createDataFrame(
        [(1, "red fox", ["1999"], [1.0, 0.0])],
        "query_id int, prompt string, years array<string>, vector array<double>",
    )
    gold = spark.createDataFrame(
        [(1, "the red fox", "yes", None)],
        "query_id int, full_sentence string, gt_text string, gt_list array<string>",
    )
    said = spark.createDataFrame([(1, "Yes")], "query_id int, pred_answer string")
    assert containing_chunks(gold, chunks).count() == 2
    row = flat_scores(evaluate(gold, queries, chunks, said, k=10, alphas=[0.5])).first()
    assert (row.recall_k, row.mrr, row.exact_match_score) == (0.5, 1.0, 1.0)


def test_text_key_is_never_null(spark):
    row = spark.range(1).select(text.text_key(F.lit(None).cast("string")), text.text_key(F.lit("a")))
    assert row.first()[0] == "" and len(row.first()[1]) == 64


def test_blank_passages_are_in_no_chunk(spark):
    gold = spark.createDataFrame([(1, ""), (2, "  "), (3, "a")], "query_id int, full_sentence string")
    hits = spark.createDataFrame([(i, 0.5, 1, "a  b") for i in (1, 2, 3)], "query_id int, alpha double, rank int, chunk string")
    rows = metrics.reciprocal_rank_per_query(gold, hits, [0.5]).collect()
    assert {r.query_id: r.reciprocal_rank for r in rows} == {1: 0.0, 2: 0.0, 3: 1.0}


def test_answers_of_each_run(spark):
    gold = spark.createDataFrame([(1, "a", None), (2, "b", None)], "query_id int, gt_text string, gt_list array<string>")
    said = spark.createDataFrame([(1, 0.0, "A"), (2, 0.0, "b"), (1, 1.0, "a")], "query_id int, alpha double, pred_answer string")
    matches = metrics.answer_matches(gold, said, [0.0, 1.0])
    score = {r.alpha: r.exact_match_score for r in metrics.exact_match(matches).collect()}
    assert score == {0.0: 1.0, 1.0: 0.5}
