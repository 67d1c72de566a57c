"""Queries over the test tables; each is a short composition of library operators.

``documents`` is the corpus (``lang`` as year, ``source`` as section), ``benchmark`` holds
the questions and their golden passages, ``embeddings`` the vectors of both.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from trawlnet.deploy import ship
from trawlnet.functions import text, vector
from trawlnet.functions.batches import bound_batches
from trawlnet.operators import chunk as chunking
from trawlnet.operators import cells, clean, context, embed, lexical, metrics, profile, search
from trawlnet.operators.postings import read_postings, search_postings, statistics_of, write_postings
from trawlnet.operators.relevance import containing_chunks
from trawlnet.plans import answer as answering
from trawlnet.plans import evaluate as evaluation
from trawlnet.plans.index import build_index, read_statistics
from trawlnet.sources import golden, runs, splits, store
from trawlnet.sources.scan import scan, spread_small
from trawlnet.sources.scratch import materialize, scratch_path

Query = Callable[[SparkSession, str], DataFrame]

ALPHAS = (0.0, 0.5, 1.0)
K = 10
MODEL = embed.hashing_model(16)
_registry: dict[str, Query] = {}


def query(fn: Query) -> Query:
    """Register ``fn`` under its name; the workers get the package, and texts in small batches."""

    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        bound_batches(spark)
        return fn(spark, sf_dir)

    _registry[fn.__name__] = run
    return run


def registered() -> dict[str, Query]:
    return dict(_registry)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return scan(spark, f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread_small(table(spark, sf_dir, "documents"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select(
        F.col("doc_id").alias("chunk_id"),
        F.col("lang").alias("year"),
        F.col("source").alias("section"),
        F.col("text").alias("chunk"),
    )


def embedded_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the vector of a hashing model: the store that the searches scan."""
    return materialize(embed.embed(corpus(spark, sf_dir), MODEL), "chunks")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("prompt")
    )


def vector_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.embed(questions(spark, sf_dir), MODEL, "prompt", output="vector")


def listed_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with their vector in ``embeddings``."""
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")
    )
    return questions(spark, sf_dir).join(vectors, "query_id")


def filtered(asked: DataFrame) -> DataFrame:
    """A third of the questions each: no filter, one value, two values."""
    kind = F.col("query_id") % 3
    years = (
        F.when(kind == 0, F.array().cast("array<string>"))
        .when(kind == 1, F.array(F.lit("en")))
        .otherwise(F.array(F.lit("en"), F.lit("fr")))
    )
    return asked.withColumn("years", years)


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("array<string>")
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"),
        F.col("text").alias("full_sentence"),
        F.col("text").alias("gt_text"),
        none.alias("gt_list"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that differ from the passage in case and padding, or, for long ones, in text."""
    answer = F.when(
        F.length("text") < 250, F.concat(F.lit(" \t"), F.translate("text", "aeiou", "AEIOU"), F.lit("\n "))
    ).otherwise(F.concat(F.lit("not "), F.col("text")))
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), answer.alias("pred_answer")
    )


def run_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of each run: with a higher alpha fewer questions get one that matches."""
    answers = predictions(spark, sf_dir)
    runs = answers.withColumn("alpha", F.explode(F.array(*[F.lit(a) for a in ALPHAS])))
    kept = F.pmod(F.col("query_id"), F.lit(4)) >= F.col("alpha") * 2
    return runs.withColumn("pred_answer", F.when(kept, F.col("pred_answer")).otherwise("none"))


def three_splits(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    docs = table(spark, sf_dir, "documents")
    return {
        "train": docs.where("lang = 'en'"),
        "validation": docs.where("lang = 'de'"),
        "test": docs.where("lang not in ('en', 'de')"),
    }


def _per_split(union: DataFrame) -> DataFrame:
    return union.groupBy("split", "lang").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("n_chars").alias("n_chars")
    )


# Sources and sinks


@query
def union_splits(spark, sf_dir):
    return _per_split(splits.tag_and_union(three_splits(spark, sf_dir)))


@query
def split_sizes(spark, sf_dir):
    return profile.split_sizes(splits.tag_and_union(three_splits(spark, sf_dir)))


@query
def land_roundtrip(spark, sf_dir):
    base = scratch_path(spark, "landing")
    parts = three_splits(spark, sf_dir)
    splits.land_splits(parts, base)
    if splits.land_splits(parts, base):
        raise RuntimeError("a finished split was written twice")
    return _per_split(splits.read_splits(spark, base, list(parts)))


def _wide_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select(
        F.col("doc_id").cast("string").alias("cik"),
        F.col("lang").alias("year"),
        F.col("text").alias("section_1"),
        F.lit(None).cast("string").alias("section_1A"),
    )


@query
def store_roundtrip(spark, sf_dir):
    """Index all documents, then again after a tenth has changed and a tenth has gone."""
    wide = _wide_documents(spark, sf_dir)
    base = scratch_path(spark, "index")
    run = {"sections": ("section_1", "section_1A"), "overlap": 0}
    model = embed.hashing_model(16)
    build_index(wide, base, model, "hashing-16", **run)
    tenth = F.col("cik").cast("long") % 10
    changed = F.when(tenth == 3, F.concat(F.lit("changed "), F.col("section_1"))).otherwise(F.col("section_1"))
    build_index(wide.where(tenth != 7).withColumn("section_1", changed), base, model, "hashing-16", **run)
    rows = store.read_store(spark, f"{base}/store", model="hashing-16", size=2000, overlap=0)
    bare = F.regexp_replace("chunk", text.SPACES, "")
    norm = vector.l2_norm(F.col("embedding"))
    per_year = rows.groupBy("year", "section", *store.RUN_COLUMNS).agg(
        F.count_distinct("cik").alias("n_docs"),
        F.sum(F.length(bare)).alias("n_bare_chars"),
        F.bool_and((norm == 0) | (F.abs(norm - 1) < 1e-9)).alias("unit_vectors"),
    )
    manifest = store.read_manifest(spark, f"{base}/info")
    words = read_statistics(spark, base, "hashing-16", 2000, 0).where("term is null").select("year", "n_tokens")
    return per_year.join(manifest, list(store.RUN_COLUMNS)).join(words, "year")


@query
def golden_json_roundtrip(spark, sf_dir):
    bench = table(spark, sf_dir, "benchmark")
    is_list = F.length("text") >= 200
    rows = bench.select(
        F.col("item_id").cast("int").alias("prompt_id"),
        F.col("text").alias("prompt"),
        F.col("text").alias("full_sentence"),
        F.when(~is_list, F.col("text")).alias("gt_text"),
        F.when(is_list, text.tokens("text")).alias("gt_list"),
        F.lit("2012").alias("year"),
        F.lit("section_2").alias("section"),
    )
    path = scratch_path(spark, "golden")
    golden.write_golden(rows, path)
    back = golden.read_golden(spark, path, lines=True)
    return back.select(
        "prompt_id",
        F.md5("full_sentence").alias("sentence_md5"),
        "gt_text",
        F.array_join("gt_list", "|").alias("gt_items"),
        "year",
        "section",
    )


# Profile and clean


@query
def preview(spark, sf_dir):
    return profile.preview(table(spark, sf_dir, "documents").orderBy("doc_id"), 10, 25)


@query
def lookup_point(spark, sf_dir):
    found = clean.lookup(table(spark, sf_dir, "documents"), lang="en", source="src1")
    return found.select("doc_id", F.md5("text").alias("text_md5"))


@query
def lookup_batch(spark, sf_dir):
    keys = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    found = clean.lookup_many(table(spark, sf_dir, "documents"), keys)
    return found.select("doc_id", "lang", "source")


@query
def entity_counts(spark, sf_dir):
    return profile.counts(
        table(spark, sf_dir, "documents"),
        {
            "n_prefix": F.col("source").startswith("src1"),
            "n_en": F.col("lang") == "en",
            "n_fr": F.col("lang") == "fr",
            "n_xx": F.col("lang") == "xx",
        },
    )


@query
def null_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return profile.null_counts(docs.join(table(spark, sf_dir, "labels"), "doc_id", "left"))


@query
def blank_counts(spark, sf_dir):
    blanked = table(spark, sf_dir, "documents").select(
        F.when(F.col("lang") == "en", "").otherwise(F.col("lang")).alias("lang"), "source"
    )
    return profile.blank_counts(blanked, ["lang", "source"])


def _wide_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.when(F.col("p_size") <= 40, F.col("p_name")).alias("p_name"),
        F.concat(F.col("p_brand"), F.when(F.col("p_size") > 20, "  ").otherwise("\t")).alias(
            "p_brand"
        ),
        F.when(F.col("p_size") > 10, F.col("p_type")).otherwise("   ").alias("p_type"),
    )


PART_SECTIONS = ("p_name", "p_brand", "p_type")


@query
def unpivot_sections(spark, sf_dir):
    return clean.unpivot_sections(_wide_parts(spark, sf_dir), ["p_partkey"], PART_SECTIONS)


@query
def clean_sections(spark, sf_dir):
    long = clean.unpivot_sections(_wide_parts(spark, sf_dir), ["p_partkey"], PART_SECTIONS)
    return clean.clean_sections(long)


@query
def html_flag(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(
        F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("body")
    )
    docs = table(spark, sf_dir, "documents").select(
        F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.col("text").alias("body")
    )
    both = pages.unionByName(docs)
    return both.select("kind", "id", text.has_html("body").alias("contains_html"))


@query
def html_count(spark, sf_dir):
    flagged = html_flag(spark, sf_dir).where(F.col("contains_html"))
    return flagged.groupBy("kind").agg(F.count(F.lit(1)).alias("n_rows"))


def _counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return profile.token_counts(docs, "text").drop("text")


@query
def token_counts(spark, sf_dir):
    return _counted(spark, sf_dir)


@query
def token_quantile_budget(spark, sf_dir):
    return profile.token_budget(_counted(spark, sf_dir), "token_count", 0.7, 500)


@query
def token_summary(spark, sf_dir):
    return profile.summary(_counted(spark, sf_dir), "token_count")


@query
def token_box(spark, sf_dir):
    return profile.box(_counted(spark, sf_dir), "token_count")


@query
def token_outliers(spark, sf_dir):
    counted = materialize(_counted(spark, sf_dir), "token-counts")
    return profile.outliers(counted, "token_count")


@query
def random_sample(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    return profile.hashed_rows(rows, 20, "vec_id")


# Chunks and vectors


@query
def chunk_properties(spark, sf_dir):
    """Per document: chunks keep to the size; a short text is one chunk; nothing is lost."""
    whole = chunking.split_column(2000, 100)(F.col("text"))
    apart = chunking.split_column(2000, 0)(F.col("text"))
    parts = documents(spark, sf_dir).select("doc_id", "n_chars", whole.alias("w"), apart.alias("a"))
    only = F.when((F.col("n_chars") < 2000) & (F.size("w") == 1), F.md5(F.col("w")[0]))
    longest = F.array_max(F.transform("w", F.length))
    bare = F.regexp_replace(F.array_join("a", ""), text.SPACES, "")
    return parts.select(
        "doc_id",
        (longest <= 2000).alias("fits"),
        only.alias("single_md5"),
        F.md5(bare).alias("bare_md5"),
    )


@query
def chunk_summary(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    chunks = chunking.chunk(docs, "text", ["doc_id"])
    return profile.summary(profile.token_counts(chunks, "chunk"), "token_count")


@query
def embed_hash(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    vectors = embed.embed(docs, embed.hashing_model(16), "text")
    rows = vectors.select("doc_id", F.posexplode("embedding").alias("position", "value"))
    return rows.withColumn("value", F.round("value", 6))


@query
def vector_functions(spark, sf_dir):
    """Norm of every vector, and its product with the vector of the next id."""
    left = table(spark, sf_dir, "embeddings")
    right = left.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    mine, other = F.col("embedding"), F.col("other")
    return left.join(right, "vec_id").select(
        "vec_id",
        F.round(vector.l2_norm(mine), 6).alias("norm"),
        F.round(vector.dot(mine, other), 6).alias("dot"),
        F.round(vector.cosine(mine, other), 6).alias("cosine"),
    )


# Lexical statistics


@query
def tokenize(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", text.tokens("text").alias("t"))
    return rows.select(
        "doc_id",
        F.size("t").cast("long").alias("n_tokens"),
        F.size(F.array_distinct("t")).cast("long").alias("n_distinct"),
        F.md5(F.array_join("t", " ")).alias("tokens_md5"),
    )


@query
def term_frequencies(spark, sf_dir):
    counted = lexical.term_counts(corpus(spark, sf_dir))
    return counted.groupBy("term").agg(
        F.count(F.lit(1)).alias("n_chunks"),
        F.sum("tf").alias("total_tf"),
        F.max("tf").alias("max_tf"),
    )


@query
def term_stats(spark, sf_dir):
    stats = lexical.year_statistics(corpus(spark, sf_dir))
    return stats.where(F.col("term").isNotNull()).select("year", "term", "n_chunks")


def _corpus_stats(stats: DataFrame) -> DataFrame:
    filters = [[], ["en"], ["en", "fr"]]
    summary = lexical.idf_summary(lexical.filter_statistics(stats, filters))
    return summary.select(
        "filter_id",
        "corpus_chunks",
        F.round("avg_length", 6).alias("avg_length"),
        "n_terms",
        F.round("mean_idf", 6).alias("mean_idf"),
    )


@query
def corpus_stats(spark, sf_dir):
    return _corpus_stats(materialize(lexical.year_statistics(corpus(spark, sf_dir)), "term-statistics"))


# Retrieval


def _rounded(hits: DataFrame, *columns: str) -> DataFrame:
    return hits.withColumns({c: F.round(c, 6) for c in columns})


@query
def bm25_topk(spark, sf_dir):
    hits = search.search_sparse(questions(spark, sf_dir), corpus(spark, sf_dir), K)
    return _rounded(hits, "score")


@query
def bm25_postings_topk(spark, sf_dir):
    """The same from stored postings: the search itself reads no text."""
    path = scratch_path(spark, "postings")
    write_postings(corpus(spark, sf_dir), path)
    index = read_postings(spark, path, LongType())
    statistics = materialize(statistics_of(index), "term-statistics")
    return _rounded(search_postings(questions(spark, sf_dir), index, statistics, K), "score")


@query
def bm25_postings_filtered_topk(spark, sf_dir):
    path = scratch_path(spark, "postings")
    write_postings(corpus(spark, sf_dir), path)
    index = read_postings(spark, path, LongType())
    statistics = materialize(statistics_of(index), "term-statistics")
    return _rounded(search_postings(filtered(questions(spark, sf_dir)), index, statistics, K), "score")


@query
def stored_corpus_stats(spark, sf_dir):
    """Statistics of any year filter from the blocks of stored postings."""
    path = scratch_path(spark, "postings")
    write_postings(corpus(spark, sf_dir), path)
    stats = materialize(statistics_of(read_postings(spark, path, LongType())), "term-statistics")
    return _corpus_stats(stats)


@query
def odd_questions_topk(spark, sf_dir):
    """Questions without a known term (even ids) or with a zero vector (ids divisible by three)."""
    asked = vector_questions(spark, sf_dir)
    unknown = F.when(F.col("query_id") % 2 == 0, F.lit("qqqq zzzz")).otherwise(F.col("prompt"))
    zero = F.when(F.col("query_id") % 3 == 0, F.transform("vector", lambda x: x * 0.0)).otherwise(F.col("vector"))
    asked = asked.withColumns({"prompt": unknown, "vector": zero})
    hits = search.search_hybrid(asked, embedded_corpus(spark, sf_dir), K)
    return _rounded(hits, *HYBRID_SCORES)


@query
def cosine_topk(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("chunk_id"), "embedding"
    )
    return _rounded(search.search_dense(listed_questions(spark, sf_dir), vectors, K), "score")


@query
def cosine_cells_topk(spark, sf_dir):
    """The same from vectors stored by cell, of which those that cannot matter are left out."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    path = scratch_path(spark, "cells")
    cells.write_cells(vectors, path)
    stored = cells.read_cells(spark, path, LongType(), vectors.schema["embedding"].dataType.elementType)
    return _rounded(cells.search_cells(listed_questions(spark, sf_dir), stored, K), "score")


@query
def minmax_scores(spark, sf_dir):
    asked = filtered(vector_questions(spark, sf_dir))
    rows = search.score_bounds(asked, embedded_corpus(spark, sf_dir))
    return _rounded(rows, "dense_min", "dense_max", "sparse_min", "sparse_max")


HYBRID_SCORES = ("score", "dense", "sparse", "dense_norm", "sparse_norm")


@query
def hybrid_topk(spark, sf_dir):
    hits = search.search_hybrid(vector_questions(spark, sf_dir), embedded_corpus(spark, sf_dir), K)
    return _rounded(hits, *HYBRID_SCORES)


@query
def hybrid_filtered_topk(spark, sf_dir):
    asked = filtered(vector_questions(spark, sf_dir))
    hits = search.search_hybrid(asked, embedded_corpus(spark, sf_dir), K)
    return _rounded(hits, *HYBRID_SCORES)


@query
def year_extract(spark, sf_dir):
    year = F.year("o_orderdate")
    prompt = F.concat_ws(
        " ", "o_orderpriority", F.lit("orders of"), year, F.lit("against"), year + 1,
        F.lit("or again"), F.concat(year.cast("string"), F.lit("?")),
    )
    asked = table(spark, sf_dir, "orders").select("o_orderkey", prompt.alias("prompt"))
    found = evaluation.with_years(asked)
    return found.select("o_orderkey", F.array_join("years", ",").alias("years"))


def _fetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = filtered(vector_questions(spark, sf_dir))
    return evaluation.retrieve(asked, embedded_corpus(spark, sf_dir), K)


@query
def context_prompt(spark, sf_dir):
    prompts = context.context(_fetched(spark, sf_dir))
    return prompts.select(
        "query_id",
        F.length("context").cast("long").alias("context_length"),
        F.md5("system_prompt").alias("prompt_md5"),
    )


@query
def result_bundle(spark, sf_dir):
    rows = context.result_bundle(_fetched(spark, sf_dir), predictions(spark, sf_dir))
    return rows.select(
        "query_id",
        F.md5(F.array_join("top_k_chunks", "\n")).alias("chunks_md5"),
        F.array_join("top_k_sections", ",").alias("sections"),
        F.array_join("top_k_years", ",").alias("years"),
        "pred_answer",
    )


@query
def answer_prompts(spark, sf_dir):
    """Embed corpus and questions, then everything up to the prompt of the chat model."""
    chunks = embedded_corpus(spark, sf_dir)
    rows = answering.answer_prompts(questions(spark, sf_dir), chunks, MODEL, K)
    return rows.select(
        "query_id",
        F.md5("system_prompt").alias("prompt_md5"),
        F.md5(F.array_join("top_k_chunks", "\n")).alias("chunks_md5"),
        F.array_join("top_k_sections", ",").alias("sections"),
        F.array_join("top_k_years", ",").alias("years"),
    )


# Evaluation


@query
def relevance_pairs(spark, sf_dir):
    pairs = containing_chunks(gold(spark, sf_dir), corpus(spark, sf_dir))
    return pairs.select("query_id", "chunk_id")


def _bm25_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = corpus(spark, sf_dir)
    asked = questions(spark, sf_dir)
    hits = search.search_sparse(asked, chunks, K).withColumn("alpha", F.lit(0.0))
    rows = search.fetch(hits, chunks, asked.count() * K)
    return rows.withColumn("text_key", text.text_key("chunk"))


@query
def recall_at_k(spark, sf_dir):
    asked, chunks = gold(spark, sf_dir), corpus(spark, sf_dir)
    relevant = containing_chunks(asked, chunks)
    rows = metrics.recall_per_query(asked, relevant, _bm25_hits(spark, sf_dir), [0.0])
    return rows.select("query_id", "n_relevant", "n_hits", F.round("recall", 6).alias("recall"))


@query
def mrr(spark, sf_dir):
    hits = _bm25_hits(spark, sf_dir)
    rows = metrics.reciprocal_rank_per_query(gold(spark, sf_dir), hits, [0.0])
    return rows.select(
        "query_id", "first_rank", F.round("reciprocal_rank", 6).alias("reciprocal_rank")
    )


@query
def exact_match_text(spark, sf_dir):
    return metrics.answer_matches(gold(spark, sf_dir), predictions(spark, sf_dir))


@query
def exact_match_rate(spark, sf_dir):
    return metrics.exact_match(exact_match_text(spark, sf_dir))


@query
def exact_match_list(spark, sf_dir):
    """Per customer: order priorities as a list; answers doubled, without one, with one more, with another, or broken."""
    orders = table(spark, sf_dir, "orders")
    lists = orders.groupBy(F.col("o_custkey").alias("query_id")).agg(
        F.array_sort(F.collect_set("o_orderpriority")).alias("gt_list"),
        F.count(F.lit(1)).alias("n_orders"),
    )
    doubled = F.reverse(F.concat("gt_list", F.slice("gt_list", 1, 1)))
    kind = F.col("query_id") % 5
    shown = (
        F.when(kind == 1, F.slice("gt_list", F.lit(2), F.size("gt_list")))
        .when(kind == 2, F.concat("gt_list", F.array(F.lit("6-NONE"))))
        .when(kind == 3, F.transform(doubled, lambda x: F.when(x == "1-URGENT", "5-LOW").otherwise(x)))
        .otherwise(doubled)
    )
    printed = F.concat(F.lit(" ['"), F.array_join(shown, "', '"), F.lit("']\n"))
    printed = F.when(F.size(shown) == 0, F.lit("[]")).otherwise(printed)
    cut = F.concat(F.lit("['"), F.array_join(shown, "', '"), F.lit("'"))
    answer = F.when(F.col("n_orders") % 5 == 0, cut).otherwise(printed)
    gold_lists = lists.select("query_id", "gt_list", F.lit(None).cast("string").alias("gt_text"))
    answers = lists.select("query_id", answer.alias("pred_answer"))
    return metrics.answer_matches(gold_lists, answers)


def _evaluated(spark: SparkSession, sf_dir: str, alphas) -> DataFrame:
    return evaluation.evaluate(
        gold(spark, sf_dir),
        vector_questions(spark, sf_dir),
        embedded_corpus(spark, sf_dir),
        run_predictions(spark, sf_dir),
        K,
        alphas,
    )


@query
def score_bundle(spark, sf_dir):
    return evaluation.flat_scores(_evaluated(spark, sf_dir, [0.5]))


@query
def alpha_sweep(spark, sf_dir):
    return evaluation.flat_scores(_evaluated(spark, sf_dir, ALPHAS))


@query
def run_comparison(spark, sf_dir):
    bundles = _evaluated(spark, sf_dir, ALPHAS).withColumns(
        {"top_k": F.lit(K), "temperature": F.lit(0.0), "embedding_model": F.lit("hashing/16")}
    )
    base = scratch_path(spark, "scores")
    runs.write_scores(bundles, base)
    settings = ["alpha", "top_k", "temperature"]
    return runs.metric_series(runs.read_scores(spark, base), settings)
