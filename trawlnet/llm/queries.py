"""One query per operator, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawlnet.deploy import ship
from trawlnet.llm import (
    alignment,
    collocations,
    decontaminate,
    extract,
    fingerprint,
    jaccard_join,
    langid,
    packing,
    quality,
    secrets,
    substring_dedup,
    toxicity,
    url_rules,
)
from trawlnet.llm.frames import bound_batches

Query = Callable[[SparkSession, str], DataFrame]

_registry: dict[str, Query] = {}


def query(fn: Query) -> Query:
    """Register ``fn`` under its name; the workers get the package and small batches."""

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
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", F.coalesce(langid.remainder(F.col("doc_id"), 3) == 1, F.lit(False)))
    model = langid.train(docs.where(~F.col("held_out")))
    labelled = langid.identify(docs, model, ["doc_id", "held_out"])
    return labelled.select(
        "doc_id", "held_out", "lang_pred", "score", F.size("span_lang").cast("long").alias("n_spans")
    )


@query
def op2_ngram_jaccard_join(spark, sf_dir):
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents")).drop("key")


@query
def op9_order_minhash(spark, sf_dir):
    printed = fingerprint.fingerprints(table(spark, sf_dir, "documents"))
    return printed.withColumn("edited_sha256", F.sha2("edited", 256)).drop("edited")


@query
def op10_substring_dedup(spark, sf_dir):
    cut = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op3_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(langid.remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    examples = labels.where(~held_out).select("doc_id", F.col("toxic").alias("label"))
    scored = toxicity.score(docs, examples)
    return scored.select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        "predicted",
        F.slice("neighbours", 1, 3).alias("evidence"),
    )


@query
def op4_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs))


# Fixed values: (verdict, host, path) of the explicit rules.
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


@query
def op5_url_rules(spark, sf_dir):
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    bad = labels.select(F.col("doc_id").alias("page_id"), (F.col("quality") == 0).alias("bad"))
    mined = url_rules.mine(pages.select("page_id", "url").join(bad, "page_id"))
    judged = url_rules.judge(pages, URL_RULES, mined)
    return judged.select("page_id", "host", "path", "rule", "verdict", "confidence")


@query
def op6_decontaminate(spark, sf_dir):
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = decontaminate.find_passages(docs, items)
    n_hit = decontaminate.n_hit_words(F.col("hits"))
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


@query
def op7_main_text(spark, sf_dir):
    found = extract.extract(table(spark, sf_dir, "pages"), ["page_id", "url"])
    return found.withColumn("n_chars", F.char_length("text").cast("long"))


@query
def op8_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


@query
def op11_secret_scan(spark, sf_dir):
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("spans", secrets.of_kind(r.kind))).cast("long").alias(f"n_{r.kind}") for r in secrets.BASE]
    base = F.filter("spans", lambda s: s["n"] < len(secrets.BASE))
    return found.select(
        "doc_id", *counts, F.sha2(secrets.printed(base), 256).alias("base_sha256"), secrets.printed(F.col("spans")).alias("spans")
    )


@query
def op12_collocations(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))


@query
def op13_token_alignment(spark, sf_dir):
    return alignment.align(table(spark, sf_dir, "documents"), tokenizer_path(), piece_path(), ["doc_id"])


def tokenizer_path() -> str:
    """The public byte-level vocabulary, where it is installed."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def piece_path() -> str:
    """The public vocabulary of pieces, where it is installed."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")
