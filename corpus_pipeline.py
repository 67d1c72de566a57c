"""From raw documents to packed training sequences, stage by stage.

Every stage takes what its predecessor kept and returns the columns of ``documents``, all but
the last. Each is a function of (spark, docs, sf_dir).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trawlnet.deploy import ship
from trawlnet.llm import decontaminate, jaccard_join, langid, packing, substring_dedup
from trawlnet.llm.frames import bound_batches
from trawlnet.llm.queries import table, tokenizer_path
from trawlnet.sources.scratch import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _ready(spark: SparkSession) -> None:
    """The workers get the package, and documents in small batches."""
    ship(spark)
    bound_batches(spark)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep texts with a language, be they in one or mixed of many in equal parts."""
    _ready(spark)
    model = langid.train(docs)
    known = langid.identify(docs, model, COLUMNS)
    return known.where(F.col("lang_pred") != langid.UNKNOWN).select(COLUMNS)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS, F.xxhash64("text").alias("_key"))


def _same(keys: DataFrame) -> Column:
    """Rows with the same id, or none, and the same text as one of ``keys``."""
    return F.col("doc_id").eqNullSafe(keys["_id"]) & (F.col("_key") == keys["_text"])


def _keys(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("doc_id").alias("_id"), F.col("key").alias("_text")).distinct()


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of every group of near duplicates.

    A row without an id stays if no row with an id is like it. Repeated rows are one document.
    """
    _ready(spark)
    groups = jaccard_join.near_duplicates(docs)
    firsts = _keys(groups.where("doc_id <=> component_id"))
    return _keyed(docs).join(firsts, _same(firsts), "left_semi").select(COLUMNS)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of 50 words that an earlier document has; a text that loses none stays as it is."""
    _ready(spark)
    cut = substring_dedup.remove_repeats(docs, COLUMNS)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    left = cut.where("n_removed = 0 or kept <> ''").withColumn("text", text)
    return left.withColumn("n_chars", F.char_length("text").cast("long")).select(COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave out documents that hold ten words in a row of a benchmark item."""
    _ready(spark)
    found = decontaminate.find_passages(docs, table(spark, sf_dir, "benchmark"))
    dirty = _keys(found.where("size(hits) > 0"))
    return _keyed(docs).join(dirty, _same(dirty), "left_anti").select(COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and the place of each in a training sequence."""
    _ready(spark)
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeats", repeats),
    ("benchmark", benchmark),
    ("packed", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
