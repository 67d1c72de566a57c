"""Scores of evaluation runs as nested JSON, one folder per run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Nesting of a scores file, its folder name, and the names shown to readers.
SCORES = "retriever struct<recall_k: double, mrr: double>, generator struct<exact_match_score: double>"
FOLDER = "config_alpha-%s_topk-%s_temperature-%s"
FOLDER_PATTERN = r"alpha-([0-9.eE+-]+)_topk-([0-9]+)_temperature-([0-9.eE+-]+)"
#: What else a run depends on: the store that it searched. Columns of the bundles where known.
STORE = ("embedding_model", "chunk_size", "chunk_overlap")
SETTINGS = "alpha double, top_k int, temperature double, embedding_model string, chunk_size int, chunk_overlap int"
METRIC_LABELS = {"recall_k": "Recall@k", "mrr": "MRR", "exact_match_score": "Exact Match"}


def write_scores(bundles: DataFrame, base: str) -> None:
    """Write all runs of a sweep in one job.

    ``bundles`` has one row per run: alpha, top_k, temperature, retriever, generator, and where
    runs over several stores are kept together embedding_model, chunk_size and chunk_overlap.
    Settings are written as columns, one record per line; the folder names them for readers
    and separates runs. Runs that stand below ``base`` already are kept unless they are
    written again.
    """
    named = bundles
    for name in STORE:
        if name not in bundles.columns:
            kind = "string" if name == "embedding_model" else "int"
            named = named.withColumn(name, F.lit(None).cast(kind))
    settings = [F.col(c).cast("string") for c in ("alpha", "top_k", "temperature")]
    store = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in STORE]
    known = F.coalesce(*[F.col(c).cast("string") for c in STORE]).isNotNull()
    folder = F.format_string(FOLDER, *settings)
    folder = F.when(known, F.concat_ws("_", folder, *store)).otherwise(folder)
    columns = ["alpha", "top_k", "temperature", *STORE, "retriever", "generator"]
    named = named.select(folder.alias("config"), *columns)
    writer = named.repartition("config").write.mode("overwrite").partitionBy("config")
    writer.option("partitionOverwriteMode", "dynamic").json(base)


def read_scores(spark: SparkSession, base: str) -> DataFrame:
    """Scan the scores of all runs below ``base`` and flatten them.

    Files of one record per line and indented files of one record are both read. Settings
    that a record does not hold come from the folder name, so runs written elsewhere under
    the same naming are read as well; those that neither tells are NULL.
    """
    files = spark.read.text(base, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json")
    files = files.select("value", F.col("_metadata.file_path").alias("path"))
    # one score file is a few hundred bytes; a line that is a whole record is one record
    whole = F.from_json("value", f"{SETTINGS}, {SCORES}")
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "")
    each = F.when(F.forall(lines, lambda x: x.rlike(r"^\s*\{.*\}\s*$")), lines)
    records = F.coalesce(F.transform(each, lambda x: F.from_json(x, f"{SETTINGS}, {SCORES}")), F.array(whole))
    raw = files.select("path", F.explode(records).alias("r")).select("path", "r.*")

    def named(place: int, kind: str) -> Column:
        return F.regexp_extract("path", FOLDER_PATTERN, place).try_cast(kind)

    return raw.select(
        F.coalesce("alpha", named(1, "double")).alias("alpha"),
        F.coalesce("top_k", named(2, "int")).alias("top_k"),
        F.coalesce("temperature", named(3, "double")).alias("temperature"),
        *STORE,
        F.col("retriever.recall_k").alias("recall_k"),
        F.col("retriever.mrr").alias("mrr"),
        F.col("generator.exact_match_score").alias("exact_match_score"),
    )


def metric_series(scores: DataFrame, run_columns: list[str]) -> DataFrame:
    """Flat scores to one row per run and metric, with the name shown to readers."""
    long = scores.unpivot(run_columns, list(METRIC_LABELS), "metric", "value")
    label = F.create_map(*[F.lit(x) for pair in METRIC_LABELS.items() for x in pair])
    return long.withColumn("label", label[F.col("metric")])
