"""Golden questions. ``gt_answer`` is a string in some records and a list in others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = "prompt_id int, prompt string, full_sentence string, gt_answer variant, year string, section string"


def write_golden(gold: DataFrame, path: str) -> None:
    """Write one JSON record per line from the columns ``gt_text`` and ``gt_list``."""
    plain = ["prompt_id", "prompt", "full_sentence"]
    meta = ["year", "section"]
    as_list = F.to_json(F.struct(*plain, F.col("gt_list").alias("gt_answer"), *meta))
    as_text = F.to_json(F.struct(*plain, F.col("gt_text").alias("gt_answer"), *meta))
    record = F.when(F.col("gt_list").isNotNull(), as_list).otherwise(as_text)
    gold.select(record.alias("value")).write.mode("overwrite").text(path)


def read_golden(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Read a JSON array (or JSON lines) and split the answer by its kind.

    The kind is that of the JSON value, so a string that looks like a list stays a string.
    """
    raw = spark.read.schema(FIELDS).option("multiLine", not lines).json(path)
    is_list = F.schema_of_variant("gt_answer").startswith("ARRAY")
    as_list = F.variant_get("gt_answer", "$", "array<string>")
    as_text = F.variant_get("gt_answer", "$", "string")
    return (
        raw.withColumn("gt_list", F.when(is_list, as_list))
        .withColumn("gt_text", F.when(~is_list, as_text))
        .drop("gt_answer")
    )
