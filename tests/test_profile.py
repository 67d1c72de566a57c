import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trawlnet.operators import clean, profile

KEYS = ["5272", "05272", "AB", None]
TEXTS = [None, "", "   ", "a \n", "a\xa0", "b  ", "\t "]


def test_string_keys(spark):
    df = spark.createDataFrame([(k,) for k in KEYS], "cik string")
    assert [r.cik for r in clean.entity(df, 5272).collect()] == ["5272"]
    row = profile.counts(df, {"zero": F.col("cik").startswith("0"), "ab": F.col("cik") == "AB"})
    assert tuple(row.first()) == (4, 1, 1)


def test_clean(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "description string")
    got = [r.description for r in clean.clean_sections(df).collect()]
    assert got == ["a \n", "a\xa0", "b", "\t"]


def test_unpivot_has_all_sections_and_keeps_null(spark):
    assert len(clean.SECTIONS) == 20
    row = {"cik": "1", "year": "1999"} | {s: None for s in clean.SECTIONS}
    schema = ", ".join(f"{c} string" for c in row)
    long = clean.unpivot_sections(spark.createDataFrame([tuple(row.values())], schema))
    assert [r.section for r in long.collect()] == list(clean.SECTIONS)


def test_null_and_blank_counts(spark):
    df = spark.createDataFrame([("a", t) for t in TEXTS], "k string, description string")
    assert {r[0]: r[1] for r in profile.null_counts(df).collect()} == {"k": 0, "description": 1}
    blanks = profile.blank_counts(df, ["description"]).collect()
    assert [tuple(r) for r in blanks] == [("description", 1)]


def test_lookups(spark):
    df = spark.createDataFrame([("1", "a"), ("2", "b"), ("2", "a")], "year string, section string")
    assert clean.lookup(df, year="2", section="a").count() == 1
    assert clean.lookup(df, year="9", section="a").collect() == []
    keys = spark.createDataFrame([("2", "a"), ("2", "a"), ("1", "a")], "year string, section string")
    assert clean.lookup_many(df, keys).count() == 2


@pytest.fixture(scope="module")
def lengths():
    rng = np.random.default_rng(3)
    return [int(x) for x in rng.lognormal(4, 1.2, 501)]


def test_lengths_equal_pandas(spark, lengths):
    df = spark.createDataFrame([(x,) for x in lengths], "n long")
    values = pd.Series(lengths)
    row = profile.token_budget(df, "n", 0.7, 500).first()
    assert tuple(row) == (int(values.quantile(0.7)), values.sum(), values.sum() // 500)
    row = profile.summary(df, "n").first()
    mean = float(np.round(np.mean(lengths), 2))
    assert tuple(row) == (max(lengths), min(lengths), mean, np.median(lengths))
    q1, q2, q3 = values.quantile([0.25, 0.5, 0.75])
    low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    inside = values[(values >= low) & (values <= high)]
    row = profile.box(df, "n").first()
    assert tuple(row) == (q1, q2, q3, inside.min(), inside.max(), len(values) - len(inside))
    outside = sorted(values[(values < low) | (values > high)])
    assert sorted(r.n for r in profile.outliers(df, "n").collect()) == outside


def test_preview_and_samples(spark):
    df = spark.createDataFrame([(i, "x" * i) for i in range(40)], "i int, t string")
    rows = profile.preview(df.orderBy("i"), 8, 6).collect()
    assert [r.t for r in rows] == ["x" * i for i in range(7)] + ["xxx..."]
    assert profile.random_rows(df, 20, seed=1).count() == 20
    first = profile.hashed_rows(df, 5, "i").collect()
    assert first == profile.hashed_rows(df.repartition(3), 5, "i").collect()


def test_schema_and_split_sizes(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "split string, n int")
    assert [tuple(r) for r in profile.schema_table(df).collect()] == [
        (0, "split", "string"),
        (1, "n", "int"),
    ]
    assert {r.split: r.n_rows for r in profile.split_sizes(df).collect()} == {"a": 2, "b": 1}


def test_other_token_counter(spark):
    df = spark.createDataFrame([("a b  c",)], "t string")
    assert profile.token_counts(df, "t").first().token_count == 3
    assert profile.token_counts(df, "t", F.length).first().token_count == 6
