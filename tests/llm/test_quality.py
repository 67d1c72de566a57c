import numpy as np
import pyarrow as pa
import pytest
from edge import TEXTS, table
from pyspark.sql import functions as F

from trawlnet.deploy import ship
from trawlnet.llm import quality

SF_DIR = "/root/testdata/sf0.01"


def test_odd_rows(spark):
    ship(spark)
    model = quality.train(table(spark))
    rows = quality.score(table(spark), model).collect()
    assert len(rows) == len(TEXTS)
    assert all(0 <= r["score"] <= 1 and 0 <= r["posterior"] <= 1 for r in rows)
    assert {r["score"] for r in rows if r["doc_id"] in (2, 3, 4)} == {0.0}
    empty = quality.train(table(spark, []))
    assert quality.score(table(spark, []), empty).count() == 0
    assert len(quality.score(table(spark), empty).collect()) == len(TEXTS)


def test_measures_against_plain_counts():
    texts = ["Aa bb## CC 12 aa aa x!", "", None, "É|| || ä", "ONE"]
    lengths, measures, *_ = quality._measure(pa.array(texts))
    assert lengths.tolist() == [7, 0, 0, 3, 1]
    of = dict(zip(quality.MEASURES, measures[0], strict=True))
    assert of["symbols"] == pytest.approx(2 / 16) and of["tails"] == pytest.approx(1 / 7)
    assert of["capitals"] == pytest.approx(3 / 11) and of["digits"] == pytest.approx(2 / 16)
    assert of["repeats"] == pytest.approx(1 / 7) and of["sameness"] == pytest.approx(1 / 7)
    assert of["bare"] == pytest.approx(1 / 7) and of["shouts"] == pytest.approx(1 / 7)


def test_accuracies_are_recovered():
    draw = np.random.default_rng(6)
    truth = draw.random(60_000) < 0.2  # bad
    votes = np.zeros((len(truth), 4), np.int64)
    find = [0.6, 0.3, 0.5, 0.4]
    for i, p in enumerate(find):
        votes[:, i] = np.where(draw.random(len(truth)) < np.where(truth, p, 0.01), 2, 0)
    pattern, n = np.unique(votes @ 3 ** np.arange(4), return_counts=True)
    weak = quality.expectation_maximisation(pattern, n, 4, 300)
    assert abs(weak.good - 0.8) < 0.03
    assert np.abs(weak.votes[:, 2, 1] - find).max() < 0.06
    assert weak.posterior[0] > 0.8 and weak.posterior[-1] < 0.01


def test_agrees_with_labels_it_never_saw(spark):
    ship(spark)
    docs, labels = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("documents", "labels"))
    scored = quality.score(docs, quality.train(docs)).join(labels, "doc_id")
    right = scored.groupBy("quality").agg(F.avg((F.col("quality") == F.col("predicted")).cast("int")).alias("share"))
    assert all(r["share"] > 0.9 for r in right.collect())
