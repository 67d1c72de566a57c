import random
import tracemalloc

import numpy as np
import pyarrow as pa
from edge import TEXTS, table
from pyspark.sql import functions as F

from trawlnet.deploy import ship
from trawlnet.llm import langid

SF_DIR = "/root/testdata/sf0.01"
TRAIN = [
    ("the cat sat on the mat and the dog ran with the other dogs through the house", "en"),
    ("der hund und die katze sind nicht mit dem haus auf der straße gegangen", "de"),
    ("собака и кошка не пошли по улице вместе с другими собаками", "ru"),
    (None, "en"), ("no language", None), ("", "de"),
]


def toy(spark, rows=TRAIN):
    ship(spark)
    return langid.train(spark.createDataFrame(rows, "text string, lang string"))


def test_odd_rows(spark):
    model = toy(spark)
    assert model.langs == ["de", "en", "ru"]
    rows = langid.identify(table(spark), model, ["doc_id", "text"]).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters)
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == letters
        assert len(r["span_lang"]) == len(r["span_start"]) == len(r["span_end"])


def test_no_rows_and_no_languages(spark):
    model = toy(spark)
    assert langid.identify(table(spark, []), model, ["doc_id"]).count() == 0
    bare = toy(spark, [(None, None)])
    assert {r["lang_pred"] for r in langid.identify(table(spark), bare, ["doc_id"]).collect()} == {"und"}


def test_spans_of_mixed_text(spark):
    text = "the dog ran with the cat 12 собака и кошка не пошли der hund und die katze sind nicht auf der straße"
    row = langid.identify(table(spark, [(1, text)]), toy(spark), ["doc_id"]).first()
    assert row["span_lang"] == ["en", "ru", "de"]
    assert row["span_start"] == [0, 7, 12] and row["span_end"] == [6, 12, 22]
    assert row["lang_pred"] == "de"


def test_best_path_against_all_paths(spark):
    import itertools

    import numpy as np

    draw = np.random.default_rng(2)
    lengths = np.array([0, 5, 1, 7, 0, 3])
    scores = draw.normal(size=(int(lengths.sum()), 3)).astype(np.float32)
    best, at = langid._viterbi(scores, lengths, 0.8), 0
    for n in lengths:
        part = scores[at : at + n]

        def value(path, part=part):
            turns = sum(a != b for a, b in itertools.pairwise(path))
            return sum(part[i, s] for i, s in enumerate(path)) - 0.8 * turns

        top = max((value(p) for p in itertools.product(range(3), repeat=int(n))), default=0)
        assert abs(value(tuple(best[at : at + n])) - top) < 1e-4
        at += n


def test_held_out_accuracy(spark):
    ship(spark)
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    held_out = langid.remainder(F.col("doc_id"), 3) == 1
    model = langid.train(docs.where(~held_out))
    found = langid.identify(docs.where(held_out), model, ["doc_id", "lang"])
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98


def test_order_of_training_rows_does_not_matter(spark):
    rows = TRAIN[:3] * 3
    random.Random(0).shuffle(rows)
    one, two = toy(spark, TRAIN[:3] * 3), toy(spark, rows)
    assert (one.logp == two.logp).all() and (one.written == two.written).all()


def test_worker_labels_a_piece_at_a_time(spark, monkeypatch):
    """What a worker holds does not grow with its batches up to 8 MB."""
    model, docs = toy(spark), table(spark)
    ran = []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda _, run, schema: ran.append(run))
    langid.identify(docs, model, ["doc_id"])
    words = np.array([f"word{i % 97} die{i % 89} der{i}" for i in range(500)])
    draw = np.random.default_rng(3)
    texts = pa.array([" ".join(words[draw.integers(0, 500, 100)]) for _ in range(4100)])
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(texts))), texts], names=["doc_id", "text"])
    labelled = pa.RecordBatch.from_arrays([texts, pa.array(["de"] * len(texts))], names=["text", "lang"])
    assert 7 << 20 < texts.nbytes < 8 << 20
    langid._letters()
    for run, given in ((ran[0], batch), (langid._count, labelled)):
        tracemalloc.start()
        try:
            rows = sum(b.num_rows for b in run(iter([given])))
            most = tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()
        assert rows and most < 40_000_000, most
