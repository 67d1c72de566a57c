import json
import os
import subprocess
import sys
import time
import uuid

import pytest
from pyspark.sql import functions as F

from trawlnet.operators.embed import embed, hashing_model
from trawlnet.plans.index import build_index, read_postings, read_statistics
from trawlnet.sources import golden, runs, splits, store
from trawlnet.sources.scan import spread_small
from trawlnet.sources.scratch import materialize, scratch_path, scratch_scope


def test_landing_is_idempotent_and_repairs_broken_folders(spark, tmp_path):
    base = str(tmp_path)
    parts = {"train": spark.range(3), "test": spark.range(10, 12)}
    assert splits.land_splits(parts, base) == ["train", "test"]
    other = {name: spark.range(100) for name in parts}
    assert splits.land_splits(other, base) == []
    os.remove(f"{base}/test/_SUCCESS")
    assert splits.land_splits(parts, base) == ["test"]
    rows = splits.read_splits(spark, base, ["train", "test"]).collect()
    assert sorted((r.id, r.split) for r in rows) == [
        (0, "train"), (1, "train"), (2, "train"), (10, "test"), (11, "test"),
    ]


def test_filings_of_one_year_keep_apart(spark, tmp_path):
    rows = [("1", "1999", f, s, "the same text") for f, s in (("a", "train"), ("b", "train"), ("a", "test"))]
    filings = spark.createDataFrame(rows, "cik string, year string, filename string, split string, section_1 string")
    build_index(filings, str(tmp_path), hashing_model(4), "m/x y", sections=("section_1",))
    chunks = store.read_store(spark, f"{tmp_path}/store", model="m/x y").collect()
    assert len({r.chunk_id for r in chunks}) == 3
    assert {r.filename for r in chunks} == {"train/a", "train/b", "test/a"}


def test_union_goes_by_name(spark):
    a = spark.createDataFrame([(1, "x")], "a int, b string")
    b = spark.createDataFrame([("y", 2)], "b string, a int")
    rows = splits.tag_and_union({"l": a, "r": b}).collect()
    assert sorted(tuple(r) for r in rows) == [(1, "x", "l"), (2, "y", "r")]


def wide(spark, keys=("5272", "05272", "AB")):
    rows = [(k, str(1999 + i), f"text of {k} ", "  ", None) for i, k in enumerate(keys)]
    columns = "cik string, year string, section_1 string, section_1A string, section_2 string"
    return spark.createDataFrame(rows, columns)


def test_index_and_store(spark, tmp_path):
    base = str(tmp_path)
    sections = ("section_1", "section_1A", "section_2")
    model = hashing_model(8)
    build_index(wide(spark), base, model, "m", sections=sections, size=50, overlap=5)
    rows = store.read_store(spark, f"{base}/store").orderBy("cik").collect()
    assert [(r.cik, r.year, r.section, r.chunk) for r in rows] == [
        ("05272", "2000", "section_1", "text of 05272"),
        ("5272", "1999", "section_1", "text of 5272"),
        ("AB", "2001", "section_1", "text of AB"),
    ]
    assert all(len(r.embedding) == 8 for r in rows)
    # another run stands beside it; the same run is replaced
    one = wide(spark, ["5272"])
    build_index(one, base, model, "m", sections=sections, size=60, overlap=5)
    build_index(one, base, model, "m", key="5272", sections=sections, size=60, overlap=5)
    assert store.read_store(spark, f"{base}/store").count() == 4
    assert store.read_store(spark, f"{base}/store", size=60).count() == 1
    # a run that is made again has no chunk of the years it no longer has
    build_index(wide(spark, ["x"]), base, model, "m", sections=sections, size=50, overlap=5)
    assert [r.year for r in store.read_store(spark, f"{base}/store", size=50).collect()] == ["1999"]
    words = read_statistics(spark, base, "m", 50, 5)
    assert {r.term for r in words.collect()} == {"text", "of", "x", None}
    manifests = store.read_manifest(spark, f"{base}/info").orderBy("chunk_size").collect()
    assert [tuple(r) for r in manifests] == [("m", 50, 5), ("m", 60, 5)]


def counting(folder, fail_on=None):
    """A model that notes the texts it sees in files, as it runs in other processes."""

    def make():
        def model(texts):
            for t in texts:
                if t == fail_on:
                    raise RuntimeError("out of service")
                (folder / uuid.uuid4().hex).write_text(t)
            return [[float(len(t)), 1.0] for t in texts]

        return model

    return make


def test_only_new_texts_are_embedded(spark, tmp_path):
    seen = tmp_path / "seen"
    seen.mkdir()
    base, settings = str(tmp_path / "index"), {"sections": ("section_1",), "size": 50, "overlap": 0}

    def build(texts):
        rows = [(str(i), str(1999 + i % 2), t) for i, t in texts.items()]
        build_index(spark.createDataFrame(rows, "cik string, year string, section_1 string"), base, counting(seen), "m", **settings)
        new = sorted(f.read_text() for f in seen.iterdir())
        for f in seen.iterdir():
            f.write_text("")
        rows = store.read_store(spark, f"{base}/store").collect()
        assert {int(r.cik): r.chunk for r in rows} == texts and len(rows) == len(texts)
        assert all(r.embedding == [float(len(r.chunk)), 1.0] for r in rows)
        postings = read_postings(spark, base, "m", 50, 0)
        assert sum(len(r["ids"]) for r in postings.ranges.collect()) == len(texts)
        return [t for t in new if t]

    assert build({1: "one", 2: "two", 3: "the same", 4: "the same"}) == ["one", "the same", "the same", "two"]
    # one text changed, one gone, a known text in a new place
    assert build({1: "one more", 3: "the same", 4: "the same", 5: "the same", 6: "two"}) == ["one more"]
    assert build({6: "two"}) == []
    terms = read_statistics(spark, base, "m", 50, 0).collect()
    assert {(r.year, r.term, r.n_chunks) for r in terms} == {("1999", "two", 1), ("1999", None, 1)}
    # the published version and the one before it are left
    run = store.run_path(f"{base}/store", "m", 50, 0)
    versions = sorted(d for d in os.listdir(run) if d.startswith("version="))
    assert len(versions) == 2 and versions[-1] == f"version={store.current(spark, run)}"


def test_a_failed_writer_leaves_the_old_run(spark, tmp_path):
    seen = tmp_path / "seen"
    seen.mkdir()
    base, settings = str(tmp_path / "index"), {"sections": ("section_1",), "size": 50, "overlap": 0}
    schema = "cik string, year string, section_1 string"
    old = spark.createDataFrame([(str(i), "1999", f"text {i}") for i in range(20)], schema)
    build_index(old, base, counting(seen), "m", **settings)
    reader = store.read_store(spark, f"{base}/store")
    before = sorted((r.chunk_id, r.chunk) for r in reader.collect())
    new = spark.createDataFrame([(str(i), "2000", f"new {i}") for i in range(20)], schema)
    with pytest.raises(Exception, match="out of service"):
        build_index(new, base, counting(seen, "new 13"), "m", **settings)
    for rows in (reader, store.read_store(spark, f"{base}/store")):
        assert sorted((r.chunk_id, r.chunk) for r in rows.collect()) == before
    assert read_statistics(spark, base, "m", 50, 0).where("term = 'text'").first()["n_chunks"] == 20
    # the next writer is not disturbed by what the failed one left, and a reader goes on with its version
    build_index(new, base, counting(seen), "m", **settings)
    assert {r.year for r in store.read_store(spark, f"{base}/store").collect()} == {"2000"}
    assert sorted((r.chunk_id, r.chunk) for r in reader.collect()) == before


def test_no_run_is_an_empty_store(spark, tmp_path):
    assert store.read_store(spark, str(tmp_path)).collect() == []
    with pytest.raises(FileNotFoundError):
        read_statistics(spark, str(tmp_path), "m", 1, 0)


def test_year_filter_prunes_partitions(spark, tmp_path, capsys):
    build_index(wide(spark), str(tmp_path), hashing_model(4), "m", sections=("section_1",))
    kept = store.read_store(spark, f"{tmp_path}/store").where(F.col("year").isin("1999"))
    kept.explain()
    filters = capsys.readouterr().out.split("PartitionFilters: [")[1].split("]")[0]
    assert "year" in filters and "1999" in filters
    assert kept.count() == 1


def test_indented_manifest(spark, tmp_path):
    info = {"embedding_model": "m", "chunk_size": 2000, "chunk_overlap": 100}
    (tmp_path / "info.json").write_text(json.dumps(info, indent=4))
    assert tuple(store.read_manifest(spark, str(tmp_path)).first()) == ("m", 2000, 100)


def test_golden_with_mixed_answers(spark, tmp_path):
    records = [
        {
            "prompt_id": i,
            "prompt": "p",
            "full_sentence": 'a\n• b "c"',
            "gt_answer": answer,
            "year": "2012",
            "section": "section_2",
        }
        for i, answer in enumerate(["5 percent", ["A/B", "C/D"], "$5 billion"])
    ]
    source = tmp_path / "golden.json"
    source.write_text(json.dumps(records, indent=4), encoding="utf-8")
    gold = golden.read_golden(spark, str(source))
    again = str(tmp_path / "again")
    golden.write_golden(gold, again)
    for df in (gold, golden.read_golden(spark, again, lines=True)):
        rows = df.orderBy("prompt_id").collect()
        assert [r.gt_text for r in rows] == ["5 percent", None, "$5 billion"]
        assert [r.gt_list for r in rows] == [None, ["A/B", "C/D"], None]
        assert rows[0].full_sentence == 'a\n• b "c"'


def test_scores(spark, tmp_path):
    rows = [(a, 10, 0.0, (a / 2, 0.5), (0.9,)) for a in (0.0, 0.5, 1.0)]
    bundles = spark.createDataFrame(
        rows,
        "alpha double, top_k int, temperature double, "
        "retriever struct<recall_k: double, mrr: double>, "
        "generator struct<exact_match_score: double>",
    )
    base = tmp_path / "written"
    runs.write_scores(bundles, str(base))
    got = runs.read_scores(spark, str(base)).orderBy("alpha").drop(*runs.STORE).collect()
    assert [tuple(r) for r in got] == [(a, 10, 0.0, a / 2, 0.5, 0.9) for a in (0.0, 0.5, 1.0)]
    # runs over another store stand beside them, also with an alpha that prints as a power
    other = bundles.where("alpha = 1").withColumns(
        {"embedding_model": F.lit("a/b"), "chunk_size": F.lit(50), "alpha": F.lit(0.0001)}
    )
    runs.write_scores(other, str(base))
    runs.write_scores(other.withColumn("chunk_size", F.lit(60)), str(base))
    rows = runs.read_scores(spark, str(base)).orderBy("alpha", "chunk_size").collect()
    assert [(r.alpha, r.embedding_model, r.chunk_size) for r in rows] == [
        (0.0, None, None), (0.0001, "a/b", 50), (0.0001, "a/b", 60), (0.5, None, None), (1.0, None, None),
    ]
    # several records in one file
    flat = "\n".join(json.dumps({"alpha": a, "retriever": {"recall_k": a, "mrr": a}}) for a in (0.1, 0.2))
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "x.json").write_text(flat + "\n")
    rows = runs.read_scores(spark, str(tmp_path / "lines")).orderBy("alpha").collect()
    assert [(r.alpha, r.recall_k, r.top_k) for r in rows] == [(0.1, 0.1, None), (0.2, 0.2, None)]
    # files of another writer: one indented object per folder
    folder = tmp_path / "found" / "config_alpha-0.5_topk-10_temperature-0.0"
    folder.mkdir(parents=True)
    scores = {"retriever": {"recall_k": 0.6, "mrr": 0.5}, "generator": {"exact_match_score": 0.8}}
    (folder / "scores.json").write_text(json.dumps(scores, indent=4))
    series = runs.metric_series(runs.read_scores(spark, str(tmp_path / "found")), ["alpha"])
    assert sorted((r.metric, r.value, r.label) for r in series.collect()) == [
        ("exact_match_score", 0.8, "Exact Match"),
        ("mrr", 0.5, "MRR"),
        ("recall_k", 0.6, "Recall@k"),
    ]


def test_embedding_calls_in_batches_and_in_order(spark):
    def make():
        def model(texts):
            assert len(texts) <= 3
            return [[float(t), float(len(texts))] for t in texts]

        return model

    df = spark.range(10).coalesce(1).select(F.col("id"), F.col("id").cast("string").alias("chunk"))
    rows = embed(df, make, batch_size=3).collect()
    assert [r.embedding[0] for r in rows] == [float(r.id) for r in rows]
    assert [r.embedding[1] for r in rows] == [3.0] * 9 + [1.0]


def test_hashing_model_is_stable_and_unit_length():
    model = hashing_model(16)()
    a, b, blank = model(["Red fox", "red  FOX\n", " "])
    assert (a == b).all() and abs((a**2).sum() - 1) < 1e-12 and not any(blank)


def test_scratch_is_below_the_shared_folder(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    assert scratch_path(spark, "x").startswith(f"{root}/trawlnet-") and "/x-" in scratch_path(spark, "x")
    assert materialize(spark.range(5), "five").count() == 5


def test_a_scope_leaves_no_scratch(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(spark.conf, "get", lambda key, *default: str(tmp_path), raising=False)
    outside = scratch_path(spark, "outside")
    with scratch_scope(spark):
        assert materialize(spark.range(5), "five").count() == 5
        assert os.listdir(os.path.dirname(outside))
    assert os.listdir(os.path.dirname(outside)) == []
    with pytest.raises(ZeroDivisionError), scratch_scope(spark):
        materialize(spark.range(5), "five")
        1 / 0
    assert os.listdir(os.path.dirname(outside)) == []


def test_the_driver_deletes_its_scratch(tmp_path):
    code = f"""
from pyspark.sql import SparkSession
from trawlnet.sources.scratch import materialize
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{tmp_path}").getOrCreate()
assert materialize(spark.range(5), "five").count() == 5
spark.stop()
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(__file__)), timeout=300)
    left = ["?"]
    for _ in range(100):
        left = [x for x in os.listdir(tmp_path) if x.startswith("trawlnet")]
        if not left:
            break
        time.sleep(0.3)  # the JVM outlives the driver's Python a little
    assert left == []


def test_spread_leaves_large_inputs_alone(spark):
    df = spark.range(100)
    assert spread_small(df, most_bytes=10) is df
    assert spread_small(df, most_bytes=10**6).rdd.getNumPartitions() == 8


def test_no_shared_folder_on_a_cluster_is_an_error():
    class Conf:
        def get(self, *args):
            return None

    class Session:
        conf = Conf()

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        scratch_path(Session(), "x")
