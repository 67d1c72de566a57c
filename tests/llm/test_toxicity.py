import random
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from edge import TEXTS, table
from pyspark.sql import functions as F

from trawlnet.deploy import ship
from trawlnet.llm import langid, toxicity

SF_DIR = "/root/testdata/sf0.01"


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, label int, text int, score int, terms string")


def example_rows(draw, n, terms):
    out = []
    for i in range(n):
        chosen = sorted(draw.sample(range(terms), draw.randrange(1, 6)))
        out.append({"doc_id": 1000 + i, "label": draw.randrange(2), "terms": chosen, "counts": [draw.randrange(1, 4) for _ in chosen]})
    return out


@pytest.mark.parametrize("n", [0, 1, 300, 3000])
def test_nearest_against_all_cosines(n):
    draw = random.Random(n)
    terms, idf = np.arange(40), np.linspace(1, 5, 40)
    rows = example_rows(draw, n, 40)
    index = toxicity.build_index(rows, terms, idf, 0.1)
    dense = np.zeros((n, 40))
    for i, r in enumerate(rows):
        dense[i, r["terms"]] = (1 + np.log(r["counts"])) * idf[r["terms"]]
        dense[i] /= np.linalg.norm(dense[i])
    for _ in range(60):
        asked = np.array(sorted(draw.sample(range(40), draw.randrange(1, 7))))
        weight = idf[asked] / np.linalg.norm(idf[asked])
        without = 1000 + draw.randrange(max(n, 1))
        cosine = dense[:, asked] @ weight if n else np.empty(0)
        cosine = np.delete(cosine, without - 1000) if n else cosine
        _, near = index.nearest(asked, weight, without, 15)
        best = np.sort(cosine[cosine > 0])[::-1][:15]
        assert len(near) == len(best) and np.allclose(np.sort(near)[::-1], best)


def test_odd_rows(spark):
    ship(spark)
    labels = labelled(spark, [(1, 1, None, None, None), (2, 0, None, None, None), (2, 0, None, None, None), (None, 1, None, None, None), (5, None, None, None, None), (99, 1, None, None, None), (7, 5, None, None, None)])
    for some in (labels, labels.limit(0)):
        rows = toxicity.score(table(spark), some).collect()
        assert len(rows) == len(TEXTS)
        assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert toxicity.score(table(spark, []), labels).count() == 0


def test_words_that_tell(spark):
    ship(spark)
    draw = random.Random(4)
    docs, labels = [], []
    for i in range(1200):
        bad = i % 10 == 0
        text = [f"w{chr(97 + draw.randrange(26))}{chr(97 + draw.randrange(26))}" for _ in range(60)]
        if bad:
            text[draw.randrange(60)] = draw.choice(["Vile", "nasty,", "vilest", "nastyish"])
        docs.append((i, " ".join(text)))
        if i % 2 == 0:
            labels.append((i, int(bad), None, None, None))
    docs.append((5000, "a vile text of other words"))
    docs.append((5001, ""))
    rows = {r["doc_id"]: r for r in toxicity.score(table(spark, docs), labelled(spark, labels)).collect()}
    assert rows[5000]["predicted"] == 1 and rows[5000]["neighbours"] and rows[5001]["predicted"] == 0
    wrong = sum(rows[i]["predicted"] != (i % 10 == 0) for i in range(1200))
    assert wrong <= 12


def test_held_out_labels(spark):
    ship(spark)
    docs, labels = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("documents", "labels"))
    held_out = langid.remainder(F.col("doc_id"), 4) == 2
    scored = toxicity.score(docs, labels.where(~held_out).select("doc_id", F.col("toxic").alias("label")))
    found = scored.join(labels.where(held_out), "doc_id").groupBy("toxic", "predicted").count().collect()
    n = {(r["toxic"], r["predicted"]): r["count"] for r in found}
    assert n[1, 1] >= 0.6 * (n[1, 1] + n.get((1, 0), 0))
    assert n[0, 0] >= 0.95 * (n[0, 0] + n.get((0, 1), 0))


@pytest.mark.parametrize("share", [4, 6])
def test_any_base_rate(spark, share):
    """With ``share`` of 10 labelled texts bad: texts are told apart, and every text meets its copy."""
    ship(spark)
    draw = random.Random(share)
    docs, labels = [], []
    for i in range(1200):
        text = [f"w{chr(97 + draw.randrange(26))}{chr(97 + draw.randrange(26))}" for _ in range(40)]
        if i % 10 < share:
            text[draw.randrange(40)] = draw.choice(["vile", "nasty"])
        docs.append((i, " ".join(text)))
        if i % 2 == 0:
            labels.append((i, int(i % 10 < share), None, None, None))
    copy = "quaint remark without any other known thing"
    docs += [(3000, copy), (3001, copy), (3002, "quaint remark")]
    labels.append((3000, 1, None, None, None))
    rows = {r["doc_id"]: r for r in toxicity.score(table(spark, docs), labelled(spark, labels)).collect()}
    wrong = sum(rows[i]["predicted"] != (i % 10 < share) for i in range(1200))
    assert wrong <= 24
    assert rows[3001]["neighbours"][0] == 3000 and rows[3001]["cosines"][0] > 0.999
    assert rows[3002]["neighbours"][0] == 3000


def test_calibrated_by_all_labels(spark, monkeypatch):
    """The four examples of the index are clean, and 296 other labelled texts like them bad: that rate counts."""
    ship(spark)
    monkeypatch.setattr(toxicity, "EXAMPLES", 4)
    docs = [(i, f"the same words {i % 2 and 'odd' or 'even'}") for i in range(600)]
    first = spark.range(300).orderBy(F.xxhash64("id"), "id").limit(4).collect()
    clean = {r["id"] for r in first}
    labels = [(i, int(i not in clean), None, None, None) for i in range(300)]
    rows = toxicity.score(table(spark, docs), labelled(spark, labels)).collect()
    assert len(rows) == 600 and all(r["score"] > 0.9 for r in rows)


def test_driver_holds_packed_postings_only(spark):
    """A posting takes the driver a byte or two and a temporary copy, not whole numbers of terms and counts."""
    ship(spark)
    n, each = 300, 3000
    words = F.transform(F.sequence(F.lit(1), F.lit(each)), lambda i: F.translate(F.hex(F.pmod(F.xxhash64("id", i), F.lit(4000))), "0123456789", "ghijklmnop"))
    docs = spark.range(n, numPartitions=4).select(F.col("id").alias("doc_id"), F.array_join(words, " ").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 5 == 0).cast("int").alias("label"))
    tracemalloc.start()
    try:
        toxicity.score(docs, labels)
        assert tracemalloc.get_traced_memory()[1] < 5_000_000
    finally:
        tracemalloc.stop()


def test_worker_holds_one_slice_of_the_index():
    """Votes by slices are those by the whole index, in a fraction of its memory."""
    draw = np.random.default_rng(1)
    words = np.array([f"w{chr(97 + i // 676)}{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}" for i in range(4000)])
    texts = pa.array([" ".join(words[draw.integers(0, 4000, 200)]) for _ in range(2000)])
    terms = np.unique(toxicity._terms(texts)[1])
    text, term, count = toxicity._terms(texts, terms)
    gain = draw.random(len(terms)) + 0.1
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(30)), texts.slice(0, 30)], names=["doc_id", "text"])

    def votes(of_slice):
        of = text // of_slice
        parts = [[toxicity.pack(term[of == i], text[of == i] - i * of_slice, count[of == i], len(terms))] for i in range(-(-2000 // of_slice))]
        packed = toxicity.Packed(np.arange(2000), np.arange(2000) % 5 / 4.0, terms, gain, 0.5, of_slice, parts)
        tracemalloc.start()
        try:
            found = list(toxicity._voted(SimpleNamespace(value=packed), 15, ["doc_id"], True, 1 << 22)(iter([batch])))
            return found[0].to_pylist(), tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    (whole, most), (sliced, less) = votes(2048), votes(256)
    assert [r["neighbours"] for r in whole] == [r["neighbours"] for r in sliced]
    assert all(np.allclose(a["cosines"], b["cosines"]) and abs(a["vote"] - b["vote"]) < 1e-9 for a, b in zip(whole, sliced, strict=True))
    assert all(len(r["neighbours"]) == 15 and r["doc_id"] not in r["neighbours"] for r in sliced)
    assert less < most / 2


def test_heavy_terms_go_first(monkeypatch):
    """A text with a telling term meets the few examples that can be near it and reads no list of other terms.

    Light terms, rows of the matrix, equal examples, ids left out and any order of the slices change nothing.
    """
    draw = np.random.default_rng(5)
    n, n_terms = 3000, 600
    gain = np.where(np.arange(n_terms) >= 580, 4.0, 0.02 * np.linspace(1.5, 9, n_terms))
    chance = np.where(np.arange(n_terms) >= 580, 0.01, 0.3 / (1 + np.arange(n_terms) / 30))
    counts = (draw.random((n, n_terms)) < chance) * draw.integers(1, 4, (n, n_terms))
    counts[:, 0] = 1  # no example is empty
    counts[7] = counts[2500] = counts[1200]
    dense = (1 + np.log(np.maximum(counts, 1))) * (counts > 0) * gain
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    example, term = np.nonzero(counts)
    order = np.argsort(-np.linalg.norm(dense[:, :580], axis=1), kind="stable")
    place = np.argsort(order)[example]
    parts = [[toxicity.pack(term[at], place[at] % 512, counts[example[at], term[at]], n_terms)] for at in (place // 512 == i for i in range(6))]
    heavy = toxicity._by_term(*(pa.chunked_array([[list(x) for x in y]]) for y in zip(*((np.flatnonzero(r[580:]) + 580, r[580:][r[580:] > 0]) for r in dense), strict=True)))
    packed = toxicity.Packed(np.arange(n) // 2, np.zeros(n), np.arange(n_terms), gain, 0.5, 512, parts, order, heavy)
    monkeypatch.setattr(toxicity, "LEFT", 40)
    led = whole = 0
    slices = list(packed.slices())
    for i in [*range(0, n, 60), 1200]:
        asked = np.flatnonzero(counts[i])
        weight, without = dense[i, asked], -1 if i % 120 else i // 2
        floor = packed.floor(asked, weight, without, 15)
        near = []
        for index in slices:
            found = index.led(asked, weight, without, 15, floor)
            led, whole = led + (found is not None), whole + (found is None)
            near.append(index.nearest(asked, weight, without, 15, None, floor) if found is None else found)
        found, cosine = toxicity._top(*(np.concatenate(x) for x in zip(*near, strict=True)), 15)
        want = dense @ dense[i]
        want[(np.arange(n) // 2 == without) | (want <= 0)] = -1
        best = np.lexsort((np.arange(n), -np.round(want, 6)))[:15]
        assert np.allclose(cosine, want[best], atol=1e-6) and np.allclose(want[found], want[best], atol=1e-6)
        if without == -1 and i == 1200:
            assert [x for x in found if x in (7, 1200, 2500)] == [7, 1200, 2500]
    assert led and whole


def test_texts_with_telling_terms_take_no_slice(monkeypatch):
    """Near examples of most texts are found before any slice is unpacked; those of all are the nearest of all examples."""
    draw = np.random.default_rng(3)
    n, of_slice = 600, 128
    letters = [chr(97 + i) for i in range(26)]
    light, telling = ([f"{a}{''.join(x)}" for x in draw.choice(letters, (m, size))] for a, m, size in (("w", 400, 3), ("z", 12, 2)))
    texts = [" ".join([*draw.choice(light, 40), *(draw.choice(telling, draw.integers(1, 4)) if i % 2 else [])]) for i in range(n)]
    texts[9] = texts[11] = texts[200] = texts[7]
    texts[8] = texts[10] = texts[100]
    terms = np.unique(toxicity._terms(pa.array(texts))[1])
    text, term, count = toxicity._terms(pa.array(texts), terms)
    gain = np.where(np.isin(terms, toxicity._terms(pa.array(telling))[1]), 6.0, 0.02 * draw.uniform(1, 3, len(terms)))
    dense = np.zeros((n, len(terms)))
    dense[text, term] = (1 + np.log(count)) * gain[term]
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    order = np.argsort(-np.linalg.norm(dense[:, gain < 1], axis=1), kind="stable")
    place = np.argsort(order)[text]
    parts = [[toxicity.pack(term[at], place[at] % of_slice, count[at], len(terms))] for at in (place // of_slice == i for i in range(5))]
    some = [np.flatnonzero((gain >= 1) & (row > 0)) for row in dense]
    heavy = toxicity._by_term(pa.chunked_array([[x.tolist() for x in some]]), pa.chunked_array([[row[x].tolist() for row, x in zip(dense, some, strict=True)]]))
    packed = toxicity.Packed(np.arange(n), np.zeros(n), terms, gain, 0.5, of_slice, parts, order, heavy)
    unpacked, unpack = [], toxicity._unpacked
    monkeypatch.setattr(toxicity, "_unpacked", lambda *x: unpacked.append(1) or unpack(*x))

    def check(asked, leave_out):
        batch = pa.RecordBatch.from_arrays([pa.array(asked), pa.array([texts[i] for i in asked])], names=["doc_id", "text"])
        for r in (r for b in toxicity._voted(SimpleNamespace(value=packed), 15, ["doc_id"], leave_out, 1 << 22)(iter([batch])) for r in b.to_pylist()):
            want = dense @ dense[r["doc_id"]]
            if leave_out:
                want[r["doc_id"]] = -1
            best = np.lexsort((np.arange(n), -np.round(want, 6)))[:15]
            assert np.allclose(r["cosines"], want[best], atol=1e-6) and np.allclose(want[r["neighbours"]], want[best], atol=1e-6)
            if r["doc_id"] == 200:
                assert r["neighbours"][:3] == [7, 9, 11]

    check(list(range(1, n, 2)), False)
    assert not unpacked
    check(list(range(n)), False)
    assert len(unpacked) == 5
    check(list(range(n)), True)
    assert len(unpacked) == 10
