"""The stages on a small table, against plain versions of what each has to keep."""

import pytest
from edge import SCHEMA, TEXTS, table
from test_decontaminate import brute as brute_passages
from test_jaccard_join import brute as brute_groups
from test_packing import expected
from test_substring_dedup import brute as brute_repeats

import corpus_pipeline
from trawlnet.sources.scratch import materialize

SF_DIR = "/root/testdata/sf0.001"


def rows_of(df):
    return {(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def stages(spark):
    """Rows after every stage, the first entry being the table itself."""
    docs, out = spark.read.parquet(f"{SF_DIR}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        out.append(docs)
        docs = materialize(stage(spark, docs, SF_DIR), "stage")
    return [*out, docs]


def test_stages_in_order(spark, stages):
    before = [rows_of(s) for s in stages[:-1]]
    raw, known, unlike, cut, clean = before
    assert known == {(i, t) for i, t in raw if any(c.isalpha() for c in t or "")}
    first = {i for i, _, c in brute_groups(sorted(known)) if i == c}
    assert unlike == {(i, t) for i, t in known if i in first}
    left = {i: (n, kept) for i, _, n, kept in brute_repeats(sorted(unlike), 50)}
    assert cut == {(i, left[i][1] if left[i][0] else t) for i, t in unlike if not left[i][0] or left[i][1]}
    items = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").select("item_id", "text").collect()]
    dirty = {i for i, _, hit, _ in brute_passages(sorted(cut), items) if hit}
    assert clean == {(i, t) for i, t in cut if i not in dirty} and dirty
    packed = stages[-1].collect()
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed} == set(expected(clean, 2048))


def test_columns_of_documents(stages):
    for stage in stages[:-1]:
        assert stage.columns == corpus_pipeline.COLUMNS
    for row in stages[-2].limit(50).collect():
        assert row["n_chars"] == len(row["text"])


def test_many_languages_in_equal_parts_stay(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    longest = {r["lang"]: r["text"] for r in docs.orderBy("n_chars").collect()}
    mixed = "\n".join(text[:400] for text in longest.values())
    assert len(longest) >= 4
    more = docs.unionByName(spark.createDataFrame([(99_999, mixed, "mixed", "web", len(mixed))], docs.schema))
    kept = corpus_pipeline.language(spark, more, SF_DIR).where("doc_id = 99999").collect()
    assert [r["text"] for r in kept] == [mixed]


@pytest.mark.parametrize("rows", [TEXTS, []])
def test_odd_rows(spark, rows):
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, table(spark, rows, SCHEMA), SF_DIR)
        assert out.count() >= (len(rows) > 0)
