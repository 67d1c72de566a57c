import ast
import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from trawlnet.functions import batches, text, vector
from trawlnet.operators import lexical
from workload import queries


def column(spark, values, expression, kind="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, x {kind}").select("i", expression.alias("y"))
    return [r.y for r in df.orderBy("i").collect()]


SPACED = [
    "plain words here",
    "  lead and trail \n",
    "tab\tand\x0bvertical\x0cform\rfeed",
    "no\xa0break em　wide\x85next\x1cfile",
    "",
    "   ",
    "​zero width stays",
    "One, two.THREE",
]


def test_tokens_equal_python_split(spark):
    got = column(spark, SPACED, text.tokens("x"))
    assert got == [s.lower().split() for s in SPACED]


def test_tokens_of_null_are_empty(spark):
    assert column(spark, [None], text.tokens("x")) == [[]]


def test_words_in_batches_equal_words_on_the_jvm(spark):
    values = [*SPACED, None, "A\x85b"]
    want = column(spark, values, text.words("x"))
    assert column(spark, values, batches.words("x")) == want
    assert column(spark, values, batches.n_words("x")) == [len(w) for w in want]


def test_batches_split_where_python_does():
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    _, lengths = batches.split_words(pa.array([f"a{chr(c)}b" for c in points]))
    assert [n == 2 for n in lengths] == [chr(c).isspace() for c in points]


def test_neighbours_and_wanted_words():
    texts = ["a b c", None, "d", "", "e f", " "]
    flat, lengths = batches.split_words(pa.array(texts))
    pairs = batches.as_lists(*batches.neighbours(flat, lengths)).to_pylist()
    assert pairs == [["a b", "b c"], [], [], [], ["e f"], []]
    kept = batches.as_lists(*batches.only(flat, lengths, pa.array(["c", "e", "x"]))).to_pylist()
    assert kept == [["c"], [], [], [], ["e"], []]
    for few in ([], ["", None], ["a"]):
        flat, lengths = batches.split_words(pa.array(few, pa.string()))
        assert batches.as_lists(*batches.neighbours(flat, lengths)).to_pylist() == [[]] * len(few)


def test_batches_are_cut_by_size():
    batch = pa.RecordBatch.from_pydict({"text": ["x" * 100] * 10})
    cut = list(batches.pieces(batch, 300))
    assert sum(p.num_rows for p in cut) == 10 and max(p.num_rows for p in cut) <= 3
    assert list(batches.pieces(batch)) == [batch]
    assert list(batches.pieces(batch.slice(0, 0))) == []


def test_strip_equals_python_strip(spark):
    assert column(spark, SPACED, text.strip("x")) == [s.strip() for s in SPACED]


def test_whitespace_is_what_python_strips():
    assert set(text.WHITESPACE) == {c for c in map(chr, range(0x110000)) if c.isspace()}


def test_html(spark):
    values = ["<p>x</p>", "a < b > c", "<br/>", "no", None, "</p> only", "<a\nhref='x'>"]
    got = column(spark, values, text.has_html("x"))
    assert got == [True, False, True, False, None, False, True]


def test_years(spark):
    values = ["in 2012 and 1999, again 2012", "order 12345, year 3012", None, "none"]
    assert column(spark, values, text.years("x")) == [["2012", "1999"], [], [], []]


def test_shorten(spark):
    assert column(spark, ["abcdefgh", "abc", None], text.shorten("x", 6)) == ["abc...", "abc", None]


def test_printed_list_equals_python_reading(spark):
    good = [
        "['a', 'b']",
        ' ["it\'s", \'x\']\n',
        "[]",
        "['a',]",
        "('a', 'b')",
        r"['don\'t', 'a\\b']",
        "['New York/New York', 'Paris/Texas']",
        "'a', 'b'",
        "'a',",
        "('a',)",
        "()",
        r"['a\nb', '\x41', '\u00e9\U0001F600', '\101', '\q', 'a\tb', '\0']",
    ]
    sets = ["{'a', 'b'}", "{'a',}"]
    bad = ["['a', 'b'", "a, b", "", None, "['a' 'b', c]", "{'a': 1}", "['a', 'b')", "('a')", "'a'"]
    bad += ["['a\nb']", r"['\x4']", r"['\u12']", "(,)"]
    got = column(spark, good + bad, text.printed_list("x"))
    assert got[: len(good)] == [list(ast.literal_eval(g.strip())) for g in good]
    assert [set(x) for x in column(spark, sets, text.printed_list("x"))] == [ast.literal_eval(s) for s in sets]
    assert got[len(good) :] == [None] * len(bad)


def test_same_text(spark):
    rows = [("A b", " a B\n"), ("a", "b"), (None, "a"), ("a", None)]
    df = spark.createDataFrame(rows, "l string, r string")
    got = [r[0] for r in df.select(text.same_text("l", "r")).collect()]
    assert got == [True, False, False, False]


def test_same_set(spark):
    rows = [(["a", "b"], ["b", "a", "a"]), (["a"], ["a", "b"]), (["a"], None), ([], [])]
    df = spark.createDataFrame(rows, "l array<string>, r array<string>")
    got = [r[0] for r in df.select(text.same_set("l", "r")).collect()]
    assert got == [True, False, False, True]


def test_vectors(spark):
    rows = [([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    got = df.select(vector.dot(a, b), vector.l2_norm(a), vector.cosine(a, b)).collect()
    assert tuple(got[0]) == (24.0, 5.0, 0.96)
    assert tuple(got[1]) == (0.0, 0.0, None)


def test_counting_words_of_a_large_batch_takes_little_memory():
    """Whatever the batch that Spark hands over, its words are looked at a piece at a time."""
    line = " ".join(f"w{i}" for i in range(400))
    batch = pa.RecordBatch.from_pydict({"year": ["en"] * 10_000, "text": [line] * 10_000})
    tracemalloc.start()
    try:
        counted = [lexical._count_batch(piece) for piece in batches.pieces(batch)]
        assert tracemalloc.get_traced_memory()[1] < 100 << 20
    finally:
        tracemalloc.stop()
    whole = [r for c in counted for r in c.to_pylist() if r["term"] is None]
    assert sum(r["n_tokens"] for r in whole) == 400 * 10_000


def test_queries_over_texts_get_small_batches(spark, tmp_path):
    docs = [(i, f"text {i}", "en", "web", 6) for i in range(10)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{tmp_path}/documents.parquet"
    )
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, "10000")
    try:
        spark.conf.unset(key)
        queries.registered()["store_roundtrip"](spark, str(tmp_path))
        assert int(spark.conf.get(key, "10000")) <= 2000
    finally:
        spark.conf.set(key, before)
