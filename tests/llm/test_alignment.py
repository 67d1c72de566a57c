import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from edge import LONG, SCHEMA, TEXTS, table

from trawlnet.deploy import ship
from trawlnet.llm.alignment import align, pack_postings, unpack_postings
from trawlnet.llm.queries import piece_path, tokenizer_path
from trawlnet.llm.units import byte_level, cut_units, piece_model

SF_DIR = "/root/testdata/sf0.001"
ODD = ["a  b   c", "x   b ", "é  è 　 z ", " lead", " ", " \n ", "it's 'tis  '", "a\x1c b \x85 c", "<s> </s> <0x0A>", "a ▁ b", "é" * 3000]
ODD += ["no" * 2000 + " x", "日本語 テスト  x", "\u0000 nul", "🙂🙂 🙂", "a  b", "--------------------- --", "<|endoftext|>"]


def expected(rows):
    """Tokens of whole texts, pairs counted one by one."""
    first, second = byte_level(tokenizer_path(), True), piece_model(piece_path())
    held, out = [], []
    for _, text in rows:
        a = first.tokenizer.encode(" " + text, add_special_tokens=False).ids if text else []
        b = second.model.encode(text) if text else []
        spelled = [b"".join(v.bytes[i] for i in ids) for v, ids in ((first, a), (second, b))]
        if not text or any(s != (" " + text).encode() for s in spelled):
            a, b = [], []
        ends = [np.cumsum([len(v.bytes[i]) for i in ids]).tolist() for v, ids in ((first, a), (second, b))]
        groups, cuts = defaultdict(lambda: ([], [])), sorted(set(ends[0]) & set(ends[1]))
        for side, (ids, end) in enumerate(zip((a, b), ends, strict=True)):
            for i, e in zip(ids, end, strict=True):
                groups[cuts[np.searchsorted(cuts, e)]][side].append(i)
        groups = [groups[c] for c in cuts]
        links = Counter((x, y) for g in groups for x in g[0] for y in g[1])
        printed = ";".join("|".join(",".join(map(str, s)) for s in g) for g in groups)
        held.append(links)
        out.append([len(a), len(b), len(groups), sum(links.values()), hashlib.sha256(printed.encode()).hexdigest() if groups else ""])
    count = Counter(p for links in held for p in links)
    most = Counter()
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    for row, links in zip(out, held, strict=True):
        best = sum(m for p, m in links.items() if count[p] == most[p[0]])
        row[4:4] = [best, sum(m * count[p] for p, m in links.items())]
    return Counter((i, *row) for (i, _), row in zip(rows, out, strict=True))


def check(spark, rows):
    ship(spark)
    df = table(spark, rows, SCHEMA + ", block string, a int, b int, count long, best int, slot int, docs binary, n_a string")
    found = align(df, tokenizer_path(), piece_path(), ["doc_id"])
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(map(tuple, found.collect())) == expected(rows)


def test_odd_texts(spark):
    check(spark, [(i, t) for i, t in TEXTS if t != LONG and not (t or "").startswith(LONG)] + [(100 + i, t) for i, t in enumerate(ODD)])


def test_no_rows(spark):
    check(spark, [])
    check(spark, [(1, None)])


def test_documents(spark):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    check(spark, [*map(tuple, rows), *map(tuple, rows[:20])])


@pytest.mark.parametrize("width", [1, 9, 4000])
def test_postings_round_trip(width):
    rng = np.random.default_rng(width)
    key = np.unique(rng.integers(0, 40 * width, 30 * width))
    pair, doc = key // width, key % width
    pair = np.where(pair < 3, 0, pair << 21 | 5)  # the first one in nearly all texts
    key = np.unique(pair * width + doc)
    pair, doc = key // width, key % width
    times = rng.choice([1, 1, 1, 2, 3, 500], len(key))
    packed = pack_postings(pair, doc, times, width)
    n = packed.column("n_docs").to_numpy()
    row, back, m = unpack_postings(n, packed.column("docs"), packed.column("planes"))
    a, b = (packed.column(c).to_numpy().astype(np.int64) for c in "ab")
    assert (a[row] << 20 | b[row]).tolist() == pair.tolist()
    assert back.tolist() == doc.tolist() and m.tolist() == times.tolist()


def test_units_are_encoded_as_whole_texts():
    texts = [" " + t for t in [*(t for _, t in TEXTS if t), *ODD]]
    for plain in (True, False):
        first = byte_level(tokenizer_path(), plain)
        import pyarrow as pa

        coded, n = cut_units(pa.array(texts))
        ids, counts = first.encode(coded.dictionary)
        parts = np.split(ids, np.cumsum(counts)[:-1])
        at = 0
        for text, k in zip(texts, n, strict=True):
            own = [x for c in coded.indices[at : at + k].to_pylist() for x in parts[c].tolist()]
            assert own == first.tokenizer.encode(text, add_special_tokens=False).ids
            at += k
