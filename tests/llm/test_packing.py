import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from edge import TEXTS, table

from trawlnet.deploy import ship
from trawlnet.llm.packing import pack_documents, plan, token_ids
from trawlnet.llm.queries import tokenizer_path
from trawlnet.llm.units import byte_level

SF_DIR = "/root/testdata/sf0.001"


def ids_of(text):
    return [*byte_level(tokenizer_path()).tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def expected(rows, size):
    out = []
    for doc_id, text in rows:
        ids = ids_of(text)
        head = len(ids) % size or size
        cuts = [0, *range(head, len(ids) + 1, size)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            crc = zlib.crc32(np.array(ids[a:b], "<u4").tobytes())
            out.append((doc_id, piece, a, b - a, crc))
    return Counter(out)


def check(spark, rows, size):
    ship(spark)
    found = pack_documents(table(spark, rows), tokenizer_path(), size).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == expected(rows, size)
    bins = defaultdict(list)
    for r in found:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in bins.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= size
    return len(bins), sum(r["length"] for r in found)


def test_odd_rows(spark):
    check(spark, TEXTS, 2048)
    check(spark, TEXTS, 7)


def test_no_rows(spark):
    assert check(spark, [], 2048) == (0, 0)


def test_documents_fill_their_sequences(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    n, total = check(spark, rows, 2048)
    assert n <= -(-total // 2048) + 1


def test_ids_are_those_of_whole_texts():
    texts = [t or "" for _, t in TEXTS] + ["a  b\n\n c 's ''s <|endoftext|><|endoftext|>  x  ", "  ", "\n", "x  <|endoftext|> y"]
    ids, lengths = token_ids(pa.array(texts), tokenizer_path())
    assert np.split(ids, np.cumsum(lengths)[:-1])[3].tolist() == ids_of(texts[3])[:-1]
    assert ids.tolist() == [i for t in texts for i in ids_of(t)[:-1]]
    none = token_ids(pa.array([None, ""], pa.string()), tokenizer_path())
    assert [x.tolist() for x in none] == [[], [0, 0]]


def test_plan_uses_every_piece_and_leaves_little_room():
    draw = random.Random(5)
    for size in (8, 64, 500):
        counts = Counter(draw.randrange(1, size + 1) for _ in range(2000))
        patterns = plan(counts, size)
        used = Counter()
        for pattern, times in patterns:
            assert sum(pattern) <= size
            for x in pattern:
                used[x] += times
        assert used == counts
        least = -(-sum(x * n for x, n in counts.items()) // size)
        assert sum(t for _, t in patterns) <= 1.03 * max(least, sum(n for x, n in counts.items() if 2 * x > size)) + 1
    assert plan({}, 8) == []


def test_exact_complements_are_found():
    assert sum(t for _, t in plan({7: 3, 3: 3}, 10)) == 3
    assert sum(t for _, t in plan({5: 4, 3: 4, 2: 4}, 10)) == 4
    assert sum(t for _, t in plan({4: 5, 3: 5, 2: 5, 1: 5}, 10)) == 5
