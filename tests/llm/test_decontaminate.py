import random
import re

from edge import PASSAGE, TEXTS, ascii_lower, key, table
from pyspark.sql import functions as F

from trawlnet.llm.decontaminate import find_passages, n_hit_words


def plain(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text))


def brute(rows, items):
    windows = {}
    for item_id, text in items:
        w = plain(text)
        m = min(len(w), 10)
        for i in range(len(w) - m + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + m]), set()).add(item_id)
    sizes = {len(g) for g in windows}
    out = []
    for doc_id, text in rows:
        w, hit, found = plain(text), set(), set()
        for m in sizes:
            for i in range(len(w) - m + 1):
                who = windows.get(tuple(w[i : i + m]))
                if who:
                    hit.update(range(i, i + m))
                    found |= who
        ids = ",".join(sorted(str(i) for i in found if i is not None))
        out.append((doc_id, len(w), len(hit), ids))
    return sorted(out, key=key)


def got(spark, rows, items):
    bench = spark.createDataFrame([(i, t, None, None) for i, t in items], "item_id long, text string, key int, n_words int")
    found = find_passages(table(spark, rows), bench)
    found = found.select("doc_id", "n_words", n_hit_words(F.col("hits")), F.array_join("item_ids", ","))
    return sorted((tuple(r) for r in found.collect()), key=key)


ITEMS = [
    (1, PASSAGE[:200]), (2, "ONE two-three"), (3, None), (4, ""), (5, "..."), (6, "x"), (7, PASSAGE), (7, PASSAGE),
    (8, "nothing of this sort is in any of the documents at all"), (9, "same same same same same same same same same same same"),
    (None, "and large ones last of all"), (11, "ßtraße"), (12, "é ß"),
]


def test_odd_rows(spark):
    assert got(spark, TEXTS, ITEMS) == brute(TEXTS, ITEMS)


def test_no_rows(spark):
    assert got(spark, [], ITEMS) == []
    assert got(spark, TEXTS, []) == brute(TEXTS, [])


def test_random_overlaps(spark):
    draw = random.Random(3)
    items = [(i, " ".join(f"w{draw.randrange(6)}" for _ in range(draw.randrange(1, 30)))) for i in range(12)]
    rows = []
    for doc_id in range(60):
        text = [f"w{draw.randrange(6)}" for _ in range(draw.randrange(40))]
        if draw.random() < 0.7:
            at = draw.randrange(len(text) + 1)
            source = plain(draw.choice(items)[1])
            cut = draw.randrange(len(source))
            text[at:at] = source[cut : cut + draw.randrange(1, 16)]
        rows.append((doc_id, " ".join(text)))
    assert got(spark, rows, items) == brute(rows, items)
