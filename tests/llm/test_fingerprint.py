import hashlib
import re
import struct

import xxhash
from edge import TEXTS, key, table
from pyspark.sql import functions as F

from trawlnet.llm import fingerprint
from trawlnet.llm.fingerprint import HELD, K, SKETCHES, fingerprints

BITS, MASK = 24, (1 << 24) - 1


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def h(*values):
    """The 64-bit hash of the engine: strings by their bytes, numbers by width."""
    seed = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else struct.pack("<q" if isinstance(v, int) else "<i", v if isinstance(v, int) else v[0])
        seed = xxhash.xxh64(data, seed=seed).intdigest()
    return signed(seed)


def entries(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    grams = [h(*w[i : i + K]) for i in range(len(w) - K + 1)] if len(w) >= K else [h(*w)] if w else []
    seen, keys = {}, []
    for place, g in enumerate(grams):
        g >>= BITS
        n = seen[g] = seen.get(g, -1) + 1
        keys.append((h(g, (n,)) & ~MASK) | place)
    inner = 64 - 6 - BITS
    most = min(1 << inner, (((HELD * SKETCHES) << (inner - 10)) // max(len(keys), 1)) << 10)
    keys = sorted(x for x in keys if ((x & (1 << 64) - 1) >> BITS) & ((1 << inner) - 1) < most)
    out, last = [], None
    for i, x in enumerate(keys):
        bucket = (x & (1 << 64) - 1) >> 58
        if bucket != last:
            one, two = sorted((x, keys[(i + 1) % len(keys)]), key=lambda y: y & MASK)
            out.append(bucket << 48 | (h(one >> BITS, two >> BITS) & (1 << 48) - 1))
        last = bucket
    return out


def like(a, b):
    if not a and not b:
        return 1.0
    return len(set(a) & set(b)) / len({x >> 48 for x in a} | {x >> 48 for x in b})


def printed(numbers):
    return "-".join(f"{x:x}" for x in numbers)


def brute(rows):
    rows = [(i, t or "") for i, t in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, h(r[1])))
    out = []
    for at, (doc_id, text) in enumerate(rows):
        after = rows[(at + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        own, changed = entries(text), entries(edited)
        out.append(
            (doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), printed(own), printed(changed),
             round(like(own, changed), 9), round(like(own, entries(after)), 9))
        )
    return sorted(out, key=key)


def got(spark, rows):
    found = fingerprints(table(spark, rows)).select(
        "doc_id", "n_chars", F.sha2("edited", 256), "fingerprint", "edited_fingerprint",
        F.round("near_edited", 9), F.round("near_next", 9),
    )
    return sorted((tuple(r) for r in found.collect()), key=key)


def test_odd_rows(spark):
    rows = [r for r in TEXTS if r[0] is not None]
    rows = [(i, None if t is None else t) for i, t in rows]
    want = [r if r[0] is None else r for r in brute(rows)]
    assert got(spark, rows) == want


def test_rows_without_an_id(spark):
    found = fingerprints(table(spark)).collect()
    assert len(found) == len(TEXTS)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in found)


def test_no_rows_and_one_row(spark):
    assert got(spark, []) == []
    assert got(spark, [(3, "a b c d e f g h")]) == brute([(3, "a b c d e f g h")])


def test_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "RANGE_BLOCKS", 7)
    rows = [(i * i * 5, f"w{i} w{i % 7} " * (i % 9) + "the end of it") for i in range(120)]
    assert got(spark, rows) == brute(rows)


def test_order_matters(spark):
    words = [f"w{i}" for i in range(400)]
    texts = {1: words, 2: words[:395], 3: words[200:] + words[:200], 4: words[::-1]}
    rows = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")
    own = fingerprint.entries("text", "own", rows)
    value = {r["doc_id"]: set(r["own"]) for r in own.collect()}
    same = {i: len(value[1] & value[i]) / SKETCHES for i in texts}
    assert same[1] == 1 and same[2] > 0.8 and 0.3 < same[3] < 0.8 and same[4] < 0.1
