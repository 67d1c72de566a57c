"""Fingerprints of texts that are close when an edit turns one into the other.

Method: order MinHash. Every k-mer of words is numbered by its occurrence and hashed; the hash
deals it to one of ``SKETCHES`` bins, and the two least of a bin, put in the order of the
text, are hashed together. The likeness of two fingerprints is the share of bins that agree,
so it falls when k-mers change and when their order does. Only built-in functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trawlnet.operators.joins import bounded
from trawlnet.sources.scratch import materialize

K = 3  # words of a k-mer
SKETCHES = 64  # a power of two
HELD = 8  # k-mers of a bin expected to be sorted; the two least are nearly always among them
BLOCK = 6  # documents with the same id without the lowest bits are laid out together
RANGE_BLOCKS = 50_000  # blocks of documents put in order by one task
_PLACE = 24  # bits that hold the place in the text

_SPLIT = r"[\x20\x09-\x0D]+"


def entries(text: str, out: str, rows: DataFrame, k: int = K, sketches: int = SKETCHES) -> DataFrame:
    """Add an array column ``out``: one number per bin that is not empty.

    A text with fewer than ``k`` words counts as one k-mer, an empty one has none.
    """
    mask, bits = (1 << _PLACE) - 1, sketches.bit_length() - 1
    taken = ", ".join(f"_w[i + {j}]" for j in range(k))
    inner = 64 - bits - _PLACE
    steps = ", ".join(str(1 << j) for j in range(_PLACE - 1, -1, -1))
    rows = rows.withColumn("_w", F.array_remove(F.split(F.col(text), _SPLIT), ""))
    grams = f"""CASE WHEN size(_w) >= {k} THEN transform(sequence(0, size(_w) - {k}), i -> xxhash64({taken}))
                WHEN size(_w) > 0 THEN array(xxhash64(_w)) ELSE CAST(array() AS array<bigint>) END"""
    rows = rows.withColumn("_h", F.expr(grams)).drop("_w")
    # sorted by k-mer, then place; a text of more than 2^24 words has coarser places
    place = f"CASE WHEN size(_h) <= {mask} THEN i ELSE (i * {mask + 1}L) div size(_h) END"
    rows = rows.withColumn("_s", F.expr(f"sort_array(transform(_h, (x, i) -> (x & {~mask}L) | ({place})))")).drop("_h")
    # the number of the occurrence: how far back the run of equal k-mers reaches
    same = f"i >= {{n}} AND shiftright(_s[greatest(i - {{n}}, 0)], {_PLACE}) = shiftright(x, {_PLACE})"
    occurrence = f"""CASE WHEN {same.format(n=1)} THEN aggregate(array({steps}), 0,
                     (n, step) -> CASE WHEN {same.format(n='(n + step)')} THEN n + step ELSE n END) ELSE 0 END"""
    key = f"(xxhash64(shiftright(x, {_PLACE}), {occurrence}) & {~mask}L) | (x & {mask})"
    rows = rows.withColumn("_k", F.expr(f"transform(_s, (x, i) -> {key})")).drop("_s")
    least = f"least({1 << inner}L, ({HELD * sketches}L << {inner - 10}) div greatest(size(_k), 1) << 10)"
    rows = rows.withColumn("_t", F.expr(least))
    low = f"shiftrightunsigned(x, {_PLACE}) & {(1 << inner) - 1}L"
    rows = rows.withColumn("_k", F.expr(f"sort_array(filter(_k, x -> ({low}) < _t))")).drop("_t")
    bin_of = f"shiftrightunsigned({{x}}, {64 - bits})"
    firsts = f"""filter(sequence(0, size(_k) - 1), i -> i = 0 OR
                 {bin_of.format(x='_k[i]')} <> {bin_of.format(x='_k[greatest(i - 1, 0)]')})"""
    rows = rows.withColumn("_f", F.expr(f"CASE WHEN size(_k) > 0 THEN {firsts} ELSE CAST(array() AS array<int>) END"))
    one, two = "_k[i]", "_k[(i + 1) % size(_k)]"
    pair = f"""CASE WHEN ({one} & {mask}) <= ({two} & {mask})
               THEN xxhash64(shiftright({one}, {_PLACE}), shiftright({two}, {_PLACE}))
               ELSE xxhash64(shiftright({two}, {_PLACE}), shiftright({one}, {_PLACE})) END"""
    number = f"({bin_of.format(x=one)} << 48) | ({pair} & {(1 << 48) - 1}L)"
    return rows.withColumn(out, F.expr(f"transform(_f, i -> {number})")).drop("_k", "_f")


def printed(numbers: str) -> Column:
    return F.expr(f"lower(array_join(transform({numbers}, x -> hex(x)), '-'))")


def likeness(one: str, two: str) -> Column:
    """Share of bins that agree among those that either text fills; 1 for two empty texts."""
    bins = f"array_union(transform({one}, x -> shiftright(x, 48)), transform({two}, x -> shiftright(x, 48)))"
    return F.expr(
        f"CASE WHEN size({one}) = 0 AND size({two}) = 0 THEN 1.0D"
        f" ELSE CAST(size(array_intersect({one}, {two})) AS double) / size({bins}) END"
    )


def _next_blocks(blocks: DataFrame) -> DataFrame:
    """(block, following) for distinct blocks; the first follows the last."""
    n = blocks.count()
    parts = n // RANGE_BLOCKS + 1
    edges = sorted(set(blocks.approxQuantile("block", [i / parts for i in range(1, parts)], 0.1 / parts))) if parts > 1 else []
    part = F.lit(0)
    if edges:
        literal = F.array(*[F.lit(int(e)) for e in edges])
        part = F.size(F.filter(literal, lambda e: e <= F.col("block")))
    parted = blocks.withColumn("part", part)
    firsts = sorted(r["first"] for r in parted.groupBy("part").agg(F.min("block").alias("first")).collect())
    if not firsts:
        return blocks.withColumn("following", F.col("block"))
    later = F.filter(F.array(*[F.lit(f) for f in firsts]), lambda f: f > F.col("block"))
    own = F.lead("block").over(Window.partitionBy("part").orderBy("block"))
    first = F.when(F.size(later) > 0, later[0]).otherwise(F.lit(firsts[0]))
    return parted.select("block", F.coalesce(own, first).alias("following"))


def with_next(docs: DataFrame) -> DataFrame:
    """Lay documents out in blocks by id, every block ending with the first row of the next.

    Columns block, extra, doc_id, text, key. A block has the ids that agree but for their
    lowest bits, so no key is hot whatever the distribution of ids.
    """
    block = F.coalesce(F.shiftright("doc_id", BLOCK), F.lit(-(1 << 62)))
    rows = docs.select(block.alias("block"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.xxhash64("text"))
    head = rows.groupBy("block").agg(F.min(F.struct("doc_id", "key")).alias("head"))
    head = materialize(head, "blocks")
    following = _next_blocks(head.select("block"))
    wanted = following.join(head.select(F.col("block").alias("following"), "head"), "following")
    wanted = wanted.select(
        F.col("block").alias("before"), F.col("head.doc_id").alias("d"), F.col("head.key").alias("k")
    )
    wanted = materialize(wanted, "heads")
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k"))
    extra = rows.join(bounded(wanted, 500_000), same).dropDuplicates(["before"])
    extra = extra.select(F.col("before").alias("block"), F.lit(1).alias("extra"), "doc_id", "text", "key")
    return rows.select("block", F.lit(0).alias("extra"), "doc_id", "text", "key").unionAll(extra)


def fingerprints(docs: DataFrame, k: int = K, sketches: int = SKETCHES) -> DataFrame:
    """Fingerprint of every text of (doc_id, text), and of the text after a large edit.

    The edit replaces the last half of the text, rounded down in code points, by as many of
    the first code points of the next document's text, or all if it has fewer. The next
    document is that with the next larger doc_id, and the first one for the last; rows with
    the same doc_id follow one another in the order of a hash of their text, and rows without one come
    first. A NULL text is empty. Other columns are ignored; no rows give no rows.

    Columns: doc_id, n_chars, edited (text), fingerprint, edited_fingerprint, near_edited,
    near_next.
    """
    rows = entries("text", "own", with_next(docs), k, sketches)
    order = Window.partitionBy("block").orderBy("extra", "doc_id", "key")
    rows = rows.withColumn("next", F.lead(F.struct("text", "own")).over(order)).where("extra = 0")
    half = "(char_length(text) div 2)"
    edited = F.expr(f"concat(substr(text, 1, char_length(text) - {half}), substr(next.text, 1, {half}))")
    rows = rows.select(
        "doc_id", F.expr("char_length(text)").cast("long").alias("n_chars"), edited.alias("edited"),
        "own", F.col("next.own").alias("after"),
    )
    rows = entries("edited", "changed", rows, k, sketches)
    return rows.select(
        "doc_id",
        "n_chars",
        "edited",
        printed("own").alias("fingerprint"),
        printed("changed").alias("edited_fingerprint"),
        likeness("own", "changed").alias("near_edited"),
        likeness("own", "after").alias("near_next"),
    )
