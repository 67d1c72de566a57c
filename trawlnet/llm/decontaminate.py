"""Find passages of benchmark items in documents.

Method: winnowing. Of the hashes of all word k-grams in every sliding window, the least is a
fingerprint, so two texts that share ``length`` words in a row share a fingerprint. Those
of documents and items are joined, and where they meet the items are laid beside the
document and compared word by word. Only built-in functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawlnet.operators.joins import bounded
from trawlnet.sources.scratch import materialize

LENGTH = 10  # words in a row that count as contamination
GRAM = 5
MOST_BROADCAST = 500_000  # rows of the benchmark, or keys of documents that meet it, to broadcast

# What separates words once A-Z are lower-cased, and these letters.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; the fast function where all characters are ASCII."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def words(text: Column) -> Column:
    """Words of a text, none for NULL."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _BETWEEN), "")


def _grams(w: str, k: int) -> Column:
    """Hash of the ``k`` words from each position on."""
    taken = ", ".join(f"{w}[i + {j}]" for j in range(k))
    return F.expr(
        f"CASE WHEN size({w}) >= {k} THEN transform(sequence(0, size({w}) - {k}), i -> xxhash64({taken}))"
        " ELSE CAST(array() AS array<bigint>) END"
    )


def _least(h: str, span: int) -> Column:
    """Distinct least hashes of all windows of ``span`` k-grams."""
    taken = ", ".join(f"{h}[i + {j}]" for j in range(span))
    return F.expr(
        f"CASE WHEN size({h}) >= {span} THEN"
        f" array_distinct(transform(sequence(0, size({h}) - {span}), i -> least({taken})))"
        " ELSE CAST(array() AS array<bigint>) END"
    )


def _fingerprints(rows: DataFrame, span: int, short: list[int]) -> DataFrame:
    """Add ``prints``: winnowed hashes, and all hashes of as many words as short items have."""
    rows = rows.withColumn("h", _grams("w", GRAM)).withColumn("prints", _least("h", span)).drop("h")
    for n in short:
        rows = rows.withColumn("prints", F.concat("prints", F.array_distinct(_grams("w", n))))
    return rows


def find_passages(docs: DataFrame, items: DataFrame, length: int = LENGTH) -> DataFrame:
    """What each row of ``docs`` (doc_id, text) shares with ``items`` (item_id, text).

    Every ``length`` words in a row of an item are a window; an item of fewer words, but not
    none, is one window. Returns doc_id, key (a hash of the text), n_words, hits (array of
    (start, size) of the windows found, in words), and item_ids (sorted strings). NULL and empty texts
    have no words, and items of no words are in no document. Repeated rows give repeated
    rows; a NULL doc_id is kept, and an item without an id hits without being named. Other
    columns are ignored. What is broadcast is counted first, and joined by
    shuffle beyond a bound.
    """
    span = length - GRAM + 1
    cut = items.select("item_id", words(F.col("text")).alias("v")).where("size(v) > 0")
    cut = materialize(cut.withColumn("item", F.xxhash64("item_id", "v")), "items")
    short = cut.where(F.size("v") < length).select(F.size("v").alias("n")).distinct().collect()
    short = sorted(r["n"] for r in short)
    long_items = _fingerprints(cut.where(F.size("v") >= length).withColumnRenamed("v", "w"), span, [])
    prints = long_items.select("item", F.explode("prints").alias("print"))
    for n in short:
        whole = cut.where(F.size("v") == n).withColumn("h", _grams("v", n))
        prints = prints.unionAll(whole.select("item", F.col("h")[0].alias("print")))
    by_print = materialize(prints.groupBy("print").agg(F.collect_set("item").alias("items")), "prints")

    key = F.xxhash64("text").alias("key")
    keyed = docs.select("doc_id", key, words(F.col("text")).alias("w"))
    scanned = _fingerprints(keyed, span, short).select(
        "doc_id", "key", F.size("w").cast("long").alias("n_words"), F.posexplode_outer("prints").alias("at", "print")
    )
    met = scanned.join(bounded(by_print, MOST_BROADCAST), "print", "left")
    # the first fingerprint of a row stands for the row itself, met or not
    met = met.where("items is not null or at is null or at = 0")
    met = materialize(met.select("doc_id", "key", "n_words", "at", "items"), "met")
    wanted = met.select("doc_id", "key", F.explode("items").alias("item"))
    wanted = wanted.groupBy("doc_id", "key").agg(F.collect_set("item").alias("items"))
    wanted = materialize(wanted, "wanted").select(F.col("doc_id").alias("d"), F.col("key").alias("k"), "items")

    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k"))
    asked = docs.select("doc_id", key, "text").join(bounded(wanted, MOST_BROADCAST), same)
    asked = asked.select("doc_id", "key", words(F.col("text")).alias("w"), "items")
    asked = asked.withColumn("h", _grams("w", GRAM)).select("doc_id", "key", "w", "h", F.explode("items").alias("item"))
    beside = asked.join(bounded(cut, MOST_BROADCAST), "item").withColumn("g", _grams("v", GRAM))
    starts = F.expr(
        f"""CASE WHEN size(v) < {length} THEN filter(sequence(0, greatest(size(w) - size(v), 0)),
                                                     i -> slice(w, i + 1, size(v)) = v)
            ELSE filter(sequence(0, greatest(size(h) - 1, 0)), i -> array_contains(g, h[i]) AND
                        exists(sequence(0, size(v) - {length}), s -> g[s] = h[i] AND
                               slice(w, i + 1, {length}) = slice(v, s + 1, {length}))) END"""
    )
    laid = beside.select("doc_id", "key", "item_id", F.least(F.size("v"), F.lit(length)).alias("size"), starts.alias("starts"))
    laid = laid.where("size(starts) > 0")
    found = laid.groupBy("doc_id", "key").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.expr("transform(starts, s -> struct(s AS start, size))"))))).alias("hits"),
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"),
    )
    found = found.select(F.col("doc_id").alias("d"), F.col("key").alias("k"), "hits", "item_ids")
    rows = met.where("at is null or at = 0").select("doc_id", "key", "n_words")
    return rows.join(found, same, "left").select(
        "doc_id",
        "key",
        "n_words",
        F.coalesce("hits", F.expr("CAST(array() AS array<struct<start: int, size: int>>)")).alias("hits"),
        F.coalesce("item_ids", F.expr("CAST(array() AS array<string>)")).alias("item_ids"),
    )


def n_hit_words(hits: Column) -> Column:
    """Words that at least one of the sorted, possibly overlapping hits covers."""
    covered = F.aggregate(
        hits,
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, x: F.struct(
            F.greatest(a["end"], x["start"] + x["size"]).alias("end"),
            (a["n"] + F.greatest(F.lit(0), x["start"] + x["size"] - F.greatest(a["end"], x["start"]))).alias("n"),
        ),
    )
    return covered["n"].cast("long")
