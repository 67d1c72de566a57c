"""Decide which pages to take by their URL.

Method: association rules. FP-growth mines the combinations of URL tokens that labelled pages
share; those that imply the bad label with enough support and confidence, and are better
than every shorter rule they contain, are kept. A rule is found through its rarest token, and
fits a URL that has all of its tokens. Explicit rules by host and path go first. Only
built-in functions are used.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawlnet.llm.decontaminate import ascii_lower
from trawlnet.operators.joins import bounded
from trawlnet.sources.scratch import materialize

SUPPORT = 0.001  # of labelled pages that follow a rule
LEAST_PAGES = 20
CONFIDENCE = 0.6
_BAD = "label=bad"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    """What stands between the first ``://`` and the path, A-Z lower-cased; else empty."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1))


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


def tokens(url: Column) -> Column:
    """Distinct parts of the URL: host labels, path segments, query names, file endings."""

    def named(kind: str, values: Column) -> Column:
        return F.transform(F.array_remove(values, ""), lambda x: F.concat(F.lit(kind), x))

    url = F.coalesce(url, F.lit(""))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    ending = F.regexp_extract(path(url), r"\.([A-Za-z0-9]{1,5})$", 1)
    return F.array_distinct(
        F.concat(
            named("host=", F.split(host(url), r"\.")),
            named("path=", F.split(path(url), "/")),
            named("query=", F.regexp_extract_all(query, F.lit(r"(?:^|&)([^=&]+)"), F.lit(1))),
            named("ending=", F.array(ending)),
        )
    )


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """Rules (items, anchor, pages, confidence) from rows of (url, bad).

    Rows with a NULL in either column are left out. ``anchor`` is the rarest item.
    """
    baskets = labelled.where("url is not null and bad is not null").select(
        F.concat(tokens(F.col("url")), F.when(F.col("bad"), F.array(F.lit(_BAD))).otherwise(F.array().cast("array<string>"))).alias("items")
    )
    baskets = materialize(baskets.where("size(items) > 0"), "baskets")
    n = baskets.count()
    empty = "items array<string>, anchor string, pages bigint, confidence double"
    if not n:
        return labelled.sparkSession.createDataFrame([], empty)
    least = max(support, min(1.0, LEAST_PAGES / n))
    sets = FPGrowth(itemsCol="items", minSupport=least).fit(baskets).freqItemsets
    sets = materialize(sets.select(F.array_sort("items").alias("items"), "freq"), "itemsets")
    bad = sets.where(F.array_contains("items", _BAD) & (F.size("items") > 1)).select(
        F.array_remove("items", _BAD).alias("items"), F.col("freq").alias("bad")
    )
    rules = bad.join(sets, "items").select("items", "bad", (F.col("bad") / F.col("freq")).alias("confidence"))
    rules = materialize(rules.where(F.col("confidence") >= confidence), "rules")
    # a rule that contains a shorter one that is as good adds nothing
    parts = rules.select(
        F.col("items").alias("whole"),
        "confidence",
        F.explode(F.expr("transform(sequence(1, size(items)), i -> array_remove(items, items[i - 1]))")).alias("items"),
    )
    shorter = rules.select("items", F.col("confidence").alias("other"))
    dull = parts.join(shorter, "items").where("other >= confidence").select(F.col("whole").alias("items")).distinct()
    rules = rules.join(dull, "items", "left_anti")
    single = sets.where("size(items) = 1").select(F.col("items")[0].alias("item"), "freq")
    rare = rules.select("items", F.explode("items").alias("item")).join(single, "item")
    rare = rare.groupBy("items").agg(F.min(F.struct("freq", "item")).alias("rare"))
    return rules.join(rare, "items").select(
        "items", F.col("rare.item").alias("anchor"), F.col("bad").alias("pages"), "confidence"
    )


def explicit(rules: list[tuple[str, str, str]], url_host: Column, url_path: Column) -> tuple[Column, Column]:
    """(rule, verdict) of the longest of the (verdict, host, path) that fit; NULL if none does.

    A rule fits its host and all subdomains where the URL's path starts with its path. Meant
    for a short list kept by hand: it becomes one expression.
    """
    found, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, where, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((url_host == where) | url_host.endswith("." + where)) & url_path.startswith(start)
        found = F.when(fits, where + start).otherwise(found)
        verdict = F.when(fits, what).otherwise(verdict)
    return found, verdict


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], mined: DataFrame) -> DataFrame:
    """Add host, path, rule, verdict and the mined rule's confidence to (page_id, url).

    ``verdict`` is that of the explicit rule, else ``block`` where a mined rule fits, else
    ``allow``. NULL and malformed URLs have an empty host and path and are allowed. Repeated
    rows are judged alike; other columns are ignored.
    """
    mined = bounded(materialize(mined, "mined"), 200_000)
    urls = pages.where("url is not null").select("url", tokens(F.col("url")).alias("has"))
    met = urls.select("url", "has", F.explode("has").alias("anchor")).join(mined, "anchor")
    fits = F.size(F.array_except("items", "has")) == 0
    blocked = met.where(fits).groupBy("url").agg(F.max("confidence").alias("confidence"))
    rows = pages.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    found, verdict = explicit(rules, F.col("host"), F.col("path"))
    return rows.join(blocked, "url", "left").select(
        "page_id",
        "url",
        "host",
        "path",
        found.alias("rule"),
        F.coalesce(verdict, F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")).alias("verdict"),
        "confidence",
    )
