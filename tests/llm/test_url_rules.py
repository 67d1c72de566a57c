import itertools
import re

from pyspark.sql import functions as F

from trawlnet.llm import url_rules
from trawlnet.llm.queries import URL_RULES

URLS = [
    None, "", "no scheme/path", "http://example.org", "HTTP://Example.ORG/es/1?x#y", "https://a.example.org/en/12",
    "https://a.example.org/en/2", "https://badexample.org/es/1", "https://x.com/de/1", "https://x.com/fr/1", "ftp://com/de/",
    "https://x.com?/fr/", "https://x.com#a/b", "https://X.ÖRG.com/De/1", "a://b://c/d", "http:///path", "https://x.org/\nq", "://org/",
]


def parts(url):
    found = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return ("".join(c.lower() if c.isascii() else c for c in found[1]), found[2]) if found else ("", "")


def brute(url):
    host, path = parts(url)
    fits = [
        (len(h + p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    return (host, path, *(max(fits)[1:] if fits else (None, "allow")))


def pages(spark, urls):
    rows = [(i, u, None, None, None) for i, u in enumerate(urls)]
    return spark.createDataFrame(rows, "page_id long, url string, host int, rule int, items string")


def test_explicit_rules(spark):
    mined = url_rules.mine(spark.createDataFrame([], "url string, bad boolean"))
    found = url_rules.judge(pages(spark, [*URLS, *URLS]), URL_RULES, mined).collect()
    assert len(found) == 2 * len(URLS)
    for r in found:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == brute(r["url"])
    assert url_rules.judge(pages(spark, []), URL_RULES, mined).count() == 0


def test_mined_rules_against_all_combinations(spark):
    rows = []
    for i in range(400):
        kind = ("pills" if i % 4 == 0 else "news", "win" if i % 3 == 0 else "read", f"p{i % 5}")
        bad = kind[0] == "pills" and (kind[1] == "win" or i % 8 == 0)
        rows.append((f"https://{kind[0]}.test/{kind[1]}/{kind[2]}", bad))
    rows += [(None, True), ("https://x.test/", None)]
    labelled = spark.createDataFrame(rows, "url string, bad boolean")
    kept = labelled.where("url is not null and bad is not null")
    baskets = [(frozenset(r["t"]), r["bad"]) for r in kept.select(url_rules.tokens(F.col("url")).alias("t"), "bad").collect()]
    count, bad = {}, {}
    for items, is_bad in baskets:
        for n in range(1, len(items) + 1):
            for part in itertools.combinations(sorted(items), n):
                count[part] = count.get(part, 0) + 1
                bad[part] = bad.get(part, 0) + is_bad
    least = max(url_rules.SUPPORT, url_rules.LEAST_PAGES / len(baskets)) * len(baskets)
    good = {p: bad[p] / count[p] for p in count if bad[p] >= least and bad[p] / count[p] >= url_rules.CONFIDENCE}
    want = {
        p: c for p, c in good.items()
        if not any(good.get(q, 0) >= c for q in itertools.combinations(p, len(p) - 1))
    }
    mined = url_rules.mine(labelled)
    found = {tuple(r["items"]): (r["anchor"], r["confidence"]) for r in mined.collect()}
    assert want and {p: round(c, 9) for p, (_, c) in found.items()} == {p: round(c, 9) for p, c in want.items()}
    assert all(count[(a,)] == min(count[(x,)] for x in p) for p, (a, _) in found.items())
    judged = url_rules.judge(pages(spark, [u for u, _ in rows]), [], mined).collect()
    of = {u: set(t) for (u, _), (t, _) in zip(rows, baskets, strict=False)}
    for r in judged:
        blocked = r["url"] in of and any(set(p) <= of[r["url"]] for p in want)
        assert r["verdict"] == ("block" if blocked else "allow")
