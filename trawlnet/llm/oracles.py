"""The same results in SQL, for DuckDB over the same tables."""

from __future__ import annotations

from trawlnet.llm import secrets

WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
LOWER = "translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def words(text: str, lower: bool = False) -> str:
    return WORDS.format(text=f"coalesce({LOWER.format(text=text) if lower else text}, '')")


NEAR_DUPLICATES = f"""
WITH RECURSIVE w AS (SELECT doc_id, {words('text', True)} AS w FROM documents),
s AS (SELECT doc_id,
             CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                  ELSE list_distinct([array_to_string(w[i : i + 4], ' ') FOR i IN range(1, len(w) - 3)])
             END AS s
      FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s),
e AS (SELECT doc_id, unnest(s) AS g FROM s),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
         FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
         WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM n
          UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT doc_id, n AS n_shingles, component_id
FROM n JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) ON a = doc_id
"""

SUBSTRINGS = f"""
WITH w AS (SELECT doc_id, {words('text')} AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS g
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w WHERE len(w) >= 50)),
first AS (SELECT g, min(doc_id) AS least FROM win GROUP BY g),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p
         FROM win JOIN first USING (g) WHERE least < doc_id),
one AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM w),
kept AS (SELECT doc_id, string_agg(one.w[p], ' ' ORDER BY p) AS kept, count(*) AS n
         FROM one ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

PLAIN = r"regexp_extract_all({text}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def plain_words(text: str) -> str:
    return PLAIN.format(text=f"coalesce({LOWER.format(text=text)}, '')")


PASSAGES = f"""
WITH d AS (SELECT doc_id, {plain_words('text')} AS w FROM documents),
b AS (SELECT item_id, {plain_words('text')} AS v FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(v), 10) AS m, array_to_string(v[i : i + least(len(v), 10) - 1], ' ') AS g
        FROM (SELECT item_id, v, unnest(range(1, greatest(len(v) - 9, 1) + 1)) AS i FROM b WHERE len(v) > 0)),
sizes AS (SELECT DISTINCT m FROM win),
occ AS (SELECT doc_id, i, m, array_to_string(w[i : i + m - 1], ' ') AS g
        FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i
              FROM d JOIN sizes ON len(w) >= m)),
hit AS (SELECT doc_id, i, m, item_id FROM occ JOIN win USING (m, g)),
word AS (SELECT doc_id, count(DISTINCT p) AS n_hit
         FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY doc_id),
item AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s
         FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN word USING (doc_id) LEFT JOIN item USING (doc_id)
"""

COLLOCATIONS = f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang,
                  unnest(regexp_split_to_array(coalesce({LOWER.format(text='text')}, ''), '[.,;:!?\\x0A-\\x0D]')) AS piece
           FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, w[i : i + k - 1] AS g
      FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, k, array_to_string(g, ' ') AS phrase, g, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
cut AS (SELECT lang, phrase, k, g, f, unnest(range(1, k)) AS c FROM f WHERE k >= 2),
scored AS (SELECT cut.lang, cut.phrase, cut.k, cut.g, cut.f AS a, c, x.f AS l, y.f AS r,
                  CAST(CAST(cut.f AS HUGEINT) * 2000000 // (x.f + y.f) AS BIGINT) AS score
           FROM cut JOIN f x ON x.lang = cut.lang AND x.g = cut.g[1 : c] JOIN f y ON y.lang = cut.lang AND y.g = cut.g[c + 1 : cut.k]),
low AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
part AS (SELECT lang, g[i : i + m - 1] AS g, max(f) AS most
         FROM (SELECT lang, g, f, m, unnest(range(1, k - m + 2)) AS i
               FROM (SELECT lang, g, f, k, unnest(range(2, k)) AS m FROM f WHERE k >= 3)) GROUP BY ALL),
kept AS (SELECT low.* FROM low LEFT JOIN part USING (lang, g) WHERE most IS NULL OR 100 * most < 80 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN total USING (lang) QUALIFY rank <= 2000
"""


def _matches(n: int, kind: str, regex: str, group: int, least: int) -> str:
    regex = regex.replace("'", "''")
    return f"""SELECT doc_id, {n} AS n, '{kind}' AS kind, {least} AS least, regexp_split_to_array(text, '{regex}') AS g,
                      regexp_extract_all(text, '{regex}') AS f, regexp_extract_all(text, '{regex}', {group}) AS t FROM d"""


def secret_spans(rules) -> str:
    every = "\n UNION ALL ".join(_matches(n, r.kind, r.regex, r.group, r.least) for n, r in enumerate(rules))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS ({every}),
one AS (SELECT doc_id, n, kind, f, g, unnest(range(1, len(f) + 1)) AS i, t, least FROM m WHERE len(f) > 0),
s AS (SELECT doc_id, n, kind, list_sum([length(x) FOR x IN g[1 : i]]) + coalesce(list_sum([length(x) FOR x IN f[1 : i - 1]]), 0) AS b,
             length(f[i]) AS size
      FROM one WHERE length(t[i]) >= least),
p AS (SELECT doc_id, n, b, kind, kind || ':' || CAST(b AS BIGINT) || ':' || CAST(b + size AS BIGINT) AS p FROM s),
per AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS c,
               count(*) FILTER (kind = 'hex') AS h, string_agg(p, ',' ORDER BY b, n) FILTER (n < 3) AS base, string_agg(p, ',' ORDER BY b, n) AS spans
        FROM p GROUP BY doc_id)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN per USING (doc_id)
"""


def oracles() -> dict[str, str]:
    return {
        "op2_ngram_jaccard_join": NEAR_DUPLICATES,
        "op6_decontaminate": PASSAGES,
        "op10_substring_dedup": SUBSTRINGS,
        "op11_secret_scan": secret_spans(secrets.RULES),
        "op12_collocations": COLLOCATIONS,
    }
