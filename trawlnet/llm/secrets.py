"""Find credentials in texts with many rules, most of which need not look at most texts.

Method: trigram inverted index. From the regular expression of a rule follows a Boolean query:
sets of trigrams of which every matching text holds at least one set whole. The trigrams of
all queries are posted: per trigram and block of texts, the texts of the block that hold it. The
postings of a set are intersected, those of a query united, and only texts found so are given
to the rule. A rule that no trigram follows from looks at all texts.

Trigrams are those of the lower-cased text, so a rule may ignore case. A trigram that most texts
hold is many short posting lists, one per block, and no list is longer than a block.
Only built-in functions are used.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from re import _constants as _op  # the shape of an expression, as the standard library reads it
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawlnet.operators.joins import bounded
from trawlnet.sources.scratch import materialize

BLOCK = 4096  # texts of a block, about
MOST_BROADCAST = 500_000  # candidates, of two numbers each
MOST_STRINGS = 64  # strings that a part of an expression may stand for, to be spelled out
MOST_SETS = 64  # sets of a query; a part with more is left out of it
STRETCH = 500  # matches of a text whose places are added up in one go
_SPAN = "struct<start: bigint, n: int, end: bigint, kind: string>"

Query = frozenset[frozenset[str]]
_ALL: Query = frozenset([frozenset()])  # every text


@dataclass(frozen=True)
class Rule:
    """``pattern`` is read alike by Java and Python; ``least`` characters in ``group`` make a match count."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    ignore_case: bool = False

    @property
    def regex(self) -> str:
        return f"(?i){self.pattern}" if self.ignore_case else self.pattern


# The rules that every scan has.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
# Forms of credentials that carry a mark of their own.
MARKED = (
    Rule("key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("git", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("maps", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("pay", r"[prs]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("bearer", r"bearer\x20+[A-Za-z0-9._~+/-]{20,}=*", ignore_case=True),
    Rule("login", r"[a-z][a-z0-9+.-]*://[^\x20\x09-\x0D/:@]+:[^\x20\x09-\x0D/:@]+@"),
)
RULES = BASE + MARKED


def _both(one: Query, other: Query) -> Query:
    """Texts that satisfy both; the narrower one alone where that would be too many sets."""
    if len(one) * len(other) > MOST_SETS:
        return min(one, other, key=lambda q: (q == _ALL, len(q)))
    return _least({a | b for a in one for b in other})


def _either(queries: Iterable[Query]) -> Query:
    sets = _least(set(itertools.chain.from_iterable(queries)))
    return sets if len(sets) <= MOST_SETS else _ALL


def _least(sets: set[frozenset[str]]) -> Query:
    """Without sets that hold another one."""
    return frozenset(s for s in sets if not any(other < s for other in sets))


def _spelled(strings: set[str]) -> Query:
    """What follows from a text that holds one of these strings."""
    return _either(frozenset([frozenset(s[i : i + 3] for i in range(len(s) - 2))]) for s in strings)


class _Reader:
    """Walks an expression: the strings that it stands for while they are few, else a query."""

    def __init__(self, parts):
        self.query, self.run, self.exact = _ALL, {""}, True
        for name, value in parts:
            strings, query = _part(name, value)
            if strings is None or len(strings) > MOST_STRINGS:
                self.cut()
                self.query = _both(self.query, query if strings is None else _spelled(strings))
                continue
            if len(self.run) * len(strings) > MOST_STRINGS:
                self.cut()
            self.run = {a + b for a in self.run for b in strings}

    def cut(self) -> None:
        self.query, self.run, self.exact = _both(self.query, _spelled(self.run)), {""}, False

    def found(self) -> tuple[set[str] | None, Query]:
        """The strings, or None; and what follows from a match."""
        if self.exact:
            return self.run, _ALL
        return None, _both(self.query, _spelled(self.run))


def _part(name, value) -> tuple[set[str] | None, Query]:
    """The strings that a part stands for, or None; and what follows from it."""
    if name is _op.LITERAL and value < 128:
        return {chr(value).lower()}, _ALL
    if name is _op.IN:
        return _members(value), _ALL
    if name in (_op.AT, _op.ASSERT_NOT, _op.ASSERT):  # no letters of its own
        return {""}, _ALL
    if name is _op.SUBPATTERN:
        return _Reader(value[-1]).found()
    if name is _op.BRANCH:
        ways = [_Reader(way).found() for way in value[1]]
        if all(strings is not None for strings, _ in ways):
            return set().union(*(strings for strings, _ in ways)), _ALL
        return None, _either(query if strings is None else _spelled(strings) for strings, query in ways)
    if name in (_op.MAX_REPEAT, _op.MIN_REPEAT, _op.POSSESSIVE_REPEAT):
        low, high, inner = value
        strings, query = _Reader(inner).found()
        if strings is not None and high <= 4 and len(strings) ** high <= MOST_STRINGS:
            return {"".join(p) for n in range(low, high + 1) for p in itertools.product(strings, repeat=n)}, _ALL
        return None, _ALL if not low else query if strings is None else _spelled(strings)
    return None, _ALL


def _members(items) -> set[str] | None:
    """Characters of a class, lower-cased, if they are few."""
    found: set[str] = set()
    for name, value in items:
        if name is _op.LITERAL and value < 128:
            found.add(chr(value).lower())
        elif name is _op.RANGE and value[1] < 128:
            found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return found if len(found) <= 8 else None


def trigram_query(pattern: str) -> Query | None:
    """Sets of trigrams, one of which every match holds whole once lower-cased; None if none follow."""
    strings, query = _Reader(_parser.parse(pattern)).found()
    query = query if strings is None else _spelled(strings)
    return None if frozenset() in query else query


def post(docs: DataFrame, trigrams: Sequence[str], blocks: int) -> DataFrame:
    """The index: (trigram, block, texts) with the sorted keys of the texts of a block that hold it.

    ``docs`` has key and text. Repeated keys are one.
    """
    low = docs.select("key", F.lower("text").alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]))
    posted = low.select("key", F.explode(held).alias("trigram"))
    lists = posted.groupBy("trigram", F.pmod("key", F.lit(blocks)).alias("block"))
    return lists.agg(F.array_sort(F.collect_set("key")).alias("texts"))


def find_candidates(index: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """(key, kinds): texts that satisfy the query of a rule, and the names of these rules."""
    spark = index.sparkSession
    wanted = [(kind, n, t, len(s)) for kind, q in queries.items() for n, s in enumerate(sorted(q, key=sorted)) for t in sorted(s)]
    asked = spark.createDataFrame(wanted, "kind string, n int, trigram string, size int")
    lists = index.join(F.broadcast(asked), "trigram").groupBy("kind", "n", "block", "size")
    sets = lists.agg(F.collect_list("texts").alias("lists")).where(F.size("lists") == F.col("size"))
    both = F.aggregate(F.slice("lists", 2, 1 << 20), F.col("lists")[0], lambda a, x: F.array_intersect(a, x))
    found = sets.select("kind", F.explode(both).alias("key"))
    return found.groupBy("key").agg(F.collect_set("kind").alias("kinds"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _running(numbers: Column) -> Column:
    """The sum of the numbers before each one. Stretches of them first, so that long arrays are copied seldom."""
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<long>").alias("all"))

    def one(state: Column, n: Column) -> Column:
        return F.struct((state["sum"] + n).alias("sum"), F.concat(state["all"], F.array(state["sum"])).alias("all"))

    def stretch(state: Column, at: Column) -> Column:
        empty = F.struct(state["sum"].alias("sum"), F.array().cast("array<long>").alias("all"))
        inner = F.aggregate(F.slice(numbers, at, F.lit(STRETCH)), empty, one)
        return _let(inner, lambda i: F.struct(i["sum"].alias("sum"), F.concat(state["all"], i["all"]).alias("all")))

    starts = F.sequence(F.lit(1), F.size(numbers), F.lit(STRETCH))
    return F.aggregate(starts, start, stretch)["all"]


def _spans(rule: Rule, order: int) -> Column:
    """Matches of a rule in ``text``: array of (start, n, end, kind) in code points, end exclusive."""
    none = F.array().cast(f"array<{_SPAN}>")

    def placed(found: Column) -> Column:
        told = F.regexp_extract_all("text", F.lit(rule.regex), F.lit(rule.group)) if rule.group else found
        gaps = F.transform(F.split("text", rule.regex), lambda s: F.char_length(s).cast("long"))
        sizes = F.transform(found, lambda m: F.char_length(m).cast("long"))
        parts = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(found)).alias("gap"), sizes.alias("size"), told.alias("told"))
        return _let(parts, lambda rows: F.transform(
            F.filter(
                F.zip_with(rows, _running(F.transform(rows, lambda r: r["gap"] + r["size"])), lambda r, before: F.struct(
                    (before + r["gap"]).alias("start"), (before + r["gap"] + r["size"]).alias("end"), r["told"].alias("told")
                )),
                lambda r: F.char_length(r["told"]) >= rule.least,
            ),
            lambda r: F.struct(r["start"].alias("start"), F.lit(order).alias("n"), r["end"].alias("end"), F.lit(rule.kind).alias("kind")),
        ))

    found = F.regexp_extract_all("text", F.lit(rule.regex), F.lit(0))
    return _let(found, lambda f: F.when(F.size(f) > 0, placed(f)).otherwise(none))


def find_secrets(docs: DataFrame, rules: Sequence[Rule] = RULES, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``spans`` of every row of ``docs`` (text, and any others).

    ``spans`` is an array of (start, n, end, kind): places in code points, end exclusive, and the
    number and kind of the rule, sorted by start, then rule. The matches of a rule are those that
    a search from left to right finds, without those of fewer than ``least`` characters in its
    group; matches of different rules may overlap. NULL and empty texts have none. Repeated rows,
    rows without an id and columns of any name are kept as they are, and no rows give no rows. The index is
    built and searched before the result is returned.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.struct(*keep).alias("kept"), text.alias("text"), F.xxhash64(text).alias("key"))
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {kind: q for kind, q in queries.items() if q is not None}
    trigrams = sorted(set().union(*itertools.chain.from_iterable(indexed.values())))
    kinds = F.array().cast("array<string>")
    if trigrams:
        blocks = docs.count() // BLOCK + 1
        index = materialize(post(rows, trigrams, blocks), "postings")
        found = materialize(find_candidates(index, indexed), "candidates")
        rows = rows.join(bounded(found, MOST_BROADCAST), "key", "left")
        kinds = F.coalesce("kinds", kinds)
    none = F.array().cast(f"array<{_SPAN}>")
    spans = [
        F.when(F.array_contains(kinds, r.kind), _spans(r, n)).otherwise(none) if r.kind in indexed else _spans(r, n)
        for n, r in enumerate(rules)
    ]
    return rows.select("kept.*", F.array_sort(F.concat(*spans)).alias("spans"))


def printed(spans: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kind(kind: str) -> Callable[[Column], Column]:
    return lambda span: span["kind"] == kind
