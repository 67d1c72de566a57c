"""Text column expressions. All of them stay on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points that str.split() and str.strip() treat as whitespace, once
# as characters and once as a regular expression. The inner range turns most letters away
# before the rarer code points are tried, which makes splitting twice as fast.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0"
    "\u1680\u2000\u2001\u2002\u2003\u2004"
    "\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
SPACES = (
    r"[\t\n\x0B\f\r\x1C\x1D\x1E\x1F \x85\xA0"
    r"[\u1680-\u3000&&[\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]]]+"
)

# How a list of strings is printed. A quoted item has no bare line break, and
# its escapes are complete; a list, a set, a tuple (a comma behind one item), or bare items.
_ESCAPE = r"\\(?:x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|[^xuUN])"
_PLAIN = r"[^{q}\\\r\n]*+"
_ITEM = "(?:%s)" % "|".join(
    rf"{q}{_PLAIN.format(q=q)}(?:{_ESCAPE}{_PLAIN.format(q=q)})*+{q}" for q in ("'", '"')
)
_ITEMS = rf"{_ITEM}(?:\s*,\s*{_ITEM})*+\s*,?\s*"
_SEVERAL = rf"{_ITEM}\s*,\s*(?:{_ITEMS})?"
_LIST = rf"(?s)^(?:\[\s*(?:{_ITEMS})?\]|\{{\s*{_ITEMS}\}}|\(\s*(?:{_SEVERAL})?\)|{_SEVERAL})$"
_TOKEN = rf"(?s)\\[0-7]{{1,3}}|{_ESCAPE}|[^\\]+"
_LETTERS = {"n": "\n", "t": "\t", "r": "\r", "a": "\a", "b": "\b", "f": "\f", "v": "\v", "\n": ""}


def _column(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip(col: Column | str) -> Column:
    """Remove whitespace of every kind from both ends."""
    return F.btrim(_column(col), F.lit(WHITESPACE))


def words(col: Column | str) -> Column:
    """Whitespace tokens in their own case; NULL and blank text give an empty array."""
    return F.array_remove(F.split(F.coalesce(_column(col), F.lit("")), SPACES), "")


def tokens(col: Column | str) -> Column:
    """Lower-cased whitespace tokens; punctuation stays."""
    return words(F.lower(_column(col)))


def has_html(col: Column | str) -> Column:
    """True where at least one opening tag occurs; NULL stays NULL."""
    return _column(col).rlike(r"(?s)<[A-Za-z][^>]*>")


def years(col: Column | str) -> Column:
    """Distinct four-digit years in order of appearance, as strings, never NULL."""
    found = F.regexp_extract_all(_column(col), F.lit(r"\b([12][0-9]{3})\b"), F.lit(1))
    return F.coalesce(F.array_distinct(found), F.array().cast("array<string>"))


def shorten(col: Column | str, width: int) -> Column:
    """Cut text longer than ``width`` and mark the cut with three dots."""
    text = _column(col).cast("string")
    cut = F.concat(F.substring(text, 1, max(width - 3, 0)), F.lit("..."))
    return F.when(F.length(text) > width, cut).otherwise(text)


def _code_point(digits: Column, base: int) -> Column:
    """The character with the number that the digits write."""
    return F.decode(F.unhex(F.lpad(F.conv(digits, base, 16), 8, "0")), "UTF-32")


def _unescaped(token: Column) -> Column:
    rest = F.substring(token, 2, 99)
    letter = F.create_map(*[F.lit(x) for pair in _LETTERS.items() for x in pair])
    plain = F.when(rest.isin(["\\", "'", '"']), rest).otherwise(F.coalesce(letter[rest], token))
    number = F.when(rest.rlike("^[0-7]"), _code_point(rest, 8)).when(
        rest.rlike("^[xuU]"), _code_point(F.substring(rest, 2, 99), 16)
    )
    return F.when(~token.startswith("\\"), token).otherwise(F.coalesce(number, plain))


def printed_list(col: Column | str) -> Column:
    """Items of a list, tuple or set written as ``['a', "b"]``; NULL if the text is no such thing.

    Brackets have to pair, ``('a')`` is no tuple, and ``'a', 'b'`` needs no brackets.
    """
    text = strip(col)
    quoted = F.regexp_extract_all(text, F.lit(f"(?s){_ITEM}"), F.lit(0))

    def item(q: Column) -> Column:
        tokens = F.regexp_extract_all(q.substr(F.lit(2), F.length(q) - 2), F.lit(_TOKEN), F.lit(0))
        return F.array_join(F.transform(tokens, _unescaped), "")

    return F.when(text.rlike(_LIST), F.transform(quoted, item))


def same_text(left: Column | str, right: Column | str) -> Column:
    """Equality that ignores case and surrounding whitespace; NULL counts as different."""
    return F.coalesce(F.lower(strip(left)) == F.lower(strip(right)), F.lit(False))


def same_set(left: Column | str, right: Column | str) -> Column:
    """Equality of two arrays as sets; NULL counts as different."""

    def canonical(col: Column | str) -> Column:
        return F.array_sort(F.array_distinct(_column(col)))

    return F.coalesce(canonical(left) == canonical(right), F.lit(False))


def text_key(col: Column | str) -> Column:
    """Fixed-width identity of a text, so that joins need not carry the text itself.

    Never NULL: a join on a nullable key would make the optimiser test the digest of
    every chunk for NULL before it has picked the few that are asked for.
    """
    return F.coalesce(F.sha2(_column(col), 256), F.lit(""))
