"""A table of documents with everything that can be odd in one, and plain versions of words."""

import re

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, score double, key string, sig int,"
    " n int, h binary, batch string, items string, prefix int, least string, extra int, block int, label int, terms string"
)
PASSAGE = " ".join(f"word{i % 37}x{i}" for i in range(120))
LONG = " ".join(f"w{i * i % 4093} the" for i in range(30_000))

TEXTS = [
    (1, PASSAGE), (2, None), (3, ""), (4, "  \t\n "), (5, "One two Three"), (6, "one TWO three"),
    (7, PASSAGE), (8, PASSAGE.upper()), (9, "before it " + PASSAGE + " after it"), (9, "before it " + PASSAGE + " after it"),
    (10, LONG), (11, LONG + " more"), (12, "x"), (13, "É é ß ÄÖ straße 日本語 テスト"), (None, PASSAGE), (None, None),
    (14, "<|endoftext|> it's 12 o'clock   \n\n\tnow"), (15, " ".join(["same"] * 400)), (16, " ".join(["same"] * 300)),
    (17, "### $$$ %%% !!!"), (18, PASSAGE[: len(PASSAGE) // 2]), (19, "one two three   four\x0bfive\x1csix"),
    (-5, "negative ids come first of all"), (1 << 50, "and large ones last of all"), (20, PASSAGE.replace("word3", "other")),
]


def table(spark, texts=TEXTS, schema=SCHEMA):
    width = schema.count(",") + 1
    rows = [(i, t, None if i is None else "en", None, None, *[None] * (width - 5)) for i, t in texts]
    return spark.createDataFrame(rows, schema)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def ascii_lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def key(row):
    return tuple((x is not None, x) for x in row)
