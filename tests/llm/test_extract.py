import pytest
import html
import re

from trawlnet.deploy import ship
from trawlnet.llm.extract import extract, main_text

SF_DIR = "/root/testdata/sf0.001"
TEXT = "It is a sentence of some length, and another part of the same sentence follows."

PAGES = {
    "": "",
    "   ": "",
    "just text": "just text",
    f"<p>{TEXT}": TEXT,
    f"<body><nav><a href=x>Home</a></nav><p>{TEXT}</p><p>Short.</p><p>{TEXT}</p><footer>{TEXT}</footer>": f"{TEXT}\nShort.\n{TEXT}",
    f"<article><h1>Title</h1><p>a&amp;b &lt;c&gt; &eacute;&#233;&#xe9; &nbsp; {TEXT}\n\n x</p></article>": f"Title\na&b <c> ééé {TEXT} x",
    f"<script>var a='<p>no</p>';</script><style>p{{}}</style><!-- <p>no</p> --><p>{TEXT}</p><!-- open": TEXT,
    f"<div class='cookie-notice'>{TEXT}</div><article><p>{TEXT}</p><aside>{TEXT}</aside><p>One.</p></article>"
    f"<section id=comments><p>{TEXT} {TEXT}</p></section>": f"{TEXT}\nOne.",
    f"<article><p>{TEXT}</p><div class='ad'>{TEXT}</div><p>End.</p></article>": f"{TEXT}\nEnd.",
    f"<form><p>{TEXT}</p></form><main><p>One <b>bold</b><i>word</i>, <a href=x>a link</a>.<br>Two</p></main>": "One boldword, a link. Two",
    f"<table><tr><td>a</td><td>b</td></tr></table><ul><li>one<li>two</ul><p>{TEXT}": f"a b\none\ntwo\n{TEXT}",
    f"<p title='a > b'>{TEXT}</p><p>1 < 2 and 3 > 2</p>": f"{TEXT}\n1 < 2 and 3 > 2",
    f"<article><p>{TEXT}</p></article><p>cut off <a hre": TEXT,
    f"<div role=banner>{TEXT}</div><p>{TEXT}</p><p style='display:none'>hidden</p>": TEXT,
}


def test_pages():
    for source, want in PAGES.items():
        assert main_text(source) == want, source

LONG = " ".join([TEXT] * 4)
ADS = ("<div class=ad>Buy this.</div>", "<form><p>Sign up</p></form>", f"<aside>{LONG}</aside>")
LINKS = "<ul>" + "".join(f"<li><a href={i}>Link {i}</a></li>" for i in range(5)) + "</ul>"


def test_short_parts_without_article():
    for ad in ADS:
        for page in ("<body>{}</body>", "<body><nav>" + LINKS + "</nav><div id=content>{}</div>" + LINKS + "<footer>x</footer></body>"):
            parts = f"<h1>Headline</h1>{ad}<p>Opening.</p>{ad}<p>{LONG}</p><h2>Part</h2>{ad}{ad}{ad}<p>{TEXT}</p>{ad}<p>End.</p>"
            assert main_text(page.format(parts)) == f"Headline\nOpening.\n{LONG}\nPart\n{TEXT}\nEnd.", (ad, page)
    page = f"<body>{LINKS}<div><div><h1>Headline</h1>{ADS[0]}</div><div><p>{LONG}</p>{ADS[1]}</div><div><p>End.</p></div></div>{LINKS}"
    assert main_text(page).split("\n")[:3] == ["Headline", LONG, "End."]
    linked = main_text(f"<body>{LINKS}<div id=content><p>{LONG}</p>{LINKS}<p>End.</p></div>{LINKS}").split("\n")
    assert linked[0] == LONG and "End." in linked


def test_elements_without_an_end():
    for icon in ("<svg class=i/>", "<svg class=i />", "<svg-icon></svg-icon>", "<title-bar></title-bar>", "<template-x/>", "<math/>"):
        assert main_text(f"<article><p>one</p>{icon}<p>two</p></article>") == "one\ntwo", icon
        assert main_text(f"<div><p>{TEXT}</p>{icon}<p>{TEXT}</p></div>") == f"{TEXT}\n{TEXT}", icon
    for part in ("<svg><path d=x>no", "<noscript>no", "<template>no", "<math><mi>x"):
        assert main_text(f"<article><div>{part}</div><p>{TEXT}</p></article>") == TEXT, part
    assert main_text(f"<article><svg><path d=x><p>{TEXT}</p></article>") == TEXT
    assert main_text(f"<div><article>{TEXT}<svg></article><p>x</p></div>") == TEXT
    line = f"<p>{TEXT} <svg><title>no</title><text>no</text></svg> on <noscript><img src=x>no</noscript> it goes</p>"
    assert main_text(line) == f"{TEXT} on it goes"
    assert main_text(f"<div><p>{TEXT}<noscript><p>no</p><div>no</div></noscript> on</p></div>") == f"{TEXT} on"


def test_several_articles():
    parts = [f"<article><h1>One</h1><p>{LONG}</p></article>", f"<article><h2>Two</h2><p>{TEXT}</p></article>", "<article><p>Three.</p></article>"]
    want = f"One\n{LONG}\nTwo\n{TEXT}\nThree."
    assert main_text(f"<body><nav>{LINKS}</nav>{''.join(parts)}<footer>{LONG}</footer></body>") == want
    assert main_text(f"<body>{ADS[0].join(parts)}{LINKS}</body>") == want
    assert main_text(f"<main><p>Before.</p>{parts[0]}{ADS[1]}<p>{TEXT}</p></main>") == f"Before.\nOne\n{LONG}\n{TEXT}"
    assert main_text(f"<div>{parts[0]}</div><div><article><p>{LONG}</p></article></div>") == f"One\n{LONG}\n{LONG}"
    assert main_text(f"{parts[0]}<div><article><p><a href=x>{LONG}</a></p></article></div><div><p>{LONG}</p></div>") == f"One\n{LONG}\n{LONG}"


def test_deep_and_broken_markup():
    assert main_text("<div>" * 5000 + TEXT) == TEXT
    assert main_text("</p>" * 5000 + TEXT) == TEXT
    assert main_text("<p><b>" * 3000 + TEXT) == TEXT
    assert main_text("< " * 5000 + TEXT).endswith(TEXT)
    assert main_text(f"<p class=\"{'x' * 100_000}>{TEXT}</p>") is not None


def test_odd_rows(spark):
    ship(spark)
    rows = [(i, s, None, None) for i, s in enumerate([None, *PAGES, *PAGES])]
    pages = spark.createDataFrame(rows, "page_id long, html string, text int, url string")
    want = ["", *PAGES.values(), *PAGES.values()]
    assert [r["text"] for r in extract(pages, ["page_id", "url"]).orderBy("page_id").collect()] == want
    assert extract(pages.limit(0), ["page_id"]).count() == 0


def test_articles_of_the_table(spark):
    ship(spark)
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    for r in extract(pages, ["page_id", "html"]).collect():
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", r["html"], re.S)[1]
        blocks = re.split(r"</?(?:p|h1)>", article)
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", " " if "<br" in b else "", b)).split()) for b in blocks]
        assert r["text"] == "\n".join(b for b in blocks if b)


STORY = "<p>" + "A first paragraph with many words in it. " * 3 + "</p><p>" + "And a second one, as long as the first. " * 3 + "</p>"
PARTS = [("A first paragraph with many words in it. " * 3).strip(), ("And a second one, as long as the first. " * 3).strip()]
LINKS = "<div class='menu'><a href=x>Home</a> <a href=y>News of today</a></div>"


@pytest.mark.parametrize(
    "page, lines",
    [
        (f"<body>{LINKS}<div class='layout no-sidebar'><h1>Title</h1>{STORY}</div></body>", ["Title", *PARTS]),
        (f"<div id='page' class='has-header'>{LINKS}<h1>Title</h1>{STORY}</div>", ["Title", *PARTS]),
        (f"<div class='content-with-sidebar'>{LINKS}<article><h1>Title</h1>{STORY}</article></div>", ["Title", *PARTS]),
        (f"<form id='aspnetForm'>{LINKS}<article>{STORY}</article></form>", PARTS),
        (f"<form id='aspnetForm'>{STORY}</form>", PARTS),
        (f"<nav><a href=x>Home</a><article>{STORY}</article>", PARTS),
        (f"<article><h1 class='article-header'>Title</h1>{STORY}</article>", ["Title", *PARTS]),
        (f"<article><div class='entry-header'><h1>Title</h1></div>{STORY}</article>", ["Title", *PARTS]),
        (f"<article><header><h1>Title</h1></header>{STORY}</article>", ["Title", *PARTS]),
        (f"<article>{STORY}<p class='social-science'>A short end.</p></article>", [*PARTS, "A short end."]),
        (f"<article>{STORY}<p>One <label>small</label> word.</p></article>", [*PARTS, "One small word."]),
        (f"<article>{STORY}</article><article class='comment'>" + "<p>I do not agree with any of this. </p>" * 9 + "</article>", PARTS),
        (f"<h1>Title</h1><article>{STORY}</article><div class='comments'>" + "<p>I do not agree with any of this. </p>" * 30 + "</div>", PARTS),
        (f"<header><h1>Site</h1></header><article>{STORY}</article>", PARTS),
        (f"<article>{STORY}</article><div class='modal' style='display:none'>{STORY}{STORY}</div>", PARTS),
    ],
)
def test_names_are_no_verdict(page, lines):
    assert main_text(page) == "\n".join(lines)
