import re
import time

import pytest
from imgframe.llm import html_text
from imgframe.llm.html_text import extract_main_text, main_text
from imgframe.llm.queries import op1_html_text

from tests.conftest import DATA

LONG = "Here is a paragraph that is long enough to be taken for the body of an article, by its length alone."


def test_pages_against_the_documents_they_were_made_of(spark):
    """Each page's url ends in the doc_id of the text that its article holds, line by line, after a title."""
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    held = 0
    for row in op1_html_text(spark, str(DATA)).collect():
        text = texts.get(int(re.search(r"/[a-z]+/(\d+)", row.url)[1]))
        if text is not None:
            held += 1
            lines = [" ".join(line.split()) for line in text.split("\n")]
            assert row.text.split("\n\n")[1:] == [line for line in lines if line]
        assert row.n_chars == len(row.text)
    assert held > 40


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("   ", ""),
        ("just text", "just text"),
        ("<p>a &lt;b&gt; &#x41;&amp;amp; &nbsp; z</p>", "a <b> A&amp; z"),
        ("<article><h1>T</h1><p>one<p>two <b>bo</b>ld<br>line<ul><li>x<li>y</ul></article>", "T\n\none\n\ntwo bold line\n\nx\n\ny"),
        ("<article><p>abc <script>var a='</p>';</script>def<style>p{}</style><!-- <p>no</p> --></article>", "abc def"),
        ("<nav><a>Menu</a></nav><header>Top</header><main><p>Text</main><aside>Side</aside><footer>c</footer>", "Text"),
        ("<main><p>Text<form><p>Mail</form><section class='comments'><article><p>" + LONG + "</article></section></main>", "Text"),
        ("<nav><p>never closed <article><p>in</article>", "in"),
        ("<form><div><article><p>in a page-wide form</article></div></form>", "in a page-wide form"),
        ("<article><p>cut off <div class='ad", "cut off"),
        ("<p a='>' b=\">\">x</p>", "x"),
    ],
)
def test_cases(page, text):
    assert main_text(page) == text


def test_surge_and_dive_without_marks():
    """Without article marks the long run is kept, short lines in it too, and islands of short lines are not."""
    page = (
        "<body><div><div><div>Site name</div></div></div>"
        f"<div><h2>Title</h2><p>{LONG}</p><p>Short.</p><div class='ad-slot'>Buy</div><p>Short too.</p><p>{LONG}</p></div>"
        "<div><div><div><div>Some rights kept</div></div></div></div>"
    )
    assert main_text(page) == f"Title\n\n{LONG}\n\nShort.\n\nShort too.\n\n{LONG}"


def test_links_weigh_nothing():
    links = "".join(f"<li><a href=x>{LONG}</a></li>" for _ in range(9))
    assert main_text(f"<div><ul>{links}</ul></div><div></div><div><div><p>{LONG}</p></div></div>") == LONG


@pytest.mark.parametrize(
    ("page", "text"),
    [
        # A notice and a menu right before, and links right after, are outside of surge and dive; a title is not.
        (f"<div>We use biscuits.</div><div><h1>T</h1></div><div><p>{LONG}</p><p>End.</p></div>", f"T\n\n{LONG}\n\nEnd."),
        (f"<ul><li><a>One</a><li><a>Two</a><li><a>Three</a></ul><h1><a>T</a></h1><p>{LONG}<ul><li><a>Four</a><li><a>Five</a></ul>", f"T\n\n{LONG}"),
        # Short lines of the same container belong to the article.
        (f"<div>Home</div><div><p>a</p><p>b</p><p>c</p><p>d</p><p>{LONG}</p></div>", f"a\n\nb\n\nc\n\nd\n\n{LONG}"),
        # A form around all of a page, and a container that a class names like a widget, hold the article.
        (f"<form><nav><a>Menu</a></nav><div><h1>T</h1><p>{LONG}</p></div><footer>c</footer></form>", f"T\n\n{LONG}"),
        (f"<div class='widget'><p>{LONG}</p></div><footer>c</footer>", LONG),
        # But neither where the article is beside them.
        (f"<form><p>Mail address</p></form><div><p>{LONG}</p></div>", LONG),
        (f"<div class='cookie'><p>{LONG} {LONG} {LONG}</p></div><div><p>{LONG}</p></div>", LONG),
    ],
)
def test_pages_without_marks(page, text):
    assert main_text(page) == text


def test_short_articles_that_are_marked_are_whole():
    """Below any surge, and with links that would be a dive: the marks decide."""
    links = "".join("<li><a>x</a></li>" for _ in range(5))
    assert main_text(f"<p>{LONG}</p><article><p>a</p><ul>{links}</ul><p>b</p></article>") == "\n\n".join("a" + "x" * 5 + "b")


def without_marks(page):
    """The page with no tag, role, class or id that says what is what, but for its own menus and footers."""
    page = re.sub(r"<(/?)(?:article|main)\b[^>]*>", r"<\1div>", page)
    return re.sub(r"\s(?:class|id|role|aria-\w+)=(?:\"[^\"]*\"|'[^']*'|[^\s>]+)", "", page)


def test_line_blocks_alone(spark, monkeypatch):
    """Without marks and names surge and dive find the same text; without surge and dive adverts come through.

    An advert of a line stays beside articles of a few lines, as nothing but its name says what it is.
    """
    pages = [r.html for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()]
    with_marks = [main_text(p) for p in pages]
    alone = [main_text(without_marks(p)) for p in pages]
    same = [a == b for a, b in zip(alone, with_marks, strict=True)]
    assert sum(same) >= 0.9 * len(pages)
    assert all(s for s, text in zip(same, with_marks, strict=True) if len(text) > 2000)
    monkeypatch.setattr(html_text, "surges", lambda lines, surge: [lines])
    assert not any(main_text(without_marks(p)) == a for p, a in zip(pages, with_marks, strict=True))


def test_surge_and_dive_decide_the_tables_pages(spark, monkeypatch):
    """On the pages as they are: all change without surges, or with a surge that nothing reaches; marks are weights and no filter."""
    pages = [r.html for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()]
    texts = [main_text(p) for p in pages]
    with monkeypatch.context() as m:
        m.setattr(html_text, "surges", lambda lines, surge: [lines])
        assert all(main_text(p) != t for p, t in zip(pages, texts, strict=True))
    with monkeypatch.context() as m:
        m.setattr(html_text, "SURGE", 1_000_000)
        assert not any(main_text(p) for p in pages)
    assert html_text.MARK < html_text.SURGE
    with monkeypatch.context() as m:
        m.setattr(html_text, "MARK", 0)
        assert sum(main_text(p) == t for p, t in zip(pages, texts, strict=True)) > 0.9 * len(pages)  # the text's own weight is enough


@pytest.mark.parametrize(
    ("page", "text"),
    [
        # In a marked article: adverts, menus and forms are no text, and no dive; what is outside weighs nothing.
        (f"<div class=ad>{LONG}</div><article><p>one</p><div class=ad>{LONG}</div><p>two</p><ul><li>x<li class=promo>buy<li>y</ul></article><div>{LONG}</div>", "one\n\ntwo\n\nx\n\ny"),
        (f"<p>{LONG}</p><article><p><a>only a link</a></p></article>", "only a link"),
        (f"<article><div><div><div><p>far</p></div></div></div><div><div><div><p>apart</p></div></div></div></article><p>{LONG}</p>", "far\n\napart"),
        (f"<main><p>around</p><article><h2>T</h2><p>{LONG}</p></article><p>after</p></main>", f"T\n\n{LONG}"),
    ],
)
def test_marks_are_weights(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize("tag", ["article", "div", "section class=ad", "li", "p", "td", "form", "header", "main id=x", "ul><li"])
def test_deep_nesting_takes_no_time(tag):
    """50,000 open elements, with end tags that match none of them, in under a second each; the text is still found."""
    for page in (f"<{tag}>" * 50_000 + f"<p>{LONG}</p>", (f"<{tag}>" + "x </i></div></nav>") * 50_000, f"<{tag}><p>{LONG}</p>" + f"<{tag}></{tag.split()[0]}>" * 50_000):
        began = time.perf_counter()
        main_text(page)
        assert time.perf_counter() - began < 3  # about 0.5 on an idle machine
    assert (LONG in main_text(f"<{tag}>" * 500 + f"<p>{LONG}</p>")) == (tag != "header")


def test_frames(spark):
    rows = [(1, None, "own", "x"), (1, None, "own", "x"), (2, "", "own", "x"), (None, "<p>" + "word " * 200_000, "own", "x")]
    out = extract_main_text(spark.createDataFrame(rows, "page_id long, html string, text string, other string"))
    assert out.columns == ["page_id", "html", "other", "text", "n_chars"]
    assert sorted(r.n_chars for r in out.collect()) == [0, 0, 0, 999_999]
    assert extract_main_text(spark.createDataFrame([], "html string")).count() == 0
