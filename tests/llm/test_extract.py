from __future__ import annotations

import random
import re

import numpy as np
import pytest

from roadbook.llm import extract, queries

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body>
<header class="top"><a href="/">Site</a></header><nav><ul><li><a href="#">Home</a></li></ul></nav>
<div id="cookie-notice">We use cookies to make this long sentence about nothing at all appear on top of the page.</div>
%s
<aside>Other stories that are long enough to look like text of an article, were it not for the tag.</aside>
<div class="comments"><p>First! This is a reader's comment that is rather long as comments on the net go.</p></div>
<form><label>Name</label><input name="q"><textarea>write here</textarea></form>
<script>document.write("<p>no</p>")</script><footer>&copy; nobody in particular</footer></body></html>"""

BODY = "<h1>A  title &amp; more</h1><p>Short.</p><p>One <b>bold</b>word, <a href='x'>a link</a><br>and\n a break.</p><ul><li>x &lt; y</li></ul><p>End &#233;&nbsp;!</p>"
TEXT = "A title & more Short. One boldword, a link and a break. x < y End é !"


@pytest.mark.parametrize("wrap", ["<article>%s</article>", "<main><section>%s</section></main>", "<div class='content'>%s</div>"])
def test_article_without_the_rest(wrap):
    assert extract.main_text(PAGE % (wrap % BODY)) == TEXT


def test_aside_inside_an_article_and_its_own_header():
    body = "<article><header><h1>Head</h1></header><p>One.</p><div class='ad'>Buy this now, it is cheap and good.</div><p>Two.</p></article>"
    assert extract.main_text(PAGE % body) == "Head One. Two."


def test_frames_named_after_what_stands_beside_the_article():
    frame = "<div class='layout with-sidebar'><article class='post has-comments'>%s</article><div class='sidebar'>Beside it.</div></div>"
    assert extract.main_text(PAGE % (frame % (BODY * 12))) == " ".join([TEXT] * 12)
    comment = "<article>%s</article><article class='comment'>A reader says that this was a good story.</article>"
    assert extract.main_text(PAGE % (comment % (BODY * 3))) == " ".join([TEXT] * 3)


def test_unclosed_and_broken_markup():
    assert extract.main_text("<article><p><b>One.<br><p>Two.</article><footer>off") == "One. Two."
    assert extract.main_text("<article><p>a < b and 3 > 2 <p title='x > y'>c</article>") == "a < b and 3 > 2 c"
    assert extract.main_text("<div class=ad>buy<article><p>Kept text.</p></article>") == "Kept text."
    assert extract.main_text("<p>text<script>var x = '</p>'") == "text"
    assert extract.main_text("<!-- never closed <p>x</p>") == ""
    assert extract.main_text("<" * 20_000) == "<" * 20_000
    assert extract.main_text("<a \"" * 20_000) is not None


def test_references_are_decoded_once():
    assert extract.main_text("<p>&amp;lt; &copy; &#x41; &unknown;</p>") == "&lt; © A &unknown;"


def test_dense_parts_of_a_page_without_marks():
    long = "A sentence of a story that goes on for a while. " * 8
    page = f"<div>x</div><div><a href='1'>{'link ' * 30}</a></div><div>{long}</div><div>{long}</div>"
    assert long.strip() in extract.main_text(page) and "link" not in extract.main_text(page)


def test_listed_words_inside_an_article_are_no_marks():
    body = (
        "<article><h1>Title</h1><section id='related-work'><p>Earlier work is told here.</p></section>"
        "<div class='social-policy'><p>A policy of the state.</p></div><h2 class='table-header'>A heading</h2>"
        "<div class='share-price'>Prices rose.</div><div class='post-header'><p>By a writer.</p></div>"
        "<p>Text that goes on for a while, so that there is something dense.</p>"
        "<div class='related-posts'><p>Another story you may like.</p></div><div class='ad-box'>Buy this.</div>"
        "<div class='my-social'><a href='1'>Share</a> <a href='2'>Send</a></div><p>End.</p></article>"
    )
    want = "Title Earlier work is told here. A policy of the state. A heading Prices rose. By a writer. "
    want += "Text that goes on for a while, so that there is something dense. End."
    assert extract.main_text(PAGE % body) == want


STORY = "A sentence of a story that goes on for a while and tells of this and that. "
UNMARKED = (
    "<html><body><div><a href='1'>Home</a> <a href='2'>News</a></div><div>Hello, stranger.</div>"
    f"<div class='x'><h1>A title</h1><p>{STORY * 4}</p><p>Short.</p><div class='ad'>Buy now, it is cheap.</div><p>Last words.</p>"
    f"<ul><li><a href='3'>A source</a></li></ul></div><div>All rights to nobody.</div></body></html>"
)


def test_block_sums_choose_the_container_of_an_unmarked_page():
    assert extract.main_text(UNMARKED) == f"A title {STORY * 4}Short. Last words. A source"
    parts = "".join(f"<section><h2>H{i}</h2><p>{'Short.' if i % 2 else STORY * 3}</p></section>" for i in range(4))
    sections = f"<div>Hello, stranger.</div><div><h1>T</h1>{parts}</div>"
    assert extract.main_text(sections) == f"T H0 {STORY * 3}H1 Short. H2 {STORY * 3}H3 Short."
    bare = f"<h1>T</h1><p>{STORY * 5}</p><div class='ad'>Buy.</div><p>Last words.</p><div>Contact us.</div>"
    assert extract.main_text(bare) == f"T {STORY * 5}Last words."


def test_without_segments_the_result_is_another(monkeypatch):
    monkeypatch.setattr(extract, "segments", lambda lengths, window, cuts: [(0, len(lengths), int(lengths.sum()))])
    assert extract.main_text(UNMARKED) != f"A title {STORY * 4}Short. Last words. A source"


def test_articles_that_hold_less_than_the_text_do_not_win():
    page = f"<article><a href='1'>Teaser</a></article><div class='story'><p>{STORY * 6}</p><p>End.</p></div>"
    assert extract.main_text(page) == f"{STORY * 6}End."


def test_given_pages_need_no_article_tag(spark):
    for r in queries.table(spark, "/root/testdata/sf0.001", "pages").collect():
        for tag in ("div", "section", "center"):
            other = r.html.replace("<article>", f"<{tag}>").replace("</article>", f"</{tag}>")
            if len(want := extract.main_text(r.html)) > 100:  # else an advert may be most of the page
                assert extract.main_text(other) == want


def plain_segments(lengths, window, cuts):
    """Stretches with text, by walking line by line: text may pause for fewer lines than a window holds."""
    out, start, quiet = [], None, 0
    for i in range(len(lengths)):
        if start is not None and (cuts[i] or not sum(lengths[i : i + window])):
            out.append((start, i))
            start = None
        if start is None and lengths[i]:
            start = i
    if start is not None:
        out.append((start, len(lengths)))
    return [(a, b, max(sum(lengths[max(a, j - window + 1) : j + 1]) for j in range(a, b))) for a, b in out]


def test_segments_against_a_plain_walk():
    rng = random.Random(2)
    for _ in range(500):
        lengths = [rng.choice([0, 0, 0, 5, 40, 200]) for _ in range(rng.randrange(1, 30))]
        cuts = [n == 0 and rng.random() < 0.2 for n in lengths]
        window = rng.choice([1, 2, 3, 5])
        assert extract.segments(np.array(lengths), window, np.array(cuts)) == plain_segments(lengths, window, cuts)


def test_given_pages_hold_their_article(spark):
    for r in queries.op5_extract(spark, "/root/testdata/sf0.001").join(queries.table(spark, "/root/testdata/sf0.001", "pages"), ["page_id", "url"]).collect():
        article = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        want = extract.entities.unescape(re.sub(r"<(?:/?p|br|/?h1)>", " ", article).replace("<b>", ""))
        assert r.text == " ".join(want.split()) and r.n_chars == len(r.text)


@pytest.mark.parametrize("extra", [[], ["'x' AS id", "'y' AS text", "'z' AS n_chars"]])
def test_edges(spark, extra):
    pages = spark.createDataFrame(
        [(1, "u", None), (2, None, ""), (None, "v", "<p>a</p>"), (3, "w", "<p>" + "word " * 100_000), (3, "w", "plain")],
        "page_id bigint, url string, html string",
    ).selectExpr("page_id", "url", "html", *extra)
    found = {(r.page_id, r.url, r.text[:6], r.n_chars) for r in extract.extract(pages).collect()}
    assert found == {(1, "u", "", 0), (2, None, "", 0), (None, "v", "a", 1), (3, "w", "word w", 499_999), (3, "w", "plain", 5)}
    assert extract.extract(pages.where("false")).count() == 0
