import html
import re

import pytest
from tidemark.llm import html_text
from tidemark.llm.html_text import main_text

LONG = "This is a paragraph with many words, long enough to count as the text of an article on its own."


def test_pages_equal_their_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S).group(1)
        blocks = [" ".join(html.unescape(re.sub("</?b>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)>", article)]
        want[r["page_id"]] = "\n".join(b for b in blocks if b)
    rows = html_text.extract(pages).collect()
    assert {r["page_id"]: r["text"] for r in rows} == want
    assert all(r["n_chars"] == len(r["text"]) for r in rows)


@pytest.mark.parametrize(("page", "text"), [
    (None, ""), ("", ""), ("<p>", ""), ("<nav>menu</nav>", ""),
    ("<p>a &lt; b&nbsp;&amp;\n\t c</p>", "a < b & c"),
    ("<p>x<script>var t='</p>';</script> y</p><style>p{}</style>", "x y"),
    ("<article><p>One.</p><div class='ad-slot'>Buy</div><aside>side</aside><p>Two.</p></article>", "One.\nTwo."),
    (f"<div id=nav><a href=x>Home</a></div><div><p>{LONG}</p><p>Short.</p></div><footer>f</footer>", f"{LONG}\nShort."),
    (f"<article>{LONG}<section class='comments'><article><p>{LONG} nice</p></article></section></article>", LONG),
    (f"<body class='has-sidebar'><p>{LONG}</p><form>send <input></form><div role=alert>note</div></body>", LONG),
    ("<article><header><h1>Title</h1></header><p>T<b>ex</b>t <!-- no --> &unknown; &#x41;</article>", "Title\nText &unknown; A"),
    ("a < b <p>c<!-- cut", "a < b\nc"),
    ("<ul><li>x</ul></p></div>tail", "x\ntail"),
])
def test_cases(page, text):
    assert main_text(page) == text


def test_links_and_far_stretches_are_left_out():
    menu = "<ul>" + "<li><a href=/x>An item of a menu that is written with many words in it</a></li>" * 6 + "</ul>"
    gap = "<div class=promo>x</div>" * 5
    assert main_text(f"{menu}<p>{LONG}</p><p>{LONG}</p>{gap}<p>tiny</p>") == f"{LONG}\n{LONG}"


def test_long_and_deep_pages():
    assert main_text("<div>" * 5000 + "x" + "</div>" * 5000) == "x"
    assert main_text("<p>" + "word " * 200_000) == ("word " * 200_000).strip()
    assert main_text("<a b='" * 2000) is not None


def test_odd_rows(spark):
    rows = [(1, None, None), (None, "u", "<p>a</p>"), (2, "u", ""), (2, "u", "")]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'x' AS text", "1 AS n_chars")
    found = html_text.extract(frame).collect()
    assert sorted((r["text"], r["n_chars"]) for r in found) == [("", 0)] * 3 + [("a", 1)]
    assert html_text.extract(frame.where("false")).count() == 0


def test_a_teaser_in_an_article_element_is_not_the_page():
    card = "<article class=teaser><h2>Elsewhere</h2><p>Read this.</p></article>"
    body = f"<div><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div>"
    assert main_text(body + "<div class=promo>x</div>" * 5 + card) == "\n".join([LONG] * 3)
    # Text as long as the article's counts outside of it too; a line beside it does not.
    assert main_text(f"<article><p>{LONG}</p><p>Two.</p></article><p>{LONG[:90]}</p>") == f"{LONG}\nTwo.\n{LONG[:90]}"
    assert main_text(f"<p>aside</p><article><p>{LONG}</p><p>Two.</p></article>") == f"{LONG}\nTwo."


@pytest.mark.parametrize("inside", [
    "<section id='side-effects'><p>Nausea.</p></section>", "<h2 id='related-work'>Related work</h2>",
    "<section id='notice'><p>Of a month.</p></section>", "<div id='notice-period'>Three months.</div>",
    "<div class='ad-hoc'>Made for it.</div>", "<section id='share-capital'>Of a million.</section>",
    "<fieldset>Set apart.</fieldset>", "<p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</p>", "<p><object>shown</object></p>",
])
def test_words_of_names_are_no_names(inside):
    want = " ".join(html.unescape(re.sub("<[^>]*>", "", inside)).split())
    assert main_text(f"<article><p>{LONG}</p>{inside}<p>{LONG}</p></article>") == f"{LONG}\n{want}\n{LONG}"


@pytest.mark.parametrize("name", ["ad-slot", "related-posts", "siteFooter", "x cookie_notice", "ad1", "comment-list", "sidebar-left"])
def test_compounds_of_names_are_left_out(name):
    assert main_text(f"<article><p>{LONG}</p><div class='{name}'>Gone.</div></article>") == LONG


def test_short_text_between_and_closing_sentences_stay():
    gap = "<div class=promo>x</div>" * 4
    assert main_text(f"<p>{LONG}</p>{gap}<p>Short between</p>{gap}<p>{LONG}</p>{gap}<p>It ends here.</p>") == \
        f"{LONG}\nShort between\n{LONG}\nIt ends here."


def test_a_title_before_links_stays():
    menu = "<ul>" + "<li><a href=/x>An item of a menu</a></li>" * 6 + "</ul>"
    assert main_text(f"<h1>A title</h1>{menu}<p>{LONG}</p><p>{LONG}</p>") == f"A title\n{LONG}\n{LONG}"
    # A page's name above the menu is none where the text has a heading of its own.
    assert main_text(f"<h1>The site</h1>{menu}<h1>A title</h1><p>{LONG}</p>") == f"A title\n{LONG}"
    assert main_text(f"<header><h1>The site</h1></header>{menu}<p>{LONG}</p>") == LONG


def test_paragraphs_in_an_article_may_be_about_menus():
    page = "<article><p>" + LONG + "</p><p class='menu'>Our lunch menu has soup.</p><h2 class=share>Shares</h2><p class=ad>Buy!</p></article>"
    assert main_text(page) == f"{LONG}\nOur lunch menu has soup.\nShares"


def test_unwanted_inline_elements_end_with_their_own_tags():
    assert main_text(f"<p>{LONG} <span class=ad>buy <span>now</span> cheap</span> on.</p>") == f"{LONG} on."
    assert main_text(f"<p>{LONG} <span class=ad>buy <b>now</b></p><p>{LONG}</p>") == f"{LONG}\n{LONG}"  # left open
    assert main_text(f"<p>{LONG} <a class=share href=x>a<small class=ad>b</small>c</a> on.</p>") == f"{LONG} on."


def test_many_open_elements_take_linear_time():
    import time

    times = []
    for n in (2_000, 16_000):
        start = time.perf_counter()
        main_text(f"<div>{'<span class=ad>x' * n}</div><p>{LONG}</p>")
        times.append(time.perf_counter() - start)
    assert times[1] < 30 * max(times[0], 0.01)


def test_windows_choose_in_an_article_too():
    """The zone's edge is a dive; what is unwanted inside parts stretches and does not end the text."""
    ad = "<div class=ad>Buy this.</div>" * 6
    page = f"<p>By the way</p><article><h1>Head</h1><p>{LONG}</p>{ad}<p>End</p></article><p>See you</p>"
    assert main_text(page) == f"Head\n{LONG}\nEnd"
    found = [x for x in html_text.lines(page) if x[0]]
    assert html_text.chosen(found).tolist() == [False, True, True, *[False] * 6, True, False]
