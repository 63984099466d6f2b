"""Main text of pages: against a plain extraction of the <article>, and small pages of other shapes."""

import html
import re
import time

import numpy as np

from lodeworks.llm import html_text
from lodeworks.llm.queries import QUERIES


def plain(page):
    body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = [re.sub(r"<[^>]+>", " ", x) for x in re.split(r"</?(?:p|h\d|li|ul|div)\b[^>]*>", body)]
    return "\n".join(y for y in (" ".join(html.unescape(x).split()) for x in parts) if y)


def test_query_equals_plain_extraction(spark, sf_dir):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = QUERIES["op3_html_main_text"](spark, sf_dir).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.text == plain(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


LONG = "A paragraph of the article that goes on for a good while, with words and more words in it."


def test_pages_without_article_tags():
    page = f"""<html><head><title>T</title><style>x</style></head><body>
      <div class="header"><h1>Site name</h1><ul><li><a href=/>Home</a></li><li><a href=/x>About</a></li></ul></div>
      <div id="sidebar"><p>{LONG} sidebar</p></div>
      <div class="content"><h2>The &lt;title&gt;</h2><p>{LONG}&nbsp;&amp; <b>bold</b>   text</p><p>Short.</p>
        <div class="advert">{LONG}</div><p>{LONG}<br>after</p><script>if (a < b) "</p>"</script>
        <form><input><p>{LONG}</p></form><table><tr><td>c1<td>c2</table></div>
      <section class="comments"><p>{LONG} says a reader</p></section>
      <div class="cookie-notice"><p>{LONG}</p></div><footer><p>{LONG}</p></footer></body></html>"""
    assert html_text.main_text(page) == "\n".join(["The <title>", f"{LONG} & bold text", "Short.", f"{LONG} after", "c1", "c2"])


def test_article_header_and_truncation():
    page = f"<body><header><p>{LONG}</p></header><article><header><h1>Head</h1></header><p>{LONG}<p>two<aside>{LONG}</aside><p>three &am"
    assert html_text.main_text(page).startswith(f"Head\n{LONG}\ntwo\nthree")


def test_smoothing_and_threshold():
    x = np.array([0.0, 0, 10, 0, 0])
    s = html_text.smoothed(x, 1.0)
    assert s.argmax() == 2 and np.allclose(s, s[::-1]) and np.allclose(html_text.smoothed(np.ones(4), 2.0), 1)
    assert 2 < html_text.threshold(np.array([1.0, 2, 1, 9, 10])) < 9


def test_odd_rows(spark):
    rows = [(1, None, None, "x"), (2, "u", "", "x"), (3, "u", "<div><<>&&", "x"), (None, "u", f"<p>{LONG}</p>", "x"), (5, "u", f"<p>{LONG}</p>" * 3000, "x"), (5, "u", "plain text only", "x")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert [r.page_id for r in got] == [1, 2, 3, None, 5, 5]
    assert (got[0].text, got[0].n_chars, got[1].text) == ("", 0, "") and got[3].text == LONG
    assert got[4].text == "\n".join([LONG] * 3000) and got[5].text == "plain text only"


def test_wrappers_named_like_furniture():
    body = f"<h1>Head</h1><p>{LONG}</p><p>{LONG} two</p>"
    want = f"Head\n{LONG}\n{LONG} two"
    side, related = f"<div class='sidebar'><p>{LONG} side</p></div>", f"<div class='related'><article><p>{LONG}</p></article></div>"
    for name in ("div class='layout has-sidebar'", "div class='with-sidebar'", "div class='no-comments'", "div id='search-page'", "form"):
        end = name.split()[0]
        for box in ("article", "main", "div"):
            page = f"<body><{name}>{side}<{box}>{body}</{box}>{related if box != 'div' else ''}</{end}><footer>{LONG}</footer></body>"
            assert html_text.main_text(page) == want, page
    inner = f"<article><div class='no-comments'>{body}</div><div class='comments'><p>{LONG}</p></div></article>"
    assert html_text.main_text(inner) == want


def test_open_paragraphs_end_at_the_next_block():
    page = f"<article><p class='notice'>{LONG} notice<p>{LONG}<div>{LONG} div</div><ul><li><p class=ad>x<li>{LONG} item</ul></article>"
    assert html_text.main_text(page) == f"{LONG}\n{LONG} div\n{LONG} item"


def test_no_content_is_left_out_beside_a_long_inner_block():
    many = [f"{LONG} {i}" for i in range(20)]
    rows = {
        "div": "".join(f"<p>{x}</p>" for x in many),
        "ul": "".join(f"<li>{x}" for x in many),
        "table": "".join(f"<tr><td>{x}" for x in many),
        "blockquote": "".join(f"<p>{x}</p>" for x in many),
    }
    for kind, inner in rows.items():
        page = f"<body><div><p>{LONG} lead</p><{kind}>{inner}</{kind}><p>{LONG} end</p></div></body>"
        assert html_text.main_text(page) == "\n".join([f"{LONG} lead", *many, f"{LONG} end"]), kind
    only = f"<body><div><h2>Head</h2><ul>{rows['ul']}</ul></div></body>"
    assert html_text.main_text(only) == "\n".join(["Head", *many])


def test_all_articles_with_content_stay():
    page = f"<body><article><h1>One</h1><p>{LONG} 1</p><p>{LONG} 2</p></article><div>x</div><article><p>{LONG} 3</p></article></body>"
    assert html_text.main_text(page) == f"One\n{LONG} 1\n{LONG} 2\n{LONG} 3"


def test_names_are_evidence_at_any_size():
    """Readers' comments, sidebars and forms go however long they are; sections of an article stay whatever they are about."""
    own, readers = [f"{LONG} {i}" for i in range(3)], "".join(f"<p>{LONG} {LONG} says reader {i}</p>" for i in range(10))
    body = "".join(f"<p>{x}</p>" for x in own)
    for box in ("article", "main", "div id=content"):
        for name in ("div id=comments", "section id=comments", "div class=sidebar", "form", "div class='comments-area'", "div id=respond", "ul class=commentList"):
            page = f"<body><{box}>{body}<{name}>{readers}</{name.split()[0]}></{box.split()[0]}></body>"
            assert html_text.main_text(page).split("\n") == own, page
    for name in ("section id=related-work", "section id=search-algorithms", "section id=search", "div id=related-work", "div class=section id=share-prices"):
        page = f"<article>{body}<{name}><h2>Head</h2><p>{LONG} more</p></{name.split()[0]}></article>"
        assert html_text.main_text(page).split("\n") == [*own, "Head", f"{LONG} more"], page
    page = f"<article>{body}<h2 id=share-of-users>Share</h2><p id=search-2>{LONG} two</p><p class=social-policy>Short one.</p></article>"
    assert html_text.main_text(page).split("\n") == [*own, "Share", f"{LONG} two", "Short one."]
    assert html_text.main_text(f"<main><header class=page-header><h1>Head</h1></header>{body}</main>").split("\n") == ["Head", *own]
    hinted = f"<article>{body}<div class='promo-xyz'><a href=a>Buy this now</a></div><div class='share-economy'><p>{LONG} on it</p></div></article>"
    assert html_text.main_text(hinted).split("\n") == [*own, f"{LONG} on it"]


def test_ratios_act_inside_articles():
    """Runs of links before and behind all content lines of an article go; links among its lines, and lines with words, stay."""
    links = "".join(f"<li><a href={x}>Page {x}</a></li>" for x in range(6))
    page = f"<article><ul>{links}</ul><h1>Head</h1><p>{LONG}</p><ul><li><a href=c>See one</a><li><a href=d>See two</a></ul><p>{LONG} two</p><p>The end.</p><ul>{links}</ul></article>"
    got = html_text.main_text(page).split("\n")
    assert [x for x in got if not x.startswith("Page")] == ["Head", LONG, "See one", "See two", f"{LONG} two", "The end."]
    assert len(got) <= 10


def test_open_comment_ends_with_the_page():
    assert html_text.main_text(f"<article><p>{LONG}</p><!-- never closed <p>x</p></article>") == LONG
    assert html_text.main_text(f"<article><p>{LONG}</p><!-- closed --><p>{LONG} two</p></article>") == f"{LONG}\n{LONG} two"


TEXT = "long article text goes on and on with many words in it, so that it is clearly content. " * 4


def test_menus_of_plain_pages_go():
    """Without article or main: lines of links, and short ones round the text that are no paragraph, heading or cell."""
    page = f"""<body><div id=m1><a href=a>Home</a> <a href=b>News</a> <a href=c>Shop</a></div><div>Monday</div><h1>Title</h1><p>{TEXT}</p><div>short</div>
    <p>{TEXT}</p><p>The end.</p><div><a href=x>Terms</a> | <a href=y>Privacy</a></div><div>Place 12</div></body>"""
    assert html_text.main_text(page).split("\n") == ["Title", TEXT.strip(), "short", TEXT.strip(), "The end."]
    assert html_text.main_text("<div><p>one</p></div>") == "one" and html_text.main_text("<div>one</div>") == "one"


def test_names_of_wrappers_and_even_articles():
    for page in ('<div class="layout no-sidebar"><p>{}</p></div>', '<div class="has-comments"><article><p>{}</p></article></div>', '<article class="related-work"><p>{}</p></article>', '<form id=search><main><p>{}</p></main></form>'):
        assert html_text.main_text(page.format(TEXT)) == TEXT.strip()
    two = f"<article><p>{TEXT}</p><p>{TEXT}</p></article><article><p>{TEXT[:-100]}</p></article>"
    assert html_text.main_text(two).split("\n") == [TEXT.strip(), TEXT.strip(), TEXT[:-100].strip()]


def test_time_follows_the_page():
    """Pages of many unclosed or nested elements: a hundred thousand of them take seconds, not hours."""
    start = time.time()
    n = 100_000
    assert html_text.main_text("<p>word word" * n).count("\n") == n - 1
    assert html_text.main_text("<div>x" * n).count("x") == n
    assert html_text.main_text("<div>x</span></b>" * n).count("x") == n
    assert time.time() - start < 60


def test_pages_without_article_by_their_ratios(spark):
    """The given pages with their <article> tags taken out: nothing but names and ratios is left to go by."""
    rows = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    some = [(plain(h), re.sub(r"</?article[^>]*>", "", h)) for h in rows]
    same = sum(html_text.main_text(bare) == want for want, bare in some)
    assert len(some) == 250 and same >= 0.98 * len(some)
