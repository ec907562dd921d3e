"""Main text of pages: minimum cuts against brute force, the given pages, made-up pages."""

import html
import random
import re
import time
from itertools import product

import pytest

from faultledger.llm import html_text, queries


def article_of(page):
    """What the given pages hold between their article tags: no other markup than b and br stands inside a block there."""
    inside = re.sub("</?b>", "", re.search("<article>(.*?)</article>", page, re.S)[1])
    return " ".join(html.unescape(re.sub("<[^>]*>", " ", inside)).split())


def test_query_on_the_given_pages(spark):
    sf_dir = "/root/testdata/sf0.01"
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = queries.op3_html_text(spark, sf_dir).collect()
    assert len(got) == len(pages)
    for row in got:
        assert row.text == article_of(pages[row.page_id].html) and row.url == pages[row.page_id].url
        assert row.n_chars == len(row.text)


def test_minimum_cut_against_all_labellings():
    draw = random.Random(2)
    for _ in range(300):
        n = draw.randint(1, 8)
        gains = [draw.randint(-9, 9) for _ in range(n)]
        edges = [(*sorted(draw.sample(range(n), 2)), draw.randint(0, 6)) for _ in range(draw.randint(0, 12) if n > 1 else 0)]

        def cost(keep):
            alone = sum(g for g, k in zip(gains, keep, strict=True) if g > 0 and not k) - sum(g for g, k in zip(gains, keep, strict=True) if g < 0 and k)
            return alone + sum(c for a, b, c in edges if keep[a] != keep[b])

        assert cost(html_text.source_side(gains, edges)) == min(map(cost, product((False, True), repeat=n)))


def test_long_chain_is_cut_without_recursion():
    gains = [5 if i % 7 else -9 for i in range(20_000)]
    assert len(html_text.source_side(gains, [(i, i + 1, 3) for i in range(19_999)])) == 20_000


PARAGRAPH = "The mill by the river had stood empty for years before anyone thought of painting its doors."
CASES = {
    "plain article": (f"<nav><a href=x>Home</a></nav><article><h1>The mill</h1><p>{PARAGRAPH}<p>{PARAGRAPH}</article><footer>c 2024</footer>", f"The mill {PARAGRAPH} {PARAGRAPH}"),
    "divs only": (
        f"<div class='topbar'><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></div><div class=content><h2>The mill</h2><p>{PARAGRAPH}</p><p>So it went.</p><p>{PARAGRAPH}</p></div>"
        f"<div class=sidebar><h3>Popular</h3><p>{PARAGRAPH}</p></div><div id=footer>All rights reserved, the mill company.</div>",
        f"The mill {PARAGRAPH} So it went. {PARAGRAPH}",
    ),
    "advert and notice inside": (
        f"<main><h1>The mill</h1><p>{PARAGRAPH}</p><div class='ad'>Buy new doors today, only this week, at half the price.</div><p>{PARAGRAPH}</p>"
        f"<div class='cookie-notice'><p>We use cookies to make this site work better for all of you.</p></div><p>{PARAGRAPH}</p></main>",
        f"The mill {PARAGRAPH} {PARAGRAPH} {PARAGRAPH}",
    ),
    "reader comments": (
        f"<article><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p></article><section id='comments'><h3>2 comments</h3><div class=comment><p>{PARAGRAPH} I liked that very much.</p></div></section>",
        f"{PARAGRAPH} {PARAGRAPH}",
    ),
    "forms": (f"<article><p>{PARAGRAPH}</p></article><form action=x><p>Tell us your name and your address please.</p><label>Name</label><input><textarea>{PARAGRAPH}</textarea><select><option>A</select></form>", PARAGRAPH),
    "inline and references": ("<article><p>Caf&eacute; &#233;&#xE9; a<b>b</b>c &lt;d&gt; x<!-- y -->z &nbsp; e<br>f, which is all there is to say about it today.</p></article>", "Café éé abc <d> xz e f, which is all there is to say about it today."),
    "scripts and hidden": (f"<article><script>if (a<b) '</p>'</script><p>{PARAGRAPH}</p><style>p{{}}</style><p style='display: none'>{PARAGRAPH}</p></article>", PARAGRAPH),
    "page header": (f"<header><h1><a href=/>Site</a></h1><p>A site on mills</p></header><article><header><h1>The mill</h1></header><p>{PARAGRAPH}</p></article>", f"The mill {PARAGRAPH}"),
    "broken": (f"<article><p>{PARAGRAPH}<div>{PARAGRAPH}</p></b><p title=\"a > b\">{PARAGRAPH} <", f"{PARAGRAPH} {PARAGRAPH} {PARAGRAPH} <"),
    "lists in the text": (f"<article><p>{PARAGRAPH}</p><ul><li>first point of the list</li><li>second</li></ul><p>{PARAGRAPH}</p></article>", f"{PARAGRAPH} first point of the list second {PARAGRAPH}"),
    "only a menu": ("<nav><ul><li><a href=a>Home</a></li><li><a href=b>News</a></li></ul></nav>", ""),
    "empty": ("", ""),
}


ARTICLE = "".join(f"<p>{PARAGRAPH}</p>" for _ in range(6))
WRAPPERS = {
    "a state of the layout": "<div class='content has-sidebar'>{}</div>",
    "subjects of a post": "<article class='post tag-news category-ads'>{}</article>",
    "a layout with a side": "<div class='layout sidebar-right'><article>{}</article></div>",
    "a word of lists": "<div class='more-news'>{}</div>",
    "a form around the page": "<form id='aspnetForm'><article>{}</article></form>",
    "a form without an article": "<form id='aspnetForm'><div>{}</div></form>",
    "a banner around it": "<div class='page-header-banner'><div class='footer-space'>{}</div></div>",
    "comments are open": "<div class='comments-open'>{}</div>",
}


@pytest.mark.parametrize("around", WRAPPERS.values(), ids=WRAPPERS)
@pytest.mark.parametrize("rest", [False, True])
def test_names_of_wrappers(around, rest):
    page = around.format(ARTICLE)
    if rest:
        page = f"<ul class=menu><li><a href=a>Home</a></ul>{page}<div class=sidebar><h3>Popular</h3><p>{PARAGRAPH}</p></div><footer><p>{PARAGRAPH}</p></footer>"
    assert html_text.main_text(page, html_text.train()) == " ".join([PARAGRAPH] * 6)


def test_a_long_side_is_no_wrapper():
    for name in ("sidebar", "comments", "related", "newsletter"):
        page = f"<div><h1>The mill</h1><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p></div><div class={name}>{ARTICLE}</div>"
        assert html_text.main_text(page, html_text.train()) == f"The mill {PARAGRAPH} {PARAGRAPH}", name


@pytest.mark.parametrize("name", ["feedback", "kommentare", "xyz", ""])
def test_comments_of_any_name(name):
    remark = f"<li class=one><div>Anna, 3 May</div><p>{PARAGRAPH} I liked it.</p></li><li class=one><div>Ben, 4 May</div><p>So did I.</p></li>"
    page = f"<article><h1>The mill</h1>{ARTICLE}</article><section class='{name}'><h3>What you say</h3><ul>{remark}</ul></section>"
    assert html_text.main_text(page, html_text.train()) == " ".join(["The mill", *[PARAGRAPH] * 6])


def test_repeated_parts_of_a_text_stay():
    parts = "".join(f"<div class=part><h2>Part {i}</h2><p>{PARAGRAPH}</p></div>" for i in range(3))
    said = "".join(f"<div class=line><p>Anna</p><p>{PARAGRAPH}</p></div>" for i in range(3))
    page = f"<article><p>{PARAGRAPH}</p>{parts}{said}</article>"
    assert html_text.main_text(page, html_text.train()).count(PARAGRAPH) == 7


@pytest.mark.parametrize("name", CASES)
def test_made_up_pages(name):
    page, want = CASES[name]
    assert html_text.main_text(f"<!DOCTYPE html><html><head><title>t</title></head><body class='has-sidebar'>{page}", html_text.train()) == want


def test_classifier_knows_its_table():
    weights = html_text.train()
    for line in filter(str.strip, html_text.LABELLED.splitlines()):
        label, path, words, linked, ends = line.split()
        signs = frozenset()
        for step in path.split("/"):
            tag, _, name = step.partition(".")
            signs |= html_text.signs_of(tag, f' class="{name}"' if name else "")
        score = html_text.features(signs, tag, int(words), int(linked) / 100, ends == "1") @ weights
        assert (score > 0) == (label == "1"), line


def test_hostile_pages_take_linear_time():
    for page in ("<a title=\"" * 50_000, "<" * 300_000, "<div>" * 30_000 + "x", "<!--" * 50_000, "&" * 200_000, "<p>x" * 20_000, "<script>" * 20_000, "<b " * 50_000, "</p>" * 50_000):
        html_text.main_text(page, html_text.train())


@pytest.mark.parametrize("piece", ["<b>x</i>", "<b>x<hr>", "<p><div><b>x<hr>", "<b><a href=x>y", "<li><b>x</li></p>", "<b>x</b></i></u><hr>", "<div class=x><p>x 1<p>x."])
def test_a_million_characters_of_bad_markup(piece):
    started = time.monotonic()
    html_text.main_text(piece * (1_000_000 // len(piece)), html_text.train())
    assert time.monotonic() - started < 20


def test_edge_rows(spark):
    long = f"<article><p>{PARAGRAPH * 2000}</p></article>"
    rows = [(1, "u", None, "t"), (2, "u", "", "t"), (3, None, CASES["plain article"][0], None), (3, None, CASES["plain article"][0], None), (None, "u", long, "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, Text string")
    out = html_text.extract(pages).collect()
    assert [r.text for r in out] == ["", "", CASES["plain article"][1], CASES["plain article"][1], PARAGRAPH * 2000]
    assert html_text.extract(pages.limit(0)).count() == 0
