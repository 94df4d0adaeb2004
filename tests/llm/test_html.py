"""HTML extraction on pages of several kinds, and the cut against brute force."""

import itertools
import random

import numpy as np
import pytest

from qarun.llm.html_text import (
    FEATURES,
    blocks_of,
    extract,
    extract_pages,
    fit_weights,
    label_blocks,
    minimum_cut,
)

START = np.array(list(FEATURES.values()))
LONG = "This is a sentence of the article that goes on for a while, as sentences do."

PAGES = {
    "semantic": (
        "<html><head><title>T</title><style>p{}</style></head><body><header><a href=/>Home</a></header>"
        "<nav><ul><li><a href=/a>A</a><li><a href=/b>B</a></ul></nav><main><article><h1>Title</h1>"
        f"<p>{LONG}<p>Two &amp; <b>bold</b>\n  words.</article><section class=comments><p>{LONG}</p></section>"
        "</main><aside><p>Read this too</p></aside><footer>&copy; 2024</footer></body></html>",
        f"Title\n{LONG}\nTwo & bold words.",
    ),
    "classes": (
        f'<body><div class="site-header">Site</div><div id="sidebar"><p>{LONG}</p></div>'
        f'<div id="content"><h2>Head</h2><div>{LONG}</div><div class="ad-slot">Buy now!</div>'
        f'<ul><li>First point</li><li>Second point</li></ul></div><div class="cookie-notice">We use cookies</div>'
        f'<form><label>Mail</label><input><button>Send</button></form><div id="comments">{LONG}</div></body>',
        f"Head\n{LONG}\nFirst point\nSecond point",
    ),
    "bare": (f"<p>{LONG}</p><p>{LONG} Again.</p>", f"{LONG}\n{LONG} Again."),
    "article header": (
        f"<article><header><h1>Name</h1></header><p>{LONG}</p><footer>By us</footer></article>",
        f"Name\n{LONG}",
    ),
    "hidden": (
        f'<article><p hidden>no</p><p style="display: none">no</p><p>{LONG}</p><noscript>no</noscript></article>',
        LONG,
    ),
    "references": (f"<article><p>{LONG} 1 &lt; 2 &#8364; &eacute;&nbsp;x &copy</p></article>", f"{LONG} 1 < 2 € é x ©"),
    "scripts": (f'<article><script>var a = "<p>no</p>";</SCRIPT ><p>{LONG}</p><script>open', LONG),
    "quotes": (f"<article><p title='a > b' class=\"x\">{LONG}</p><!-- <p>no</p> --></article>", LONG),
    "table": (f"<article><table><tr><td>{LONG}<td>Cell</table></article>", f"{LONG}\nCell"),
    "only menus": ("<nav><a href=/>Home</a></nav><footer>End</footer>", ""),
    "nothing": ("", ""),
    "null": (None, ""),
    "cut off": (f"<article><p>{LONG}</p><p class='x", LONG),
    "lone sign": (f"<article><p>{LONG} a < b and 3<4.</p></article>", f"{LONG} a < b and 3<4."),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages(name):
    page, want = PAGES[name]
    assert extract(page, START) == want


@pytest.mark.parametrize(
    "tag",
    [
        'title="The hidden cost of tea"',
        "data-h='hidden'",
        'href="/a/hidden/b"',
        "href=/a?id=ad",
        "href='/a?class=sidebar&role=menu'",
        'data-x="style=display:none"',
        "title=\"it is='so\" alt='>'",
        "class=x class=sidebar",
    ],
)
def test_what_a_value_holds_is_no_attribute(tag):
    page = f"<article><p {tag}>{LONG}</p><p>See <a {tag}>these words</a> here.</p></article>"
    assert extract(page, START) == f"{LONG}\nSee these words here."


@pytest.mark.parametrize("tag", ["HIDDEN", "a=b hidden=''", "x='1'hidden", "style='DISPLAY : NONE'", "aria-hidden=true"])
def test_hidden_attributes_are_found_among_others(tag):
    page = f"<article><p>{LONG}</p><p title='a > b' {tag}>no</p></article>"
    assert extract(page, START) == LONG


BODY = f"<h1>Title</h1><p>{LONG}</p><p>{LONG} Again.</p>"
WHOLE = f"Title\n{LONG}\n{LONG} Again."
SHELL = (
    "<nav><a href=/>Home</a></nav><div class=navbar><ul><li><a href=/a>A</a><li><a href=/b>B</a></ul></div>",
    "<div class=sidebar><p>Read this too</p></div><footer>&copy; 2024</footer>",
)


@pytest.mark.parametrize(
    ("before", "after"),
    [
        ("<form id=aspnetForm>", "</form>"),
        ("<form action=x><div class=page><div id=main>", "</div></div></form>"),
        ("<form><fieldset>", "</fieldset></form>"),
        ("<form><article>", "</article></form>"),
        ('<div class="content has-sidebar">', "</div>"),
        ('<div class="has-sidebar">', "</div>"),
        ('<div class="post tag-social">', "</div>"),
        ('<div class="article-header">', "</div>"),
        ('<div class="article-header"><article>', "</article></div>"),
        ('<div class="notice"><article>', "</article></div>"),
        ('<div class="sidebar-left"><div class=x><main>', "</main></div></div>"),
    ],
)
@pytest.mark.parametrize("inner", [False, True])
def test_wrappers_do_not_take_the_page_away(before, after, inner):
    top, end = SHELL
    parts = (before, top, BODY, end, after) if inner else (top, before, BODY, after, end)
    assert extract(f"<body>{''.join(parts)}</body>", START) == WHOLE


@pytest.mark.parametrize(
    "part",
    [
        f"<form><p>{LONG}</p><label>Name</label></form>",
        f"<div class=ad-slot><p>{LONG}</p></div>",
        f"<div class=related-posts><article><h3>Other</h3><p>{LONG}</p></article></div>",
        f"<section class=comments><article class=comment><p>{LONG}</p></article></section>",
        f"<aside><div class=text><p>{LONG}</p></div></aside>",
        f"<div class=comments><div><p>{LONG}</p></div></div>",
    ],
)
@pytest.mark.parametrize("inside", [False, True])
def test_small_parts_stay_away(part, inside):
    body = BODY + "".join(f"<p>{LONG} Number {i}.</p>" for i in range(3))
    want = WHOLE + "".join(f"\n{LONG} Number {i}." for i in range(3))
    page = f"<article>{body}{part}</article>" if inside else f"<article>{body}</article>{part}"
    assert extract(page, START) == want


def test_the_cut_also_decides_at_the_border_of_a_mark():
    weights = np.zeros(len(START))
    weights[:2] = 0.5, -0.7  # alone, the marked block would be cut away
    assert label_blocks(blocks_of("<p>a</p><aside>b</aside>"), weights) == [True, True]
    weights[1] = -1.2
    assert label_blocks(blocks_of("<p>a</p><aside>b</aside>"), weights) == [True, False]


def test_deep_and_long_pages_end_soon():
    deep = "<div>" * 20_000 + LONG + "<b>" * 20_000 + "<p>more"
    assert [b.text for b in blocks_of(deep)] == [LONG, "more"]
    long = "<article>" + f"<p>{LONG}</p>" * 5_000 + "</article>"
    assert extract(long, START).count("\n") == 4_999


@pytest.mark.parametrize("tag", ["div", "span", "font"])
def test_deep_parts_keep_their_marks(tag):
    deep, up = f"<{tag}>" * 3_000, f"</{tag}>" * 3_000
    page = f"<article>{deep}<nav><p>{LONG}</p></nav><p>{LONG}</p>{up}<p>{LONG} End.</p></article>"
    assert [(b.element.away > 0, b.element.inside) for b in blocks_of(page)] == [
        (True, False),
        (False, True),
        (False, True),
    ]
    assert extract(page, START) == f"{LONG}\n{LONG} End."


def test_deep_pages_are_not_searched():
    deep = "<span>" * 30_000
    for part in ("<h1>x</h1>", "x<hr>", "<p>x", "</b>x<li>"):
        assert len(blocks_of(deep + part * 30_000)) == 30_000


def test_minimum_cut_against_all_labellings():
    rng = random.Random(4)
    for _ in range(60):
        n = rng.randrange(1, 9)
        source = [round(rng.random() * 5, 3) for _ in range(n)]
        sink = [round(rng.random() * 5, 3) for _ in range(n)]
        edges = [
            (i, j, round(rng.random() * 2, 3))
            for i in range(n)
            for j in range(i + 1, n)
            if rng.random() < 0.5
        ]

        def cost(labels, source=source, sink=sink, edges=edges):
            own = sum(b if keep else a for keep, a, b in zip(labels, source, sink, strict=True))
            return own + sum(c for i, j, c in edges if labels[i] != labels[j])

        best = min(cost(labels) for labels in itertools.product((False, True), repeat=n))
        assert cost(minimum_cut(source, sink, edges)) == pytest.approx(best)


def test_smoothness_decides_doubtful_blocks():
    # Alone, the middle block would be cut away.
    assert minimum_cut([3.0, 1.0, 3.0], [0.0, 1.5, 0.0], []) == [True, False, True]
    assert minimum_cut([3.0, 1.0, 3.0], [0.0, 1.5, 0.0], [(0, 1, 0.5), (1, 2, 0.5)]) == [True] * 3


def table(spark, pages):
    rows = [(i % 7 or None, None if i % 3 else "http://a", page, "t") for i, page in enumerate(pages)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, text string")


def test_a_table_of_pages(spark):
    pages = [page for page, _ in PAGES.values()] * 2
    got = extract_pages(table(spark, pages).repartition(3))
    assert got.columns == ["page_id", "url", "text"]
    want = [text for _, text in PAGES.values()] * 2
    assert sorted(r.text for r in got.collect()) == sorted(want)
    assert extract_pages(table(spark, [])).count() == 0


def test_fitted_weights_stay_near_the_start(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    weights = fit_weights(pages)
    fixed = [i for i, name in enumerate(FEATURES) if name in ("away", "inside")]
    assert (weights[fixed] == START[fixed]).all() and not np.allclose(weights, START)
    assert np.abs(weights - START).max() < 4
    assert (fit_weights(pages.limit(0)) == START).all()
    for page, want in PAGES.values():
        assert extract(page, weights) == want


def test_all_pages_are_fitted_whatever_their_number(spark):
    few, many = [page for page, _ in PAGES.values()], 40
    once = fit_weights(table(spark, few), max_pages=100)
    again = fit_weights(table(spark, few * many), max_pages=100)
    assert not np.allclose(once, START) and np.allclose(once, again, rtol=0, atol=1e-9)
