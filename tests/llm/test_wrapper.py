from __future__ import annotations

import json
import random
import time

import numpy as np
import pytest

from lapidary.llm import wrapper
from cases import LONG

FULL = """<!DOCTYPE html><html><head><title>Title &amp; more</title><style>p{}</style><script>var x = "<p>no</p>";</script></head><body>
<header><h2>Site name</h2></header><nav><ul><li><a href="/a">Menu a</a><li>Menu b</ul></nav>
<div class="cookie-notice">We use cookies</div><div id="ad-7">Buy this</div><aside>Side</aside>
<article><header><h1>The  <i>head</i>line</h1></header><p>First <b>para&shy;graph</b>&nbsp;with
  breaks<br>here<p>Second &lt;one&gt;<ul><li>Item 1</li><li>Item 2</ul><form>Mail: <input name=a></form><!-- hidden -->
<table><tr><td>Cell</td><td>Other</td></tr></table><div class="comments"><p>Reader says</p></div>Tail</article>
<section class="related">More</section><p>Outside</p><footer>&copy; 2020</footer></body></html>"""


def test_article_text():
    assert wrapper.Page(FULL).blocks(set()) == [
        "The headline", "First para­graph with breaks here", "Second <one>", "Item 1", "Item 2", "Cell", "Other", "Tail",
    ]


def test_odd_pages():
    blocks = lambda x: wrapper.Page(x).blocks(set())
    assert blocks(None) == blocks("") == blocks("<html>") == blocks("<script>p</script>") == []
    assert blocks("just text & more") == ["just text & more"]
    assert blocks("<article><p>cut off in a tag<p cla") == ["cut off in a tag"]
    assert blocks("<p>a</b></div>b<p>c < d and e<5") == ["ab", "c < d and e<5"]
    assert blocks('<div title="a>b">x</div><DIV CLASS=Sidebar>y</DIV><div hidden>z</div><div style="display: none">v</div>') == ["x"]
    assert blocks("<div>" * 500 + "deep" + "</div>" * 500 + "after") == ["deep", "after"]
    assert blocks(f"<p>{LONG}</p>")[0] == LONG
    assert blocks("<main><p>m</p></main><p>out</p>") == ["m"]


def brute_match(a, b):
    if a[0] != b[0]:
        return 0

    def best(left, right):
        if not left or not right:
            return 0
        return max(best(left[1:], right), best(left, right[1:]), brute_match(left[0], right[0]) + best(left[1:], right[1:]))

    return 1 + best(a[1], b[1])


def test_simple_tree_matching_equals_recursion():
    rng = random.Random(8)

    def tree(depth):
        return [rng.choice("xyz"), [tree(depth - 1) for _ in range(rng.randrange(0, 4))] if depth else []]

    for _ in range(200):
        a, b = ["#", tree(3)[1]], ["#", tree(3)[1]]
        found = wrapper.align(a, b)
        assert len(found) == brute_match(a, b)
        assert len(set(found.values())) == len(found) and sorted(found.values()) == [found[k] for k in sorted(found)]


def test_template_is_learnt_from_pages_of_a_host(spark):
    """Nothing in these pages names its part: only what recurs tells the template."""
    rng = random.Random(4)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    pages, wanted = [], {}
    for i in range(60):
        body = [words(12) for _ in range(rng.randrange(1, 5))]
        slogan = f"slogan {i % 4}"
        extra = f"<div class=x><p>{words(5)}</p></div>" if i % 5 == 0 else ""
        pages.append((i, "http://one.net/", f"<div class=top><p>Welcome to one</p></div><div class=mid><p>{slogan}</p></div>{extra}<div class=b>" + "".join(f"<p>{t}</p>" for t in body) + "</div><div class=end>Bye</div>"))
        wanted[i] = body
    hot = words(20)
    pages += [(100 + i, "http://one.net/copy", f"<div class=top><p>Welcome to one</p></div><div class=b><p>{hot}</p></div>") for i in range(200)]
    pages += [(900, None, "<p>alone</p>"), (901, "http://two.net/", None), (902, "http://two.net/", ""), (902, "http://two.net/", "")]
    made = spark.createDataFrame([(*p, "h", "r") for p in pages], "page_id long, url string, html string, host string, reference string")
    got = wrapper.extract(made).collect()
    assert len(got) == len(pages) and got[0].row.host == "h"
    for r in got:
        i = r.row.page_id
        if i < 100:
            assert r.blocks[-len(wanted[i]) :] == wanted[i] and not any("Welcome" in b or "slogan" in b or "Bye" in b for b in r.blocks)
        elif i < 900:
            assert r.blocks == [hot]
        else:
            assert r.blocks == (["alone"] if i == 900 else [])


def test_article_of_near_copies_keeps_its_text(spark):
    pages = [(i, "http://h.net/", f"<nav>m</nav><article><h1>Same head</h1><p>Shared passage</p><p>own {i}</p></article>") for i in range(12)]
    made = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert all(r.blocks[:2] == ["Same head", "Shared passage"] for r in wrapper.extract(made).collect())
    assert wrapper.extract(made.limit(0)).count() == 0


def test_tree_is_as_small_as_the_layout():
    page = wrapper.Page("<article>" + "<p>x</p>" * 5000 + "</article>")
    assert json.loads(page.tree) == ["#", [["article", [["p", []]]]]]


def test_elements_below_the_depth_limit_are_closed_themselves():
    blocks = lambda x: wrapper.Page(x).blocks(set())
    deep = "<div>" * 150
    assert blocks(f"<div><article>{deep}deep{'</div>' * 150}<p>still inside</p></article></div><p>out</p>") == ["deep", "still inside"]
    assert blocks(f"<article>{deep}<nav><ul><li>menu<li>more</ul><p>x</nav>text<form>f<p>g</form><p>one<p>two{'</div>' * 150}end</article>") == [
        "text", "one", "two", "end",
    ]
    assert blocks(f"<article>{deep}<ul><li>a<li>b</ul>{deep}</article>rest") == ["a", "b"]
    assert blocks(f"<article>{deep}<section>a</article>rest") == ["a"]


def test_copies_that_differ_in_menu_or_footer_are_no_evidence(spark):
    """The menu has the page's own text and every other page an advert more; the article is one and the same."""
    advert = "<div class=advert><p>buy {}</p></div>"
    pages = [(i, "http://c.net/", f"<nav>menu {i}</nav>{advert.format(i) if i % 2 else ''}<article><h1>Head</h1><p>The</p>{advert.format(i) if i % 3 else ''}<p>text</p></article><footer>f {i}</footer>") for i in range(40)]
    pages += [(100 + i, "http://d.net/", f"<nav>menu {i}</nav><div><p>The text</p></div><footer>f {i}</footer>") for i in range(20)]
    made = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.row.page_id: r.blocks for r in wrapper.extract(made).collect()}
    assert all(blocks == (["Head", "The", "text"] if i < 100 else ["The text"]) for i, blocks in got.items())


def test_a_small_article_in_a_main_part_is_not_the_text():
    blocks = lambda x: wrapper.Page(x).blocks(set())
    long = "the main text of the page " * 5
    assert blocks(f"<main><p>{long}</p><article>a card</article></main>") == [long.strip(), "a card"]
    assert blocks(f"<main><p>see also</p><article>{long}</article></main>") == [long.strip()]
    assert blocks(f"<main><article>{long}</article><article>{long}</article></main>") == [long.strip()] * 2


def test_long_pages_of_alternating_blocks():
    made = lambda n, first="", last="": json.loads(wrapper.Page(f"<body><article>{first}{'<h2>a</h2><p>b</p>' * n}{last}</article></body>").tree)
    began = time.monotonic()
    tree = made(25_000)
    same = wrapper.align(tree, tree)
    assert same == {i: i for i in range(len(same))} and len(same) > 50_000
    assert len(wrapper.align(tree, made(24_000, last="<div><p>y</p></div>"))) > 48_000
    # Where both ends differ the middle is compared row by row.
    assert len(wrapper.align(made(1500), made(1400, "<ul><li>x</li></ul>", "<div><p>y</p></div>"))) > 2800
    assert time.monotonic() - began < 5


@pytest.mark.parametrize("table", [1, 6, 1 << 24])
def test_halved_tables_find_the_same_worth(monkeypatch, table):
    monkeypatch.setattr(wrapper, "TABLE", table)
    draw = np.random.default_rng(3)
    for _ in range(40):
        worth = draw.integers(0, 4, (4, 4))
        left, right = draw.integers(0, 4, draw.integers(1, 14)), draw.integers(0, 4, draw.integers(1, 14))
        pairs = wrapper._best_pairs(left, right, worth)
        best = np.zeros((len(left) + 1, len(right) + 1), int)
        for i, x in enumerate(left, 1):
            for j, y in enumerate(right, 1):
                best[i, j] = max(best[i - 1, j], best[i, j - 1], best[i - 1, j - 1] + worth[x, y])
        assert pairs == sorted(set(pairs)) and all(a[0] < b[0] and a[1] < b[1] for a, b in zip(pairs, pairs[1:]))
        assert sum(worth[left[i], right[j]] for i, j in pairs) == best[-1, -1]
