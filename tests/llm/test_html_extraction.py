import itertools
import random

import pytest

from daydigest.llm import html_extraction as H

SCHEMA = "page_id long, url string, html string, text string, n_chars int"

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x:1}</style></head><body class="has-sidebar">
<header><h1>Site</h1><a href=/>Home</a></header><div class="cookie-notice">We use cookies. Accept them all, please.</div>
<main><article><header class="entry-header"><h1>A great title</h1></header>
<p>First paragraph of the text, with a <a href=x>link</a> in it,   and it
goes on for a while.</p><ul><li>one item<li>two items here</ul><p><b>Short &amp; sweet&nbsp;&#8212; yes.<br><p>Unclosed one is here.
<div class="ad-box"><p>Buy this now, it is really good, you will like it.</p></div>
<p>Last para&#x67;raph, 1 < 2, that ends here.</p><script>var a="</p>";</script>
<form><label>Your mail address, please.</label><button>Subscribe</button></form>
<section id="comments"><h2>Comments</h2><p>I really liked this article, it was very good reading.</p></section></article></main>
<aside><h3>Related</h3><ul><li><a href=1>Other story</a></ul></aside><!-- <p>no</p> --><footer>&copy; 2020 Site</footer></body></html>"""
WANT = (
    "A great title First paragraph of the text, with a link in it, and it goes on for a while. one item two items here "
    "Short & sweet — yes. Unclosed one is here. Last paragraph, 1 < 2, that ends here."
)


def test_article_without_the_rest():
    assert H.main_text(PAGE, H.PRIOR_WEIGHTS) == WANT


def test_minimum_cut_is_least_among_all_labellings():
    rng = random.Random(0)
    for _ in range(200):
        n = rng.randint(1, 8)
        costs = [rng.randint(-9, 9) for _ in range(n)]
        edges = [(i, j, rng.randint(0, 6)) for i in range(n) for j in range(i) if rng.random() < 0.5]

        def price(sides):
            apart = sum(c for i, j, c in edges if sides[i] != sides[j])
            return apart + sum(c if c > 0 and not s else -c if c < 0 and s else 0 for c, s in zip(costs, sides))

        best = min(price(s) for s in itertools.product([False, True], repeat=n))
        assert price(H.min_cut(costs, edges)) == best


def test_hard_pages():
    weights = H.PRIOR_WEIGHTS
    assert H.main_text(None, weights) == H.main_text("", weights) == H.main_text("<!-- open <p>x</p>", weights) == ""
    assert H.main_text("<p>A paragraph that never ends, but is one.", weights) == "A paragraph that never ends, but is one."
    assert H.main_text("<nav><a href=x>x</a></nav>", weights) == ""
    assert H.main_text("<p>İstanbul, a b<script>x</SCRIPT>c, d e f.</p>", weights) == "İstanbul, a bc, d e f."
    long = "<article>" + "<p>Some words, and some more of them.</p>" * 4000 + "</article>"
    assert H.main_text(long, weights).count("Some words") == 4000
    deep = "<div>" * 3000 + "<p>Deep text, but text that counts.</p>"
    assert H.main_text(deep, weights) == "Deep text, but text that counts."
    assert len(H.main_text("<p>Some words, and more.</p>" + "<a href='x" * 20_000, weights)) == 21


ARTICLE = "<article><p>The text of the article, which is long enough to be one.</p></article>"
TEXT = "The text of the article, which is long enough to be one."


@pytest.mark.parametrize("tag", sorted(H.SILENT_BOXES))
def test_a_silent_element_without_an_end_hides_no_article(tag):
    weights = H.PRIOR_WEIGHTS
    for page in (
        f"<body><{tag} class=x>hidden {ARTICLE}</body>",
        f"<{tag}>{ARTICLE}",
        f"<header><{tag}>hidden<path d=1></header>{ARTICLE}<{tag}>hidden</{tag}>",
        f"<{tag}>hidden{ARTICLE}<p><{tag}>hidden</{tag}>",
        f"<{tag}>" * 3 + ARTICLE,
        f"<{tag}>hidden<{tag}>hidden</{tag}>hidden <p>A hidden paragraph, as long as any other one.</p></{tag}>{ARTICLE}",
        f"<{tag}/>{ARTICLE}",
        ARTICLE.replace("which", f"<{tag}>hidden <b>x</b></{tag}>which"),
        ARTICLE.replace("which", f"<span><{tag}>hidden</span>which"),
        f"<{tag}><script>'</{tag}>'</script>hidden</{tag}>{ARTICLE}",
    ):
        assert H.main_text(page, weights) == TEXT, page


def test_raw_text_goes_on_to_the_end():
    for tag in H.RAW:
        assert H.main_text(f"{ARTICLE}<{tag}><p>No text of the page, however long it may be.</p>", H.PRIOR_WEIGHTS) == TEXT
    many = "<svg>" * 20_000 + ARTICLE + "<video><select>" * 5_000
    assert H.main_text(many, H.PRIOR_WEIGHTS) == TEXT


def test_only_names_of_the_element_count():
    for attributes in ('data-id="comment-5"', "grid=ad", "valid='footer'", 'data-role="menu" data-class="share"'):
        assert H.main_text(ARTICLE.replace("<p>", f"<p {attributes}>"), H.PRIOR_WEIGHTS) == TEXT
    assert H.main_text(ARTICLE + "<p\nid='comment-5'>A comment of a reader, who says a lot of it.</p>", H.PRIOR_WEIGHTS) == TEXT


def test_query_rows(spark):
    rows = [(1, "u", PAGE, "x", 1), (1, "u", PAGE, "x", 1), (2, None, None, None, None), (None, "u", "", "x", 1)]
    out = H.extract(spark.createDataFrame(rows, SCHEMA)).collect()
    got = sorted((str(r["page_id"]), str(r["url"]), r["text"], r["n_chars"]) for r in out)
    assert got == [("1", "u", WANT, len(WANT))] * 2 + [("2", "None", "", 0), ("None", "u", "", 0)]
    assert H.extract(spark.createDataFrame([], SCHEMA)).count() == 0
