import time

import numpy as np

from pagewise.llm import htmltext as h
from pagewise.llm import queries

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body class="has-sidebar">
<div id="cookie-notice">We use cookies, which is said here at some length so that it looks like text.</div>
<header><h1>Site name</h1></header><nav><ul><li><a href=/>Home</a><li><a href=/b>News</a></ul></nav><!-- <p>no</p> -->
<article class="post"><h1>Head &amp; line</h1><p>First <b>bold</b> and <a href="x">linked</a>  words&nbsp;here.<p><b>Second<br>line</b>.</p>
<ul><li>one<li>two</ul><div class="ad-slot">Buy</div><aside>By the way</aside><p>Be.</p><table><tr><td>cell<td>next</table></article>
<section id="comments"><article><p>I liked reading this very much and will come again.</p></article></section>
<form><label>Mail</label><textarea>x</textarea><button>Go</button></form><footer>&copy; us</footer></body></html>"""


def test_article_and_nothing_else():
    assert h.main_text(PAGE) == "Head & line\nFirst bold and linked words here.\nSecond line.\none\ntwo\nBe.\ncell\nnext"


def test_without_an_article_element():
    long = "a sentence that has some words in it and goes on, " * 4
    page = f"<body><div class=menu><a href=1>One</a></div><ul><li><a href=2>Two</a><li><a href=3>Three</a></ul><div><h2>Head</h2><p>{long}<p>Short one.<p>{long}</div><p><a href=4>Next</a></body>"
    assert h.main_text(page).split("\n") == ["Head", long.strip(), "Short one.", long.strip()]


def test_furniture_by_name():
    inner = "<h1>Head</h1><div class='entry-header'><p>By someone</p></div><p>Text of it.</p>"
    for around in ("<div id='header'>Site</div>", "<div class='site-header'>Site</div>", "<div class='search-box'>Find</div>", "<ul class='left-nav'><li>x</ul>", "<p class='advertisement'>Buy</p>", "<ins class='adsbygoogle'>Buy</ins>", "<div role='banner'>x</div>", "<div style='display: none'>x</div>", "<div class='related-posts'><p>More</div>", "<div class='post-comments'><p>I agree</div>"):
        assert h.main_text(f"<body>{around}<article class='post'>{inner}</article>{around}</body>") == "Head\nBy someone\nText of it.", around
    assert h.main_text(f"<body class='has-sidebar'><article class='post no-comments'>{inner}<div class='post-comments'>I agree</div></article>") == "Head\nBy someone\nText of it."


def test_broken_and_empty_pages():
    assert h.main_text("") == "" and h.main_text("<html><body></body>") == ""
    assert h.main_text("<article><p>a < b and c</article>") == "a < b and c"
    assert h.main_text("<article><p title='x > y'>text</p></article>") == "text"
    assert h.main_text("<nav><a>x</a><article><p>kept although nav is open</p></article>") == "kept although nav is open"
    for bad in ("<" * 50_000, "<!--" * 20_000, "<a href='" * 20_000, "<div>" * 60_000 + "</b>" * 60_000, "<b>" * 30_000 + "<p>x" * 30_000, "<a><b>" * 20_000, "<script>" * 20_000, "<svg>" * 20_000):
        began = time.time()
        h.main_text(bad)
        assert time.time() - began < 5


def test_tree_follows_its_table():
    x, y = h.labelled_blocks()
    assert ((h.tree().predict(x) >= 0.5) == (y == 1)).mean() > 0.97
    other, labels = h.labelled_blocks(seed=99, times=3)
    assert ((h.tree().predict(other) >= 0.5) == (labels == 1)).mean() > 0.97
    assert h.features([]).shape == (0, len(h.FEATURES))
    assert np.array_equal(x, h.labelled_blocks()[0])


def test_words_and_links_decide():
    """Without words and link densities the tree decides otherwise on many blocks of the table and of plain pages."""
    x, _ = h.labelled_blocks(seed=99, times=3)
    blank = x.copy()
    blank[:, :6] = 0
    t = h.tree()
    assert ((t.predict(x) >= 0.5) != (t.predict(blank) >= 0.5)).mean() > 0.1
    assert {h.FEATURES[f] for f in t.feature if f >= 0} >= {"words", "links", "words_before", "links_before", "words_after", "links_after"}
    long = "a sentence that has some words in it and goes on, " * 4
    found = h.blocks(f"<div><div>[1]</div><div><a>One two</a></div><div>{long}</div><div>{long}</div><div><a>Next page</a></div></div>")
    x = h.features(found)
    assert (t.predict(x) >= 0.5).tolist() == [False, False, True, True, False]


def test_features_are_the_definition():
    """Words and link densities of every block and its neighbours, counted apart from the parser."""
    page = "<p>one two <a>three</a> four<div><a>five</a></div><p>six <a>seven eight</a> nine ten"
    want = [(4, 0.25), (1, 1.0), (5, 0.4)]
    x = h.features(h.blocks(page))
    for i, (w, l) in enumerate(want):
        before, after = (want[i - 1] if i else (0, 0)), (want[i + 1] if i + 1 < len(want) else (0, 0))
        assert x[i, :6].tolist() == [w, l, *before, *after]


def test_text_is_not_lost_by_a_name():
    long = "a sentence that has some words in it and goes on, " * 4
    text = long.strip()
    keep = lambda page: h.main_text(page).split("\n")
    assert keep(f"<article><p>Intro.</p><h2 id=related-work>Related work</h2><p>{long}</p><h2 id=social-effects>Social</h2><section id=search><p>{long}</p></section></article>") == ["Intro.", "Related work", text, "Social", text]
    assert keep(f"<article><p>{long}</p><div class=notice-board><p>{long}</p></div><section class=nav-history><p>{long}</p></section></article>") == [text] * 3
    assert keep("<article><p>We saw <span class=notice>the notice</span> there and <label>this</label> too.</p></article>") == ["We saw the notice there and this too."]
    assert keep(f"<form id=page><div><a>Home</a> <a>News</a></div><h1>Head</h1><p>{long}</p><p>{long}</p><input></form>") == ["Head", text, text]
    assert keep("<body><p>Just one short paragraph.</p></body>") == ["Just one short paragraph."]
    assert keep(f"<article class=card><h3><a>A teaser of it</a></h3><p>Some few words</p></article><div><h1>The head</h1><p>{long}</p><p>{long}</p></div>") == ["The head", text, text]
    links = "".join(f"<li><a href={i}>another story to read</a>" for i in range(5))
    assert keep(f"<article><p>{long}</p><div class=x17><ul>{links}</ul></div><p>{long}</p></article>") == [text, text]


def test_rows(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (None, None, None), (2, "v", ""), (3, None, "<article>" + "<p>word </p>" * 50_000 + "</article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS n_chars_", "2 AS words", "3 AS label")
    got = h.extract(df).collect()
    assert len(got) == 5 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert {r["page_id"]: r["n_chars"] for r in got}[3] == 5 * 50_000 - 1
    assert sum(r["text"] == "" for r in got) == 2
    assert h.extract(df.limit(0)).count() == 0


def test_query_gives_the_articles(spark, sf):
    """In the tables the article is an element with headings and paragraphs."""
    import html
    import re

    got = {r["page_id"]: r["text"] for r in queries.op3_html_main_text(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        inner = r["html"][r["html"].index("<article>") + 9 : r["html"].index("</article>")]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", " ", p)).split()) for p in re.split("</?(?:p|h1)>", inner)]
        assert got[r["page_id"]] == "\n".join(p for p in parts if p)
