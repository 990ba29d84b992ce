"""Main text of web pages: flat text blocks, classified by a decision tree."""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .forest import Tree, grow

# Element names by their part in HTML.
RAW = frozenset("script style noscript template textarea select iframe object svg canvas math audio video head title".split())
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = frozenset("p pre blockquote dd figcaption li".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE = frozenset("nav aside footer menu button dialog search fieldset label".split())
#: Class and id words of what surrounds an article, wherever they stand in a name.
SURE = frozenset("ad ads advert adverts advertisement advertisements advertising adsbygoogle sponsor sponsored sponsors promo promos banner sidebar sidebars navbar breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr newsletter comment comments disqus copyright topbar".split())
#: Those that say so as a whole name or its last word ("site-notice"), but in other names may be an article's own matter ("notice-board").
OFTEN = frozenset("promotion menu menus nav navigation notice notices notification alert popup modal overlay subscribe subscription signup share sharing social related recommended recommendations replies reply respond widget widgets toolbar pagination pager login search skip".split())
#: Words beside which both say what a page has, not what an element is.
ABOUT = frozenset("has with without no post entry article single page content main".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
NAME = re.compile(r"/?([A-Za-z][A-Za-z0-9:-]*)")
REST = re.compile(r"""(?:"[^"]*"|'[^']*'|[^"'>])*+>""")
MARKED = re.compile(r"""(?<![\w-])(class|id|role|hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
HIDDEN = re.compile(r"display\s*:\s*none", re.I)


@dataclass
class Block:
    """Text between two block boundaries, with what stood around it."""

    parts: list[str] = field(default_factory=list)
    linked: list[str] = field(default_factory=list)
    named: list[str] = field(default_factory=list)  # in inline elements named for what surrounds articles
    furniture: bool = False
    sure: bool = False
    often: bool = False
    form: bool = False
    inside: bool = False
    heading: bool = False
    prose: bool = False
    text: str = ""

    def close(self) -> bool:
        raw = "".join(self.parts)
        self.text = " ".join(html.unescape(raw).split() if "&" in raw else raw.split())
        if self.named and 2 * len(" ".join(self.named).split()) > self.words:
            self.sure = True
        return bool(self.text)

    @property
    def words(self) -> int:
        return self.text.count(" ") + 1

    @property
    def links(self) -> float:
        return min(1.0, len(" ".join(self.linked).split()) / self.words)


def _hints(name: str, attributes: str, inside: bool) -> tuple[bool, bool, bool]:
    """Whether an element is furniture by its tag or role; sure, or often, so by its names."""
    furniture = name in FURNITURE or name == "header" and not inside
    sure = often = False
    if not attributes or name in ("html", "body", "main"):
        return furniture, sure, often
    for m in MARKED.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden":
            sure = True
        elif key == "role":
            furniture |= value in ROLES
        elif name not in HEADINGS or key == "class":
            for token in value.split():
                words = re.split("[^a-z0-9]+", token)
                if words[0] in ("has", "with", "no", "without"):
                    continue
                if "header" in words and not inside and name not in HEADINGS:
                    furniture = True
                about = not ABOUT.isdisjoint(words) and words[-1] not in SURE and words[-1] not in OFTEN
                if about or SURE.isdisjoint(words) and OFTEN.isdisjoint(words):
                    continue
                if not SURE.isdisjoint(words) or words[-1] in OFTEN and not (inside and key == "id"):
                    sure = True
                else:
                    often = True
    return furniture, sure or "style" in attributes.lower() and HIDDEN.search(attributes) is not None, often


def blocks(page: str) -> list[Block]:
    """The page's non-empty blocks in order. Unclosed and stray tags are borne; one pass, no recursion."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, bool, bool]] = []  # open elements: name, furniture, sure, often, inline with a name
    opened: Counter[str] = Counter()  # names on the stack, so that stray tags need no search
    furniture = sure = often = named = 0
    now = Block()
    at, n = 0, len(page)
    no_comment_end = no_quote_end = False
    closed: set[str] = set()  # raw elements known to have no further end tag

    def flush() -> None:
        nonlocal now
        if now.parts and now.close():
            out.append(now)
        now = Block()
        place()

    def place(heading: bool = False, prose: bool = False) -> None:
        """What surrounds the block that begins here."""
        now.furniture, now.sure, now.often = furniture > 0, sure > 0, often > 0
        now.form, now.inside = opened["form"] > 0, opened["article"] + opened["main"] > 0
        now.heading, now.prose = heading, prose

    def add(text: str) -> None:
        now.parts.append(text)
        if opened["a"]:
            now.linked.append(text)
        if named:
            now.named.append(text)

    def pop(to: int) -> None:
        nonlocal furniture, sure, often, named
        while len(stack) > to:
            name, f, s, o, i = stack.pop()
            opened[name] -= 1
            furniture -= f
            sure -= s
            often -= o
            named -= i

    while at < n:
        tag = page.find("<", at)
        if tag < 0:
            add(page[at:])
            break
        if tag > at:
            add(page[at:tag])
        if page.startswith("<!--", tag):
            end = -1 if no_comment_end else page.find("-->", tag + 4)
            no_comment_end = end < 0
            at = end + 3 if end >= 0 else n
            continue
        m = NAME.match(page, tag + 1)
        if not m:
            if page[tag + 1 : tag + 2] in ("!", "?", "/"):
                end = page.find(">", tag + 1)
                at = end + 1 if end >= 0 else n
            else:
                add("<")
                at = tag + 1
            continue
        name, ending = m[1].lower(), page[tag + 1] == "/"
        end = page.find(">", m.end())
        if end < 0:
            break
        if not no_quote_end and not ending and end - m.end() > 1:
            quoted = page.count('"', m.end(), end) % 2 or page.count("'", m.end(), end) % 2
            if quoted and (r := REST.match(page, m.end())):
                end = r.end() - 1
            elif quoted:
                no_quote_end = True
        attributes = page[m.end() : end]
        at = end + 1
        if ending:
            if name in BLOCK or name == "p":
                flush()
            if opened[name]:
                pop(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name))
            if name in BLOCK:
                place()
            continue
        if name in RAW:
            if not attributes.endswith("/") or name in ("script", "style", "title", "head"):
                if name == "head":
                    stop = re.compile(r"</head\s*>|<body[\s>]", re.I).search(page, at)
                    if stop:
                        at = stop.start() if stop[0][1] != "/" else stop.end()
                    continue
                low = None if name in closed else re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
                if low is None:
                    closed.add(name)
                    if name in ("script", "style", "textarea", "title"):
                        break
                    continue
                end = page.find(">", low.end())
                at = end + 1 if end >= 0 else n
            continue
        if name == "br" or name == "wbr":
            add("\n" if name == "br" else "")
            continue
        if name in VOID and name != "hr":
            continue
        if name in BLOCK:
            flush()
            if name in ("article", "main"):
                while opened["nav"] + opened["header"] + opened["menu"]:
                    pop(next(k for k, s in enumerate(stack) if s[0] in ("nav", "header", "menu")))
            elif name in ("p", "li", "td", "th", "tr", "dt", "dd", "option") and opened[name]:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in ("ul", "ol", "dl", "table", "div", "section", "article", "aside", "nav", "footer", "form", "blockquote", "main", "body"):
                        break
                    if stack[k][0] == name:
                        pop(k)
                        break
        if name == "hr" or attributes.endswith("/") and name not in BLOCK and name != "a":
            continue
        if name == "a" and opened["a"]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in BLOCK:
                    break
                if stack[k][0] == "a":
                    pop(k)
                    break
        f, s, o = _hints(name, attributes, opened["article"] + opened["main"] > 0)
        i = name not in BLOCK and (f or s or o)
        if i:  # part of a line, which is judged as a whole
            f = s = o = False
        stack.append((name, f, s, o, i))
        opened[name] += 1
        furniture += f
        sure += s
        often += o
        named += i
        if name in BLOCK:
            place(name in HEADINGS, name in PROSE)
    flush()
    return out


#: In the order of the columns: words and link density of a block and its neighbours, then marks.
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "furniture", "sure", "often", "form", "inside", "heading", "prose", "article_share")


def features(found: list[Block]) -> np.ndarray:
    """One row per block, of FEATURES.

    The last is the share that article elements have of the page's words outside links and furniture.
    """
    words = np.array([0, *(b.words for b in found), 0], dtype=float)
    links = np.array([0, *(b.links for b in found), 0], dtype=float)
    free = [b.words * (1 - b.links) * (not (b.furniture or b.sure)) for b in found]
    share = sum(w for w, b in zip(free, found) if b.inside) / (sum(free) or 1)
    own = np.array([[b.furniture, b.sure, b.often, b.form, b.inside, b.heading, b.prose, share] for b in found], dtype=float).reshape(-1, 8)
    return np.column_stack([words[1:-1], links[1:-1], words[:-2], links[:-2], words[2:], links[2:], own])


#: The labelled table: pages as they are built, with § before each block that is the article's.
#: A number stands for so many words, a number in brackets for a link of so many.
LABELLED = """
<header><a href=/>[2]</a></header><nav><ul><li>[1]<li>[1]<li>[2]</ul></nav><article><h1>§7</h1><p>§60</p><p>§45 [2] 20</p><p>§3</p><p>§80</p></article><footer>5 [2]</footer>
<nav><ul><li>[1]<li>[1]<li>[1]</ul></nav><div class=ad>8</div><article><h1>§9</h1><p>§4</p><p>§30</p><p>§1</p></article><footer>6</footer>
<div class=menu>[1] [1] [1]</div><div id=content><h1>§6</h1><p>§70</p><p>§12</p><h2>§3</h2><p>§40 [3] 8</p><p>§90</p></div><div class=sidebar><h3>2</h3><ul><li>[5]<li>[6]</ul></div><div id=footer>9</div>
<ul><li>[1]<li>[2]<li>[1]<li>[1]</ul><table><tr><td>[2]<td><h1>§5</h1>§85<p>§60<p>§7<p>§55</table><p>[2] [2] [3]</p>
<form action=/page><div>[1] [1] [2]</div><h1>§6</h1><p>§75</p><p>§50</p><p>§9</p><p>§65</p><div>2 <input> <button>1</button></div></form>
<form action=/page><ul><li>[1]<li>[1]</ul><h2>§4</h2><p>§38</p><p>§64</p><p>§22</p><label>1</label><input><div>[3]</div></form>
<article><h1>§6</h1><p>§55</p><form><p>4</p><label>2</label><input><p>3</p><button>1</button></form><p>§40</p><div class=newsletter><p>12</p></div><p>§33</p></article>
<main><h1>§4</h1><p>§50</p><form><div>6</div><div>2</div><div>1</div></form><p>§72</p></main><form><p>5</p><p>14</p></form>
<form><p>40</p></form><article><h1>§4</h1><p>§30</p><form><p>30</p><p>3</p></form><p>§8</p><p>§44</p></article><form><p>3</p><p>60</p></form>
<p>§5</p>
<p>§14</p>
<h1>§4</h1><p>§12</p>
<div>§9</div>
<body><h1>§3</h1><p>§11<p>§6</body>
<div>[2]</div><p>§10</p><p>§8</p><div>[1] [1] [1]</div>
<article class=card><h3>[4]</h3><p>9 [2]</p></article><div class=text><h1>§6</h1><p>§80</p><p>§66</p><p>§10</p><p>§48</p></div><article class=card><h3>[5]</h3><p>10</p></article>
<article class=teaser><h2>[6]</h2><p>14 [2]</p></article><h1>§5</h1><p>§90</p><p>§70</p><h2>§3</h2><p>§64</p>
<article><h1>§6</h1><p>§60</p><div class=box><ul><li>[5]<li>[7]<li>[6]<li>[4]</ul></div><p>§44</p><div class=x1><p>[8]</p><p>[6]</p><p>[7]</p></div><p>§52</p></article>
<article><h1>§8</h1><p>§42</p><p>§[4]</p><p>§38</p><ul><li>§6<li>§[2] 7<li>§9 [1] 3</ul><p>§25</p></article>
<div class=search-box>1</div><article><h1>§1</h1><p>§3</p><p>§4</p></article><div class=search-box>2</div>
<div class=widget-area>3</div><article><h1>§3</h1><p>§12</p><p>§30</p></article><div class=share-bar>1</div><div class=related-posts><p>2</div>
<div class=login-box>2</div><div><h1>§4</h1><p>§26</p><p>§9</p><p>§45</p></div><div class=social-bar>1</div><div class=search-form>2 1</div>
<div>[2]</div><div>§60</div><div>§44</div><div>[3]</div>
<div>[1] [1]</div><div>[2]</div><div><div>§48</div><div>§52</div><div>§9</div><div>§70</div></div><div>[2]</div><div>2 [1]</div>
<table><tr><td>[1] [2] [1]<tr><td>§55<br>20<tr><td>§40 [2] 6<tr><td>[2]<td>[1]</table>
<div>2</div><article><h1>§2</h1><p>§4</p><p>§6</p></article><div>1</div><p>4</p>
<article><h1>§3</h1><p>§2 [1] 3</p><p>§3</p><ul><li>§1<li>§1</ul><p>§1</p><table><tr><td>§1<td>§1<tr><td>§2<td>§1</table></article>
<article><h1>§3</h1><p>§2 [1] 2</p><p>§[1] 3</p><p>§4 [2]</p><p>§2 [1]</p><h2>§2</h2><p>§5 [2] 3</p></article><section id=comments><article><p>14</p></article></section>
<article><div>§3 [1]</div><div>§1</div><div>§6 [2] 4</div><div>§2</div><h2>§3</h2><div>§[1] 4 [2]</div><div>§1</div></article><aside>6</aside>
<nav><a>1</a></nav><main><h1>§2</h1><p>§5</p><p>§8 [3] 2</p><dl><dt>§1<dd>§4<dt>§2<dd>§3 [1]</dl><p>§7 [1]</p></main><div>5</div>
<article><p>§30 [8] 12</p><p>§9 [6]</p><ul><li>§4 [2]<li>§6 [4] 2<li>§3</ul><p>§50 [10]</p><h2>§[3]</h2><p>§24</p></article>
<article><h1>§8</h1><p>§12 [6] 4</p><p>§30</p><blockquote>§[3] 15</blockquote><p>§[2]</p><p>§28</p></article>
<article><h1>§5</h1><p>§40</p><div class=related-posts><h3>2</h3><ul><li>[6]<li>[7]<li>[5]</ul></div><p>§36</p><div class=share-buttons>[1] [1] [1]</div></article>
<article><h1>§5</h1><section id=related-work><h2>§2</h2><p>§60</p><p>§45 [1] 9</p></section><section id=search><p>§70</p><p>§9</p></section></article>
<article><section id=social-effects><h2>§2</h2><p>§48</p><p>§31</p></section><div class=notice-board><p>§40</p><p>§52</p></div><section class=nav-history><h2>§4</h2><p>§58</p></section></article>
<article><p>§45</p><div class=search-box>3</div><p>§50</p><div class=social-links>[1] [1]</div><div class=widget-area><h4>2</h4><p>6 [2]</p></div><div class=login-box><p>3</p><p>1</p></div><div class=subscribe-form>2</div><p>§38</p></article>
<article><h1>§5</h1><p>§50</p><div class=ad-slot>4</div><p>§34</p><aside>12</aside><p>§44</p><div class=promo>10</div></article><section id=comments><h3>2</h3><article><p>18</p></article><article><p>40</p></article></section>
<div id=cookie-notice><p>24 [2]</p></div><article><h1>§4</h1><p>§28</p><p>§3</p></article><div class=post-comments><p>35</p><p>8</p></div><aside><p>30</p></aside>
<div class=comments><p>60</p><p>25</p></div><main><h1>§5</h1><p>§44</p><p>§6</p><table><tr><td>§2<td>§1<tr><td>§3<td>§2</table></main><div class=site-notice>30</div>
<div class=notice>40</div><div class=page><h1>§5</h1><p>§62</p><p>§35</p><aside>40 [2]</aside><p>§70</p></div><div class=comment-list><p>45</p><p>22</p></div><footer><p>30</p></footer>
<nav><p>20</p><p>[2]</p></nav><div><h1>§6</h1><p>§33</p><p>§54</p><h3>§2</h3><p>§5</p><p>§61</p></div><footer><p>40</p><p>[3] [2]</p></footer><div class=banner>14</div>
<article><h1>§4</h1><p>§16</p></article><p>20</p><div>[3] 2</div><div>12</div><p>45</p>
<article><h1>§9</h1><p>§130</p><p>§260</p><p>§180</p></article><div>9</div><p>60</p><p>8 [2]</p>
<header><h1>3</h1><p>8</p></header><div><h2>§5</h2><p>§47</p><p>§58</p><ul><li>§8<li>§12<li>§6</ul><p>§80</p></div><div>[2] [2] [1] [3]</div><div>6 [2]</div>
<div>[1]</div><div>[2]</div><div>[1]</div><div>3</div><h1>§7</h1><div>§110</div><div>§95</div><div>§14</div><div>§120</div><div>[4]</div><div>[5]</div>
<div>2</div><div>[2]</div><div>4</div><div>[3]</div><h1>§6</h1><p>§22</p><p>§41</p><p>§18</p><div>[2]</div><div>3</div><div>[2] [2]</div>
"""


def labelled_blocks(seed: int = 5, times: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of LABELLED, each page ``times`` times with its numbers varied.

    Small numbers vary by up to twice, those from 20 on by up to four times either
    way, as paragraphs do, so that no single length is a mark by itself.
    """
    rng = np.random.default_rng(seed)
    rows, y = [], []

    def words(m: re.Match) -> str:
        n = int(m[1] or m[2])
        n = max(1, round(n * np.exp(rng.uniform(-0.7, 0.7) if n < 20 else rng.uniform(-1.4, 1.4))))
        return f"<a>{'x ' * n}</a>" if m[1] else "x " * n

    for page in LABELLED.strip().split("\n"):
        for _ in range(times):
            found = blocks(re.sub(r"\[(\d+)\]|(?<![\w/])(\d+)(?![\w>])", words, re.sub("§", " § ", page)))
            label = [b.text.startswith("§") for b in found]
            for b in found:
                b.text = b.text.removeprefix("§").strip()
            rows.append(features(found))
            y += label
    return np.concatenate(rows), np.array(y, dtype=float)


@lru_cache(maxsize=1)
def tree() -> Tree:
    """Grown once in each worker; the table and so the tree are the same everywhere."""
    return grow(*labelled_blocks(), depth=12, leaf=30)


def main_text(page: str) -> str:
    found = blocks(page)
    if not found:
        return ""
    keep = tree().predict(features(found)) >= 0.5
    return "\n".join(b.text for b, k in zip(found, keep) if k)


@F.pandas_udf(T.StringType())
def main_text_udf(page: pd.Series) -> pd.Series:
    return pd.Series([main_text(p) for p in page], dtype=object)


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: ``page_id``, ``url``, ``text``, ``n_chars``.

    Whole pages are read, in time linear in their length; null and empty ones
    give an empty text, as do those with no block that the tree takes. A block
    whose leaf is a tie is taken. Repeated rows stay; other columns are not
    read, so their names don't matter. No pages: no rows. No shuffle.
    """
    got = pages.select("page_id", "url", main_text_udf(F.coalesce("html", F.lit(""))).alias("text"))
    return got.withColumn("n_chars", F.length("text").cast("long"))
