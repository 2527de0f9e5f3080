"""Main text of pages: the parser on awkward markup, repeated runs against brute force."""

import html
import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from sluicegate.llm import markup, queries, repeats

SCHEMA = "page_id long, url string, html string, text string, row long, gone int"
LONG = "word " * 200000


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)


def text_of(page):
    found = markup.blocks(page)
    return " ".join(b.text for b in found if b.says == markup.ARTICLE)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<body><nav>menu</nav><article><h1>T &amp; t</h1><p>one <b>two</b>\n three<br><p>four</article><footer>f</footer>", "T & t one two three four"),
        ("<article><header><h1>Title</h1><p>by me</p></header>x<aside>s</aside><form>f<button>b</button></form><footer>z</footer></article>", "Title x"),
        ('<article>a<p class="ad">foo<p>b</p><div id="postComments"><article>c</article></div><div class="site-notice"><p>n</p></div>d</article>', "a b d"),
        ("<article>a<script>var t='</p><p>no';</script><style>p{}</style><!-- <p>no</p> -->b</article>", "ab"),
        ("<article>&lt;b&gt; 3 < 4 &#228;&nbsp;&eacute; &unknown; a&amp;amp;b</article>", "<b> 3 < 4 ä é &unknown; a&amp;b"),
        ("<article><ul><li>one<li>two</ul><table><tr><td>a<td>b</table></article></div></section>", "one two a b"),
        ('<article class="comment">no</article><article>yes<div hidden>h</div><p style="display: none">i</p><span aria-hidden="true">j</span></article>', "yes"),
        ('<body class="has-sidebar"><div class="shadow"><div itemprop="articleBody">in</div>out</div>', "in"),
        ("<article><p>never closed <b>bold", "never closed bold"),
        ("<article></article>", ""),
    ],
)
def test_blocks(page, want):
    assert text_of(page) == want


def test_deep_and_long_markup():
    assert text_of("<article>" + "<div>" * 20000 + "x" + "<b>" * 20000 + "</i>" * 20000 + "y") == "xy"
    assert len(text_of("<article>" + "<p>a<b>" * 20000)) == 39999


def by_hand(rows, least):
    """Texts of pages, by windows of all pages of a host."""
    parsed = [(i, repeats_host(u), markup.blocks(h)) for i, u, h in rows]
    seen = defaultdict(set)
    windows = lambda tokens: ((k, tuple(tokens[k : k + least])) for k in range(len(tokens) - least + 1) if repeats.BREAK not in tokens[k : k + least])
    for _, at, found in parsed:
        tokens, _, page = repeats.stream(found)
        for _, w in windows(tokens):
            seen[at, w].add(page)
    out = []
    for i, at, found in parsed:
        tokens, starts, _ = repeats.stream(found)
        covered = set()
        for k, w in windows(tokens):
            if len(seen[at, w]) > 1:
                covered |= set(range(k, k + least))
        gone = [s >= 0 and sum(s + 1 + k in covered for k in range(len(b.text.split()))) >= repeats.COVERED * len(b.text.split()) for s, b in zip(starts, found, strict=True)]
        place = [k for k, b in enumerate(found) if b.says == markup.ARTICLE] or [k for k, b in enumerate(found) if b.says == markup.OPEN and b.body] or [k for k, b in enumerate(found) if b.says == markup.OPEN]
        kept = [k for k in place if not gone[k]] or place
        out.append((i, " ".join(found[k].text for k in kept), len(covered)))
    return sorted(out, key=repr)


def repeats_host(url):
    m = re.match(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m.group(1).lower() if m else ""


def made_pages(rng, n):
    words = [f"w{k}" for k in range(40)]
    pick = lambda k: " ".join(rng.choice(words, k))
    shared = [[f"<{t}>{pick(int(rng.integers(1, 14)))}</{t}>" for t in ("nav", "p", "div", "li", "p")] for _ in range(4)]
    bodies = [f"<p>{pick(int(rng.integers(3, 40)))}</p><p>{pick(12)}</p>" for _ in range(12)]
    rows = []
    for i in range(n):
        s = shared[int(rng.integers(4))]
        own = bodies[int(rng.integers(12))] if rng.random() < 0.5 else f"<p>{pick(20)}</p><p>{pick(4)}</p>"
        middle = [f"<article>{own}</article>", f"<main>{own}{s[1]}</main>", own, f"<div class='post-body'>{own}</div>"][int(rng.integers(4))]
        url = ["http://a.com/x", "https://user@A.com:80/y", "//b.org", "none", None][int(rng.integers(5)) if rng.random() < 0.4 else 0]
        rows.append((i, url, f"<body>{s[0]}{s[2]}{middle}{s[3]}{s[4] if rng.random() < 0.5 else ''}</body>"))
    return rows


@pytest.mark.parametrize("unit_tokens", [120, 1 << 20])
def test_repeats_equal_brute_force(spark, unit_tokens):
    rows = made_pages(np.random.default_rng(5), 150)
    rows += [(7, rows[7][1], rows[7][2]), (None, None, None), (900, "http://a.com", ""), (901, "http://a.com", "<article>" + LONG + "</article>"), (902, "http://a.com", LONG), (903, "http://a.com", "<nav>only chrome</nav>")]
    got = repeats.main_text(table(spark, rows).repartition(6), unit_tokens=unit_tokens).collect()
    want = by_hand(rows, 8)
    assert sorted(((r.page_id, r.text) for r in got), key=repr) == [w[:2] for w in want]
    runs = repeats.repeated_runs(repeats.parse(table(spark, rows), "page_id", "url", "html"), 8, unit_tokens).collect()
    assert sorted(r.n_repeated for r in runs if r.n_repeated) == sorted(w[2] for w in want if w[2])
    assert all(r.n_chars == len(r.text) for r in got)
    # open blocks that hosts repeat do go
    assert sum(w[1] != by for w, by in zip(want, [x[1] for x in by_hand(rows, 10**6)], strict=True)) > 20
    assert repeats.main_text(table(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("unit_tokens", [60, 1 << 20])
def test_repeats_decide_between_articles(spark, unit_tokens):
    """Pages with articles go through the suffix arrays too: teasers that the host repeats go, a page's own article stays whole."""
    body = lambda k: " ".join(f"<p>{' '.join(f'{w}{k}' for w in 'abcdefghijkl')}</p>" for k in (k, k + 100, k + 200))
    teaser, single = "<article><h2>Read on</h2><p>one two three four five six seven eight nine</p></article>", "<article><p>only here</p></article>"
    rows = [(k, "http://a.com", f"<article>{body(k)}</article>{teaser}{single if k == 2 else ''}<p>out</p>") for k in range(4)]
    rows += [(4, "http://b.com", f"<article>{body(4)}</article>{teaser}"), (5, "http://a.com", teaser), (6, "http://a.com", f"<article>{body(1)}</article>")]
    rows += [(7, "http://c.com", f"<article>{body(7)}</article>{teaser}"), (8, "http://c.com", f"<article>{body(7)}</article>{teaser}")]  # copies
    got = {r.page_id: r.text for r in repeats.main_text(table(spark, rows).repartition(3), unit_tokens=unit_tokens).collect()}
    plain = lambda h: " ".join(re.sub("<[^>]*>", " ", h).split())
    want = {k: plain(body(k)) for k in range(4)} | {k: plain(body(k) + teaser) for k in (4, 7)} | {5: plain(teaser), 6: plain(body(1)), 8: plain(body(7) + teaser)}
    want[2] += " only here"
    assert got == want
    runs = repeats.repeated_runs(repeats.parse(table(spark, rows), "page_id", "url", "html"), 8, unit_tokens).collect()
    assert len(runs) == len(rows) and sum(any(r.gone) for r in runs) == 4


def test_articles_of_the_table(spark):
    sf = "/root/testdata/sf0.001"
    pages = {r[0]: r[1:] for r in duckdb.sql(f"select page_id, url, html from '{sf}/pages.parquet'").fetchall()}
    got = queries.op11_host_suffix_array(spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        inner = re.search("<article>(.*)</article>", pages[r.page_id][1], re.S).group(1)
        assert r.text == " ".join(html.unescape(re.sub("</?b>", "", re.sub("</?(p|br|h1)>", " ", inner))).split()) and r.url == pages[r.page_id][0]
