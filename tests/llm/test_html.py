"""HTML extraction: pages of many kinds, the cut against all labellings, the given table against its own template."""

import html
import itertools
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from vitrine.llm import html_extraction as extraction
from vitrine.llm.queries import queries

SF = "/root/testdata/sf0.001"
PRIOR = extraction.odds_of({})
LONG = "The committee met on Tuesday to discuss the new budget, and after several hours of debate it was adopted by a narrow majority."

PAGES = {
    "classes": (f'<div id="header"><a href=/>Home</a> <a href=/n>News</a></div><div class="content"><h1>Big day</h1><p>{LONG}</p><p>Short one.</p><div class="ad">Buy now!</div>'
                f'<p>{LONG}</p></div><div class="sidebar"><h3>Related</h3><ul><li><a>One</a><li><a>Two</a></ul></div><div id="comments"><div class="comment"><p>{LONG} Nonsense.'
                "</p></div></div><div class=footer>&copy; 2020</div>", f"Big day {LONG} Short one. {LONG}"),
    "no names": (f"<body><div><a href=/>Home</a><a href=/n>News</a></div><div><p>{LONG}</p><p>Short one.</p><p>{LONG}</p></div><div><a href=1>More stories here</a></div>"
                 "<div>Copyright 2020 Foo Inc</div>", f"{LONG} Short one. {LONG}"),
    "article header": (f"<header><h1>Site</h1></header><main><article><header><h1>Title</h1></header><p>{LONG}<form><label>Mail</label><button>Go</button></form>"
                       f"<section class=comments><article><p>{LONG}</p></article></section></article></main><aside>Aside. {LONG}</aside>", f"Title {LONG}"),
    "notice": (f'<div class="cookie-notice"><p>We use cookies to improve your experience on this site. {LONG}</p></div><div class="post-body"><p>{LONG}</p></div>', LONG),
    "unseen": (f'<article><p style="display:none">no</p><p hidden>no</p><p>{LONG}</p><noscript>no</noscript><template><p>no</p></template><svg><text>no</text></svg></article>', LONG),
    "table": (f"<table><tr><td><a>Menu</a><td><p>{LONG}<p>{LONG}<td>x</table>", f"{LONG} {LONG}"),
    "plain": ("Just text here without markup.", "Just text here without markup."),
    "comments in markup": ("<!-- <p>x</p> --><article><p>a<!-- b -->c</p><!-- never ends <p>d", "ac"),
    "broken": ('<article><p>one <b>two<p>three <a href="x>four</a> five</p>', "one two three four five"),
    "scripts": ('<article><script>var a="</p><p>no";</script><p>yes</p><SCRIPT>no</SCRIPT ><style>p</style><p>if 1 < 2 &lt;b&gt;</p></article>', "yes if 1 < 2 <b>"),
    "layout names": (f'<body class="has-sidebar comments-open"><div class="wrapper page-header-layout"><div class="entry-content"><p>{LONG}</p></div></div>', LONG),
    "lists": (f"<article><h2>T</h2><ul><li>One<li>Two</ul><table><tr><th>A<th>B<tr><td>1<td>2</table><pre>x\n\t y</pre><p>{LONG}</p></article>", f"T One Two A B 1 2 x y {LONG}"),
    "advert in a line": (f'<article><p>Before {LONG} <span class="ad">Buy me</span> after.</p></article>', f"Before {LONG} after."),
    "references": ("<article><p>a&nbsp;b &amp;amp; &eacute;&#233;&#xE9; &copy 2 &unknown; &#x1F600;</p></article>", "a b &amp; ééé © 2 &unknown; 😀"),
    "inline": ("<article><p>un<b>bro</b>k<i>en</i> a<br>b <a href=x>link</a>ed</p></article>", "unbroken a b linked"),
    "nothing": ("<html><body></body></html>", ""), "empty": ("", ""), "null": (None, ""), "blank": (" \n ", ""),
    "only boilerplate": ("<nav><a>x</a></nav><footer>&copy; us</footer>", ""),
}


@pytest.mark.parametrize("name", PAGES)
def test_main_text(name):
    page, want = PAGES[name]
    assert extraction.main_text(page, PRIOR) == want


def energy(side, source, sink, edges):
    cut = sum(s if not on else t for on, s, t in zip(side, source, sink, strict=True))
    return cut + sum(c for a, b, c in edges if side[a] != side[b])


def test_cut_against_all_labellings():
    rng = random.Random(8)
    for _ in range(300):
        n = rng.randint(1, 9)
        source, sink = ([rng.choice([0, 0, 1, 5, 9, 20]) for _ in range(n)] for _ in range(2))
        edges = [(a, b, rng.choice([0, 1, 2, 7])) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.6]
        got = extraction.minimum_cut(n, source, sink, edges)
        best = min((energy(s, source, sink, edges), sum(s), s) for s in itertools.product([False, True], repeat=n))
        assert energy(got, source, sink, edges) == best[0] and sum(got) == best[1]


def test_neighbours_decide_what_text_leaves_open():
    short = "<p>Two words</p>"
    assert extraction.main_text(f"<div><p>{LONG}</p>{short}<p>{LONG}</p></div>", PRIOR) == f"{LONG} Two words {LONG}"
    assert extraction.main_text(f"<div><a>Home page</a></div><div>{short.replace('p>', 'div>')}</div><div><a>Other page</a></div>", PRIOR) == ""


@pytest.mark.parametrize("page", ["<div>" * 100_000, "<" * 300_000, '<a href="' * 100_000, "<!--" * 100_000, "<li>a" * 50_000, "<svg>" * 100_000, "&am" * 200_000,
                                  "<b>" * 30_000 + "<p>x" * 30_000, "<div><span>" * 30_000 + "</div>" * 30_000, "<article><p>hello you</p></article><nav>x</nav>" * 10_000])
def test_long_pages_take_time_in_proportion(page):
    begun = time.perf_counter()
    extraction.main_text(page, PRIOR)
    assert time.perf_counter() - begun < 20


def test_counts_move_the_odds_within_bounds():
    seen = {("words", 4, 1): 10**6, ("words", 0, 0): 10**6}
    odds = extraction.odds_of(seen)
    assert odds["words"][4] > PRIOR["words"][4] and odds["words"][0] < PRIOR["words"][0] and abs(odds["words"][2]) < 4
    assert odds["links"] == PRIOR["links"]


def plain_article(page):
    """The article of the tables' only template: its blocks, without tags."""
    inside = re.search("<article>(.*?)</article>", page, re.S)[1]
    return " ".join(html.unescape(re.sub("</?b>", "", re.sub(r"</?(?:p|h1|br)>", " ", inside))).split())


def test_given_pages(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = queries()["op13_html_extraction"](spark, SF).collect()
    assert sorted(r.page_id for r in rows) == sorted(pages)
    for r in rows:
        assert r.url == pages[r.page_id].url and r.n_chars == len(r.text) and r.text == plain_article(pages[r.page_id].html)


def test_rows_pass_one_by_one(spark):
    rows = [(i, None if i % 3 else "u", page) for i, (page, _) in enumerate(PAGES.values())]
    df = spark.createDataFrame([*rows, *rows, (None, None, PAGES["plain"][0])], "page_id long, url string, html string").withColumns({"text": F.lit(1), "n_chars": F.lit("x")})
    got = extraction.extract(df, extraction.fit(df)).collect()
    wants = [want for _, want in PAGES.values()]
    assert len(got) == 2 * len(rows) + 1
    assert all(r.n_chars == len(r.text) for r in got) and all(r.text == wants[r.page_id] for r in got if r.page_id is not None)
    assert extraction.extract(df.limit(0), extraction.fit(df.limit(0))).count() == 0
    with pytest.raises(ValueError):
        extraction.extract(df, PRIOR, keys=("text",))
