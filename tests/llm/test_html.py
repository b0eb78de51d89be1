"""HTML extraction: page differencing, markup checks, and the alignment by brute force."""

import random
import re
import time
from collections import Counter
from functools import cache
from html import unescape

import pytest

from bookdesk.llm import html_extract as he
from bookdesk.llm.tables import workers_find_package

SMALL = "/root/testdata/sf0.01"


def plain_length(a, b):
    @cache
    def best(i, j):
        if i == len(a) or j == len(b):
            return 0
        return 1 + best(i + 1, j + 1) if a[i] == b[j] else max(best(i + 1, j), best(i, j + 1))
    return best(0, 0)


@pytest.mark.parametrize("held", [1 << 28, 20, 1])
def test_longest_common_subsequence(held):
    for seed in range(400):
        rng = random.Random(seed)
        a, b = ([rng.choice("abcde"[:rng.randrange(1, 6)]) for _ in range(rng.randrange(25))] for _ in range(2))
        left, right = he.aligned(a, b, held)
        assert [a[i] for i in left] == [b[j] for j in right] and len(left) == plain_length(tuple(a), tuple(b))
        assert left == sorted(set(left)) and right == sorted(set(right))


def text_of(html):
    lines, flags = he.lines_of(html)
    return [x for x, f in zip(lines, flags, strict=True) if not f & (he.HARD | he.HINT)]


@pytest.mark.parametrize("html,want", [
    ("", []), ("no markup &amp; all", ["no markup & all"]), ("a < b and 1<2", ["a < b and 1<2"]), ("<p>one<p>two", ["one", "two"]),
    ("<p>a <b>b</b>c\n\t d&nbsp;e<br>f</p>g", ["a bc d e f", "g"]), ("x<!-- <p>no</p> -->y<!-->z", ["xyz"]), ("a<!-- open", ["a"]),
    ("<script>if (a<b) '</p>'</script>k<style>p{}</style>", ["k"]), ("<SCRIPT>x</SCRIPT >after", ["after"]), ("<script>open", []),
    ("<title>t</title><h1>H</h1>", ["H"]), ("<a title='a > b' href=\"x>y\">link</a>", ["link"]), ('<a title="open>t</a>', ["t"]),
    ("<p title=it's>don't</p><p a='>'>x", ["don't", "x"]), ("<!DOCTYPE html><?php x ?><![CDATA[c]]>t</ >", ["t"]),
    ("<ul><li>1<li>2<ul><li>3</ul><li>4</ul>5", ["1", "2", "3", "4", "5"]), ("<dl><dt>a<dd>b<dt>c</dl>", ["a", "b", "c"]),
    ("<table><tr><td>1<td>2<tr><th>3</th><td>4</table>", ["1 2", "3 4"]), ("&lt;p&gt; &#233;&#xe9;&eacute; &unknown; &", ["<p> ééé &unknown; &"]),
    ("<nav>m</nav><aside>s</aside><footer>f</footer><form>q</form><button>b</button>t", ["t"]),
    ("<div class='ad'>a<div>b</div>c</div>t", ["t"]), ("<p class=cookie-notice>c<p>t", ["t"]), ("t <span class=ad>x</span> u", ["t", "u"]),
    ("<div id=siteNav>m</div><div class='has-sidebar no-ads'>t</div>", ["t"]), ("<div hidden>a</div><p style='display: none'>b</p>c", ["c"]),
    ("<div role=navigation>a</div><p aria-hidden=true>b</p>c", ["c"]), ("<section class=comments><article>c</article></section>t", ["t"]), ("<article class=comment>c</article><article class='post comments-open'>t</article>", ["t"]),
    ("<header>site</header><article><header><h1>T</h1></header>x<footer>f</footer></article>", ["T", "x"]),
    ("<h2 class=header>kept</h2>", ["kept"]), ("<b>" * 50 + "deep" + "</i>" * 50 + "</p></div>", ["deep"]), ("<p>\x0b\x1c  </p>", []),
    ("<svg><text>x</text></svg>y<svg/>z", ["y", "z"]), ("<textarea><p>x</p></textarea><select><option>a<option>b</select>t", ["t"]),
    ("<pre> a\n  b </pre>", ["a b"]), ("half <", ["half <"]), ("cut <a href=", ["cut"]), ("<p/>x</p>y", ["x", "y"]),
])
def test_lines(html, want):
    assert text_of(html) == want


MENU = "<div><ul><li>Home<li>News<li>About us</ul></div>"
FOOT = "<div><p>All rights reserved.<p>Imprint</div>"


def page(body, menu=MENU, foot=FOOT):
    return f"<html><body>{menu}{body}{foot}</body></html>"


def extracted(spark, rows, plan=he.PLAN):
    workers_find_package(spark)
    df = spark.createDataFrame([(i, u, h, "x", 7) for i, (u, h) in enumerate(rows)],
                               "page_id long, url string, html string, text string, lines int")
    return [tuple(r[1:]) for r in sorted(map(tuple, he.extract(df, plan).collect()))]


@pytest.mark.parametrize("per_range", [2000, 1])
def test_shared_lines_go_where_no_markup_names_the_article(spark, per_range):
    own = [f"<h1>Title {i}</h1><p>Sentence {i} of a page.<p>More text about number {i * 7919}." for i in range(6)]
    rows = [(f"http://Site.example/news/{i}", page(own[i])) for i in range(6)]
    rows += [("http://other.example/x", page("<p>alone on its host"))]  # no neighbour: all stays
    got = extracted(spark, rows, he.PLAN._replace(per_range=per_range))
    for i in range(6):
        assert got[i][:3] == (rows[i][0], "\n".join(he.lines_of(own[i])[0]), len("\n".join(he.lines_of(own[i])[0])))
        assert got[i][3] == 5
    assert got[6][1] == "Home\nNews\nAbout us\nalone on its host\nAll rights reserved.\nImprint"


def test_the_nearer_path_is_the_neighbour(spark):
    rows = [("http://h.example/a/1", page("<p>a one")), ("http://h.example/a/2", page("<p>a two")),
            ("http://h.example/b/1", page("<p>b one", "<p>other menu")), ("http://h.example/b/2", page("<p>b two", "<p>other menu"))]
    assert [g[1] for g in extracted(spark, rows)] == ["a one", "a two", "b one", "b two"]


def test_copies_say_nothing_of_each_other(spark):
    long = "<p>A long article that two addresses hold, far longer than the menu and the notes around it."
    rows = [("http://h.example/n/1", page(long)), ("http://h.example/n/2", page(long)), ("http://h.example/n/3", page("<p>Third text, its own, and quite long as well."))]
    got = [g[1] for g in extracted(spark, rows)]
    assert got[1] == he.lines_of(long)[0][0] and got[2] == "Third text, its own, and quite long as well."
    assert got[0].startswith("Home") and he.lines_of(long)[0][0] in got[0]  # its one neighbour is its copy


def test_articles_keep_what_they_share(spark):
    body = "<article><h1>Head {0}</h1><p>Licence line.<p>Own {0}.<div class='share-buttons'>Share</div><section id=comments><p>Nice!</section></article>"
    rows = [(f"http://h.example/{i}", page(body.format(i)) + "<script>x</script>") for i in range(3)]
    rows += [("http://h.example/9", "<div class='page sidebar-left'><article><p>In a named frame.</article></div>"),
             ("http://h.example/m", "<main><h1>Main head</h1><article><p>Text.</article><p>Not the article.</main>"),
             ("http://h.example/c", "<div id=content><p>Named part.</div><p>Outside of it.")]
    got = extracted(spark, rows)
    assert [g[1] for g in got[:3]] == [f"Head {i}\nLicence line.\nOwn {i}." for i in range(3)]
    assert [g[4] for g in got[:3]] == [1, 1, 1]
    assert [g[1] for g in got[3:]] == ["In a named frame.", "Main head\nText.", "Named part."]


def test_awkward_rows(spark):
    rows = [(None, None), (None, ""), ("no scheme", "<p>x"), ("http://h", "<p>y"), ("http://h", "<p>y"), ("HTTP://H/?q#f", "<p>z")]
    got = extracted(spark, rows)
    assert [g[:3] for g in got] == [(None, "", 0), (None, "", 0), ("no scheme", "x", 1), ("http://h", "y", 1), ("http://h", "y", 1),
                                    ("HTTP://H/?q#f", "z", 1)]
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert he.extract(df).collect() == []
    df = spark.createDataFrame([(None, "http://h/1", "<p>q")] * 3, "page_id long, url string, html string")
    assert Counter(map(tuple, he.extract(df).collect())) == Counter([(None, "http://h/1", "q", 1, 0, 0)] * 3)


def test_long_pages_take_linear_time():
    for piece in ("<p>word word", "<b>x", "<div>", "</div>", "<a href='", "&amp;", "<!-- c -->", "<li>x", "< ", "<span class=ad>", "<!--", "</"):
        html = piece * (500_000 // len(piece))
        at = time.monotonic()
        he.lines_of(html)
        assert time.monotonic() - at < 10, piece
    lines = [f"line {i % 500}" for i in range(30_000)]
    at = time.monotonic()
    left, _ = he.aligned(lines, lines[7:] + lines[:7])
    assert len(left) >= len(lines) - 7 and time.monotonic() - at < 30


def test_pages_of_the_table_give_their_articles(spark):
    """Against a plain reading of these pages' own layout, whose articles hold no nested elements but h1, p, b and br."""
    workers_find_package(spark)
    df = spark.read.parquet(f"{SMALL}/pages.parquet")
    got = {r.page_id: r for r in he.extract(df).collect()}
    rows = df.collect()
    assert len(got) == len(rows)
    for r in rows:
        article = re.search("<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(unescape(re.sub("<[^>]*>", "", re.sub("<br>", " ", x))).split()) for x in re.split("</?(?:h1|p)>", article)]
        text = "\n".join(x for x in blocks if x)
        assert (got[r.page_id].url, got[r.page_id].text, got[r.page_id].n_chars) == (r.url, text, len(text))
