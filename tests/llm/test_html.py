"""Main text: tree matching against its definition, templates, marks, and the article of every page."""

from __future__ import annotations

import re
import time
from html import unescape

from hypothesis import given
from hypothesis import strategies as st

from sievework.llm import html_extract, queries

SF = "/root/testdata/sf0.01"


def tree(shape):
    node = html_extract.Node("div", shape[0], False, False)
    for kid in shape[1]:
        node.kids.append(tree(kid))
    return node


def brute(a, b):
    """The definition: best order-keeping choice over all ways to pair or skip children."""
    if a[0] != b[0]:
        return 0

    def best(x, y):
        if not x or not y:
            return 0
        return max(best(x[1:], y), best(x, y[1:]), best(x[1:], y[1:]) + brute(x[0], y[0]))

    return 1 + best(a[1], b[1])


SHAPES = st.recursive(st.sampled_from("ab").map(lambda c: (c, [])), lambda s: st.tuples(st.sampled_from("ab"), st.lists(s, max_size=3)), max_leaves=7)


@given(SHAPES, SHAPES)
def test_simple_tree_matching(a, b):
    x, y = tree(a), tree(b)
    assert html_extract.matched(x, y) == brute(a, b)
    if a[0] == b[0]:
        pairs = html_extract.align(x, y)
        assert len(pairs) == brute(a, b) and all(p.label == q.label for p, q in pairs)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="home">
<header><h1>Site</h1><nav>menu</nav></header><div id="cookie-notice">We use cookies</div><!-- <p>no</p> -->
<main><article><header><h1>Real <em>title</em></h1></header><p>One &amp; two<br>three&nbsp;four<p>open <b>para
<ul><li>a<li>b</ul><div class="advert">buy</div><form><input name=q><button>Go</button></form>
<p>it's <span hidden>no</span>fine <a href="x>y">link</a> end<table><tr><td>c1<td>c2</table>
<section id="comments"><article class="comment"><p>nice</p></article></section></article></main>
<aside>side</aside><footer>f</footer></body></html>"""
WANT = ["Real title", "One & two three four", "open para", "a", "b", "it's fine link end", "c1", "c2"]


def test_marks_of_a_page():
    assert html_extract.main_text(PAGE).split("\n\n") == WANT
    assert html_extract.main_text("") == "" == html_extract.main_text("<article></article>")
    assert html_extract.main_text("no <b>marks</b> at all") == "no marks at all"
    assert html_extract.main_text("a < b &lt; c") == "a < b < c"
    assert html_extract.main_text("<head><title>x<body><p>late") == "late" or html_extract.main_text("<head><meta a><body><p>late") == "late"
    assert html_extract.main_text("<div>" * 50_000 + "deep") == "deep"
    assert html_extract.main_text("<p>" + "x " * 300_000) == ("x " * 300_000).strip()
    assert html_extract.main_text("<p>cut <b") .startswith("cut")


def test_raw_elements_end_where_they_should():
    assert html_extract.main_text("<p>a <svg class='i' viewBox=\"0 0 > 1\"/> b <svg><title>t</title><path/></svg> c</p>") == "a b c"
    assert html_extract.main_text("<title-bar>x</title-bar><p>a</p><style-guide>b</style-guide><p>c</p>").split("\n\n") == ["x", "a", "b", "c"]
    assert html_extract.main_text("<svg>no</svg><title>no</title ><p>a") == "a"


def test_deep_runs_close_no_ancestor():
    deep = "<div>" * 210 + "deep" + "</div>" * 210
    page = f"<div class=x><article><div><p>one</p>{deep}<p>two</p></div><p>three</p></article></div><p>outside</p>"
    assert html_extract.main_text(page).split("\n\n") == ["one", "deep", "two", "three"]
    unclosed = "<div>" * 195 + "<ul>" + "<li><ul><li><i>x" * 20
    assert html_extract.main_text(f"<article>{unclosed}</article><p>outside").split() == ["x"] * 20


def test_words_in_names_are_hints_only():
    long = "one two three four five six seven eight nine ten " * 8
    text = lambda html: html_extract.main_text(html).split("\n\n")
    assert text(f"<div id='page' class='site has-sidebar'><p>{long}</p></div>") == [long.strip()]
    assert text(f"<div class='sidebar'><article class='post comment-open'><p>{long}</p></article></div>") == [long.strip()]
    assert text(f"<p>{long}</p><div class='related'><article><p><a href=x>teaser</a></p></article></div>") == [long.strip()]
    assert text("<article class='comment'><p>short</p></article>") == ["short"]
    assert text("<div class='widget'>all there is</div>") == ["all there is"]
    body = f"<h2 id='related'>Related</h2><h2 id='related-work'>Work</h2><p class='teaser'>lead</p><section id='navigation'><p>{long}</p></section>"
    assert text(f"<article>{body}<p>a <b class='notice'>b</b> c</p></article>") == ["Related", "Work", "lead", long.strip(), "a b c"]
    links = f"<div class='related'><a href=x>{long}</a></div>"
    comments = f"<section id='comments'><h2>Two</h2><article class='comment'><p>{long}</p></article></section>"
    assert text(f"<article><p>{long}</p>{links}<div class='share'>tell</div>{comments}</article>") == [long.strip()]


def page(k, extra=""):
    body = "".join(f"<p>own text {k} {j} of this page</p>" for j in range(3))
    return f"<body><div class=x><p>Welcome to our site</p></div><article><h1>Title {k}</h1>{body}<p>Read more on our site</p></article>{extra}"


def test_blocks_that_are_the_same_on_a_host_are_template(spark):
    rows = [(k, f"http://a.example/{k}", page(k)) for k in range(12)]
    rows += [(100 + k, f"http://b.example/{k}", page(7)) for k in range(12)]  # copies of one page
    rows += [(200 + k, f"http://c.example/{k}", page(k)) for k in range(3)]  # too few to tell
    table = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, host string")
    got = {r.page_id: r.text.split("\n\n") for r in html_extract.extract(table.repartition(4)).collect()}
    own = lambda k: [f"Title {k}", *[f"own text {k} {j} of this page" for j in range(3)]]
    assert all(got[k] == own(k) for k in range(12))
    assert all(got[100 + k] == [*own(7), "Read more on our site"] for k in range(12))
    assert all(got[200 + k] == [*own(k), "Read more on our site"] for k in range(3))


def test_odd_rows(spark):
    rows = [(1, None, None), (1, None, None), (None, "not a url", "<p>x"), (3, "http://h/", ""), (4, "HTTP://H/2", PAGE)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(str(tuple(r)) for r in html_extract.extract(table).collect())
    texts = ["", "", "x", "", "\n\n".join(WANT)]
    assert got == sorted(str((i, u, t)) for (i, u, _), t in zip(rows, texts))
    assert html_extract.extract(table.limit(0)).count() == 0


def test_query_gives_the_article_of_every_page(spark):
    pages = {r.page_id: r for r in queries.table(spark, SF, "pages").collect()}
    found = queries.op8_html(spark, SF).collect()
    assert len(found) == len(pages)
    for r in found:
        article = re.search(r"<article>(.*?)(</article>|$)", pages[r.page_id].html, re.DOTALL)[1]
        parts = (" ".join(unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)\b[^>]*>", article))
        want = "\n\n".join(p for p in parts if p)
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, want, len(want))


def test_all_articles_of_the_main_part_stay():
    two = "<main><h2>News</h2><article><p>one</p></article><article><p>two two two</p></article></main>"
    assert html_extract.main_text(two).split("\n\n") == ["one", "two two two"]
    comment = "<main><article><p>one</p></article><article class='comment'><p>nice nice nice</p></article></main>"
    assert html_extract.main_text(comment) == "one"


def test_many_blocks_need_no_table():
    body = lambda n, s: "<body><div class=n>notice</div>" + "".join(f"<p>{s} {k}</p>" for k in range(n)) + "<div class=f>foot</div>"
    start = time.monotonic()
    wrapper = html_extract.Wrapper(body(20_000, "a"))
    root = html_extract.parse(body(30_000, "b"))[0]
    html_extract.order(root)
    same = sorted(k for k, equal in wrapper.equal(root) if equal)
    assert [wrapper.nodes[k].own for k in same] == ["notice", "foot"]
    assert time.monotonic() - start < 10
