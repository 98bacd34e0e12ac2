"""Operator 12: the page parser, the tree's importance against plain Python, and odd pages."""

import math
from collections import Counter, defaultdict

import pytest

from anchorage.llm import site_tree
from anchorage.llm.html_blocks import blocks_of


def texts(html):
    return [b.text for b in blocks_of(html)]


@pytest.mark.parametrize("html, want", [
    (None, []), ("", []), (" \n ", []), ("plain  text", ["plain text"]),
    ("<article><h1>T &amp; U</h1><p><b>T<br>x<p>y</p></article><footer>f</footer>", ["T & U", "T x", "y"]),
    ("<nav>menu</nav><p>a<p>b<ul><li>c<li>d</ul>", ["a", "b", "c", "d"]),
    ("<script>var t='<p>no</p>';</script><style>p{}</style><p>a<!-- <p>no</p> --></p>", ["a"]),
    ("<!--> <p>one</p><!-- a --!><p>two</p><!-- open <p>no", ["one", "two"]),
    ('<p title="<nav>">a</p><p data-x=\'>\'>b</p><a href="/x>y">c</a>', ["a", "b", "c"]),
    ("1 < 2 and 3>2 <3 </ bogus> end", ["1 < 2 and 3>2 <3 end"]),
    ("<div class='sidebar'>no</div><div class='x'>yes</div><div id='cookieNotice'>no</div>", ["yes"]),
    ("<div class='layout sidebar-right'><article>yes</article><div>out</div></div>", ["yes"]),
    ("<header>site</header><article><header><h1>title</h1></header>body<footer>tags</footer></article>", ["title", "body"]),
    ("<main>a<section id=comments><article class=comment>no</article></section>b</main>", ["a", "b"]),
    ("<section class=comments><article class=comment>no</article></section><p>yes", ["yes"]),
    ("<form action=x><main>yes<button>no</button></main></form><form>no</form>", ["yes"]),
    ("<article>a <span class=ad>no</span> b<i>c</i>d</article>", ["a", "bcd"]),
    ("<article>cut in a <b", ["cut in a"]), ("<article>cut in &am", ["cut in &am"]), ("<article>x &amp", ["x &"]),
    ("<p hidden>no</p><p>a&nbsp;&#98;&#x63;</p>", ["a bc"]),
    ("<table><tr><td>a<td>b<tr><td><p>c</table>d", ["a", "b", "c", "d"]),
    ("<div role=main>yes</div><div>no</div>", ["yes"]),
    ("<textarea><p>no</textarea><p>a</P></p></div>b", ["a", "b"]),
    ("<article>" + "<div>" * 3000 + "deep", ["deep"]),
    ("<p>" + "w " * 100_000, [("w " * 100_000).strip()])])
def test_blocks(html, want):
    assert texts(html) == want


def test_nodes_merge_pages():
    a, b = ([x.path for x in blocks_of(h)] for h in ("<div class='post-12 b'><p>x<p>y</div>", "<div class='b post-7'><p>z</div><div>w"))
    assert a[0] == a[1] == b[0] != b[1]


def site(n, host="h.example", first=0):
    """Pages with a line on every page, one on half of them, and texts of their own."""
    rows = []
    for k in range(n):
        html = (f"<div class=top>Welcome to the site</div><div class=body><p>Common line</p><p>Own text {host} {k}</p><p>More {host} {k}</p></div>"
                f"<div class=x{'a' if k % 2 else 'b'}>Share this</div><div class=tail><b>Imprint</b></div>")
        rows.append((first + k, f"https://user@{host.upper()}:80/p{k}", html, "x", 1))
    return rows


COLUMNS = "page_id long, url string, html string, text string, host int"


def brute_importance(rows, gamma=site_tree.GAMMA):
    pages, features, styles = Counter(), defaultdict(Counter), defaultdict(Counter)
    for _, url, html, *_ in rows:
        blocks = blocks_of(html)
        for path in {b.path for b in blocks}:
            pages[path] += 1
        for path, text in {(b.path, b.text) for b in blocks}:
            features[path][text] += 1
        for path, style in {(b.path, b.style) for b in blocks}:
            styles[path][style] += 1
    out = {}
    for path, m in pages.items():
        if m == 1:
            out[path] = 1.0
            continue
        total = sum(styles[path].values())
        presentation = -sum(n / total * math.log(n / total) for n in styles[path].values()) / math.log(m)
        content = 1 - sum(math.log(n) / math.log(m) for n in features[path].values()) / len(features[path])
        weight = gamma ** len(styles[path])
        out[path] = (1 - weight) * presentation + weight * content
    return out


def test_importance_equals_plain_entropies(spark):
    rows = site(12)
    got = site_tree.node_importance(site_tree.parsed_pages(spark.createDataFrame(rows, COLUMNS))).collect()
    want = brute_importance(rows)
    assert {r.path: pytest.approx(r.importance, abs=1e-12) for r in got} == want


@pytest.mark.parametrize("held", [site_tree.HELD, 0])
def test_repeated_branches_go_repeated_lines_stay(spark, held):
    rows = site(20) + site(3, "small.example", 100)
    docs = spark.createDataFrame(rows, COLUMNS)
    got = {r.page_id: r.text for r in site_tree.main_texts(docs, held=held).collect()}
    for k in range(20):
        assert got[k] == f"Common line\nOwn text h.example {k}\nMore h.example {k}"
    for k in range(3):  # too few pages to judge
        assert got[100 + k] == f"Welcome to the site\nCommon line\nOwn text small.example {k}\nMore small.example {k}\nShare this\nImprint"


@pytest.mark.parametrize("held", [site_tree.HELD, 0])
def test_copies_nulls_repeats_and_empty(spark, held):
    same = "<div><h1>Title</h1><p>Body of a copied page.</p></div>"
    rows = [(k, f"https://c.example/{k}", same, "x", 1) for k in range(30)]
    rows += [(None, None, None, None, None), (None, "no host", same, None, 1), (40, "https://c.example/40", "", "x", 1), rows[0]]
    docs = spark.createDataFrame(rows, COLUMNS)
    got = site_tree.main_texts(docs, held=held).collect()
    assert len(got) == len(rows)
    for r in got:
        want = "" if (r.page_id, r.url) in ((None, None), (40, "https://c.example/40")) else "Title\nBody of a copied page."
        assert r.text == want and r.n_chars == len(want)
    assert site_tree.main_texts(docs.limit(0), held=held).collect() == []


def test_query_on_the_small_table(spark):
    import html as references
    import re

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    got = {r.page_id: r.text for r in site_tree.op12_site_style_tree(spark, "/root/testdata/sf0.001").collect()}
    for p in pages:
        body = re.search("(?s)<article>(.*?)</article>", p.html)[1].replace("<br>", " ")
        parts = (" ".join(references.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:h1|p)>", body))
        assert got[p.page_id] == "\n".join(filter(None, parts))
