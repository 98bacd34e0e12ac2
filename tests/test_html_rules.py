"""Odd markup, hosts and bases: nothing ends the job, and the rules are a browser's."""

import pytest

from anchorage.functions import urls as U
from anchorage.functions.text import decode_entities
from anchorage.operators.entries import explode_entries, link_entries
from anchorage.sources.pages import from_snapshots, scan_html


def scan(spark, html, url="https://example.com/dir/page"):
    pages = spark.createDataFrame([(1, url, html)], "page_id long, url string, html string")
    return scan_html(pages).first()


def test_long_start_tags_and_unclosed_quotes(spark):
    attributes = " ".join(f"data-{k}='{k}'" for k in range(80_000))
    row = scan(spark, f"<a {attributes} href=/x>long</a><base {attributes}><a href=/y>after</a><a title=\"open href=/z>")
    assert [(x.href, x.text) for x in row.links] == [("/x", "long"), ("/y", "after")]
    for html in ("<a href='" + "x" * 1_000_000, "<a " + "b" * 1_000_000 + " href=/q>t</a>", "<" * 200_000, "<a>" * 20_000):
        assert scan(spark, html) is not None


@pytest.mark.parametrize("html, want", [
    ('<a href="/1" title="<!-- x">one</a><a href="/2">two</a>', [("/1", "one"), ("/2", "two")]),
    ('<a href="/1" data-t="<script>">one</a><a href="/2">two</a>', [("/1", "one"), ("/2", "two")]),
    ('<p title="<a href=/no>z</a>">q</p><a href=/y>y</a>', [("/y", "y")]),
    ("<!--> <a href=\"/1\">one</a><!-- a --!><a href=\"/2\">two</a>", [("/1", "one"), ("/2", "two")]),
    ("<!---><a href=/1>one</a><!-- <a href=/no>no</a>", [("/1", "one")]),
    ('<a href=/1>o<img alt="x > y">ne</a>', [("/1", "one")]),
    ("<a href=/1>1<2 and 3>2</a>", [("/1", "1<2 and 3>2")]),
    ("<a href=/1>a<script>if (1<2 && x) '<a href=/no>'</script>b</a>", [("/1", "aif (1<2 && x) '<a href=/no>'b")]),
    ("<a href=/1>x<style>p&amp;</style><textarea>&lt;<b></textarea><template><a href=/no></template></a>", [("/1", "xp&amp;<<b>")]),
    ("<a href=/q?a=\"1>open</a> <p title=\"x\"><a href='/2'>two</a>", [('/q?a="1', "open"), ("/2", "two")]),
    ("<a title\"x href=/1>one</a>", [("/1", "one")]), ("<a title = '>' href = /1 >one</a >", [("/1", "one")]),
    ("<a href=/1>&am<b>p;</b>&amp;</a>", [("/1", "&amp;&")]),
    ("<a href=/1>one<a href=/2>two</A\n>out<abbr href=/no>x</abbr>", [("/1", "one"), ("/2", "two")]),
    ("</ x><a href=/1>a</>b<!x>c<?y>d</a><![CDATA[ <a href=/2>e]]>f</a>", [("/1", "abcd")]),
    ("<a href=/1>\ufdd0\ufdd1x\ufdd4\ufdd42</a><a href='\ufdd2'>y", [("/1", "\ufdd0\ufdd1x\ufdd4\ufdd42"), ("\ufdd2", "y")]),
    ("<a href=/1>cut</a><a href='/2'>in <b title='x", [("/1", "cut"), ("/2", "in")]), ("<a/href=/1/>x", [("/1/", "x")]),
    ("<A HREF>none</A><a href=>x</a><a name=y>z</a>", [("", "none"), ("", "x")])])
def test_markup_is_read_from_left_to_right(spark, html, want):
    assert [(x.href, x.text) for x in scan(spark, html).links] == want


def test_title_and_base_in_odd_places(spark):
    row = scan(spark, "<p title='<title>no</title><base href=/no/>'><!-- --!><TITLE>a&am<b>p</title ><BASE target=x><base href='/no/'>")
    assert row.title == "a&am<b>p" and row.base_href is None
    assert scan(spark, "<div data-x='<base href=/no>'><base href=/yes/ id=1>").base_href == "/yes/"
    assert scan(spark, "<title>open \n to the end<a href=/no>").title == "open to the end<a href=/no>"


def test_title_of_the_document(spark):
    assert scan(spark, "<!-- <title>no</title> --><script>'<title>no</title>'</script><TITLE >a <!-- b &amp; c</TITLE><title>d</title>").title \
        == "a <!-- b & c"
    assert scan(spark, "<textarea><title>no</title></textarea><a href=/x>y</a>").title == ""
    assert [x.href for x in scan(spark, "<title><a href=/no>no</a></title><a href=/x>y</a>").links] == ["/x"]


def test_character_references(spark):
    cases = [("&#0000000065;&#x0041;&#65", "AAA"), ("&#146;&#x80;&#129;", "’€\x81"), ("&#0;&#xD800;&#1114112;&#99999999999;", "����"),
             ("a&nbspb &ampamp; &AMPT", "a\xa0b &amp; &T"), ("&notit; &notin; &nosuch; &", "¬it; ∉ &nosuch; &"), ("&lt;&LT&gt=", "<<>="),
             ("&amp;lt;", "&lt;")]
    df = spark.createDataFrame(cases, "t string, e string")
    assert [r.g for r in df.select(decode_entities("t").alias("g")).collect()] == [e for _, e in cases]
    row = scan(spark, "<a href='/?a=1&copy=2&amp=3&lt&gt;&notit&#38;x'>&copy=2</a>")
    assert [(x.href, x.text) for x in row.links] == [("/?a=1&copy=2&amp=3<>&notit&x", "©=2")]


def test_hosts_beyond_ascii(spark):
    import random
    import unicodedata

    from anchorage.functions.idna import domain_to_ascii_sql, mapped

    rnd = random.Random(4)
    letters = "abcxyz019-äöüßéñçœøåαβγδσςжщю中文字日本ひらがなابÄÖÜΣŐﬁⅧ½ａ"
    hosts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 40))) for _ in range(150)] + ["ü" * 70, "a\xadb", "😀", "e\u0301x", "ㅎ", "\u1112\u1161\u11ab"]
    want = [unicodedata.normalize("NFC", "".join(mapped(c) if ord(c) > 127 else c.lower() for c in h)) for h in hosts]
    want = [w if w.isascii() else "xn--" + w.encode("punycode").decode() for w in want]
    got = spark.createDataFrame([*enumerate(hosts)], "k int, d string").selectExpr("k", f"{domain_to_ascii_sql('d')} AS g").collect()
    assert [r.g for r in sorted(got, key=lambda r: r.k)] == want
    cases = [("http://straße.example/", "http://xn--strae-oqa.example/"), ("http://Fa%C3%9F.DE/", "http://xn--fa-hia.de/"),
             ("http://βόλος.com/", "http://xn--nxasmm1c.com/"), ("http://" + "é" * 70 + ".x/", "http://xn--" + ("é" * 70).encode("punycode").decode() + ".x/"),
             ("http://日本。jp/", "http://xn--wgv71a.jp/"), ("http://a\u202eb/", None), ("http://\u0301a/", None), ("http://ａ.b/", "http://a.b/"),
             ("http://\ufffd/", None), ("http://STRASSE.example/", "http://strasse.example/"), ("http://ẞ.x/", "http://xn--zca.x/")]
    df = spark.createDataFrame(cases, "h string, e string")
    assert [r.g for r in df.select(U.resolve("h").alias("g")).collect()] == [e for _, e in cases]


def test_hosts_that_are_numbers(spark):
    cases = [("http://0xfffffffffffffffffffffff/", None), ("http://0x" + "0" * 40 + "7f.1/", "http://127.0.0.1/"),
             ("http://0" + "7" * 40 + "/", None), ("http://0" + "0" * 40 + "17/", "http://0.0.0.15/"),
             ("http://" + "9" * 60 + "/", None), ("http://4294967295/", "http://255.255.255.255/"), ("http://0xffffffff/", "http://255.255.255.255/"),
             ("http://037777777777/", "http://255.255.255.255/"), ("http://1.0x/", "http://1.0.0.0/"), ("http://08/", None)]
    df = spark.createDataFrame(cases, "h string, e string")
    assert [r.g for r in df.select(U.resolve("h").alias("g")).collect()] == [e for _, e in cases]


def test_drive_letters_of_file_urls(spark):
    cases = [("../../x", "file:///C:/a/b.html", "file:///C:/x"), ("/x", "file:///C:/a/b.html", "file:///C:/x"),
             ("D|/y", "file:///C:/a", "file:///D:/y"), ("/D:/y", "file:///C:/a", "file:///D:/y"), ("x", "file:///home/a", "file:///home/x"),
             ("/x", "file:///home/a", "file:///x"), ("../..", "file:///home/a/b", "file:///")]
    df = spark.createDataFrame(cases, "h string, b string, e string")
    assert [r.g for r in df.select(U.resolve("h", "b").alias("g")).collect()] == [e for *_, e in cases]


def test_without_a_valid_base_nothing_resolves(spark):
    df = spark.createDataFrame([("https://a.com", "not-a-valid-base"), ("/x", None), ("https://a.com", "https://b.com")], "h string, b string")
    assert [r.g for r in df.select(U.resolve_href("h", "b").alias("g")).collect()] == [None, None, "https://a.com/"]
    assert [r.g for r in df.select(U.resolve("h", "b").alias("g")).collect()] == [None, None, "https://a.com/"]
    snaps = spark.createDataFrame([(1, "https://example.com", [("/x",)]), (2, "nonsense", [("https://a.com/",)])],
                                  "page_id long, pageUrl string, links array<struct<href:string>>")
    got = {r.page_id: (r.page_url, [e.display_url for e in r.entries]) for r in link_entries(from_snapshots(snaps)).collect()}
    assert got == {1: ("https://example.com", ["https://example.com/x"]), 2: ("nonsense", [])}


def test_pages_that_share_an_id_or_have_none_stay_apart(spark):
    rows = [(7, "https://a.example/", "<title>a</title><a href=1>x</a><a href=2>y</a>"), (7, "https://b.example/", "<a href=3>z</a><a href=4>z</a>"),
            (None, "https://c.example/", "<a href=5>z</a>"), (None, "https://d.example/", None), (7, "https://a.example/", "<title>a</title>")]
    pages = link_entries(scan_html(spark.createDataFrame(rows, "page_id long, url string, html string")))
    assert pages.count() == 5
    got = sorted((r.page_id or 0, r.display_url) for r in explode_entries(pages).collect())
    assert got == [(0, "https://c.example/5"), (7, "https://a.example/1"), (7, "https://a.example/2"), (7, "https://b.example/3"), (7, "https://b.example/4")]


def test_parsing_leaves_no_views(spark):
    before = spark.catalog.listTables()
    link_entries(scan_html(spark.createDataFrame([(1, "https://a.example/", "<a href=1>x</a>")], "page_id long, url string, html string"))).collect()
    assert spark.catalog.listTables() == before


@pytest.mark.parametrize("pattern, yes, no", [
    ("a{", ["xa{"], ["a"]), ("a{2}", ["aa"], ["a{2}"]), ("a{,2}", ["a{,2}"], ["aa"]), ("[[]", ["["], ["a"]), ("[a&&b]", ["&", "b"], ["c"]),
    ("[]", [], ["", "a"]), ("x[^]y", ["x\ny"], ["xy"]), (r"a\sb", ["a\xa0b", "a\ufeffb"], ["ab"]), ("a.b", ["a\x85b"], ["a\nb", "a\u2028b"]),
    ("b$", ["ab"], ["ab\n"]), (r"\bé", ["aé"], ["é"]), ("]}", ["]}"], ["]"]), (r"\p{L}", ["p{L}"], ["a"]), (r"(a)\1", ["AA"], ["ab"]),
    (r"(?<y_1>a)\k<y_1>", ["aa"], ["a"]), (r"[\w-x]", ["-", "q"], [" "]), (r"\x41\u0042", ["ab"], ["x"]), ("É", ["é"], ["e"]), (r"[\b]", ["\b"], ["b"]),
    (r"a+?b|c", ["aab", "c"], ["a"]), ("(?=a)*b", ["b"], ["a"]), (r"[^\S]", ["\u2003"], ["a"]), (r"\.com/$", ["x.COM/"], ["xcom/"]), ("(?i:a)", ["A"], ["b"]),
    ("(?<!x)a", ["a"], ["xa"]), ("(?<=a+)b", ["aab"], ["b"]), ("(?<!/x*)y", ["ay"], ["/xxy", "/y"]), ("(?<=^.{2,})z", ["abcz"], ["az"]), (r"\01", ["\x01"], ["1"])])
def test_regex_dialect(spark, pattern, yes, no):
    from anchorage.functions.jsregex import to_java
    from anchorage.functions.sql import lit
    rows = spark.createDataFrame([(v, True) for v in yes] + [(v, False) for v in no], "v string, e boolean")
    got = rows.selectExpr("v", "e", f"v RLIKE {lit(to_java(pattern))} AS g").collect()
    assert [(r.v, r.g) for r in got] == [(r.v, r.e) for r in got]


@pytest.mark.parametrize("pattern", ["[", "(", ")", "a++", "a**", "(?i)a", "*", "a{2}{3}", "a{3,2}", "[b-a]", "\\", "(?<a>x)(?<a>y)", "(?<1>x)", "{1}", "(?<=a)*", "(?>a)"])
def test_patterns_that_the_constructor_rejects(pattern):
    from anchorage.operators.filters import regex_is_valid
    assert not regex_is_valid(pattern)


def test_a_pattern_that_java_cannot_hold_is_one_profiles_error(spark):
    from anchorage.operators.filters import regex_is_valid
    from anchorage.plans.visible import _java_patterns

    assert not regex_is_valid("(?<=(a+)*)b")
    rows = spark.createDataFrame([(0, "(?<=(a+)*)b"), (1, "x+"), (2, "(")], "k int, p string")
    assert [r.j for r in rows.select("k", _java_patterns("p").alias("j")).orderBy("k").collect()] == [None, "(?iu)x+", None]
