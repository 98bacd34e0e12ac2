"""Golden cases carried over from the reference's unit tests (FIXTURES.md §2)."""

from pyspark.sql import functions as F

from anchorage.functions import urls as U

from anchorage.functions.text import clean_text, csv_escape, decode_entities, slug
from anchorage.operators.entries import explode_entries, link_entries
from anchorage.operators.filters import compile_filter, format_label_list
from anchorage.operators.report import settings_summary
from anchorage.plans.visible import visible_links, visible_pages
from anchorage.settings import Settings
from anchorage.sources.pages import from_snapshots, scan_html

SNAP = ("page_id bigint, pageUrl string, title string, "
        "links array<struct<domIndex:bigint,rawHref:string,resolvedHref:string,href:string,text:string>>")


def one(spark, col, value, typ="string"):
    return spark.createDataFrame([(value,)], f"x {typ}").select(col.alias("y")).first()[0]


def test_clean_text(spark):
    assert one(spark, clean_text("x"), "  Hello\n\tworld   again  ") == "Hello world again"
    assert one(spark, clean_text("x"), "a 　b﻿") == "a b"


def test_resolve_href(spark):
    cases = [
        ("magnet:?xt=urn:btih:abc123", "https://example.com", "magnet:?xt=urn:btih:abc123"),
        ("mailto:user@example.com", "https://example.com", "mailto:user@example.com"),
        ("ftp://files.example.com/doc.pdf", "https://example.com", "ftp://files.example.com/doc.pdf"),
        ("tel:+15551234567", "https://example.com", "tel:+15551234567"),
        ("javascript:void(0)", "https://example.com", None),
        ("data:text/html,hello", "https://example.com", None),
        ("about:blank", "https://example.com", None),
        ("", "https://example.com", None),
        ("/relative", "not-a-valid-base", None),
        ("https://c.com", "https://example.com", "https://c.com/"),
        ("../a/./b/../c", "http://h/x/y/z", "http://h/x/a/c"),
        ("//Other.COM:80/p", "http://h/", "http://other.com/p"),
        ("http://0x7f.1/", "http://h/", "http://127.0.0.1/"),
        ("http://[invalid", "https://example.com/", None),
        ("/für", "http://a.example/x", "http://a.example/f%C3%BCr"),
    ]
    df = spark.createDataFrame(cases, "h string, b string, e string")
    got = df.select("e", U.resolve_href("h", "b").alias("g")).collect()
    assert [r.g for r in got] == [r.e for r in got]


def test_decoding(spark):
    df = spark.createDataFrame([("https://example.com/path%20with%20spaces?q=hello%26world",),
                                ("https://example.com/%E0%A4%A",)], "u string")
    got = [r[0] for r in df.select(U.decode_uri("u")).collect()]
    assert got == ["https://example.com/path with spaces?q=hello%26world", "https://example.com/%E0%A4%A"]


def test_redirect_targets(spark):
    cases = [
        ("https://example.com/redirect?url=https%3A%2F%2Ftarget.example%2Fpage#next=https://target.example/page",
         ["https://target.example/page"]),
        ("not-a-valid-url", []),
        ("https://example.com/redirect?url=javascript:void(0)", []),
        ("https://example.com/redirect?target=%2Fdocs%2Fguide&url=https%3A%2F%2Fexample.com%2Fredirect%3Ftarget%3Dsame",
         ["https://example.com/docs/guide", "https://example.com/redirect?target=same"]),
        ("https://example.com/redirect?url=%E0%A4%A&next=%",
         ["https://example.com/%EF%BF%BD%A", "https://example.com/%"]),
        ("https://example.com/redirect?url=http://[invalid", []),
    ]
    snaps = spark.createDataFrame(
        [(k, "https://example.com/", [(u,)]) for k, (u, _) in enumerate(cases)],
        "page_id long, pageUrl string, links array<struct<href:string>>")
    found = {r.page_id: [e.display_url for e in r.entries if e.surfaced] for r in link_entries(from_snapshots(snaps)).collect()}
    assert [found[k] for k in range(len(cases))] == [targets for _, targets in cases]


def _snap_entries(spark, rows, title=""):
    snap = spark.createDataFrame(
        [(1, "https://example.com", title, [dict(domIndex=i, rawHref=None, resolvedHref=h, href=None, text=t)
                                            for i, (h, t) in enumerate(rows)])], SNAP)
    return link_entries(from_snapshots(snap))


def _lines(spark, ents, **kw):
    s = Settings.merge(kw)
    return [r.url for r in visible_links(spark, ents, s).orderBy("rank").collect()]


def test_order_and_filters(spark):
    ents = _snap_entries(spark, [("https://c.com", "C"), ("https://a.com", "A"), ("https://b.com", "B")])
    assert _lines(spark, ents, sortMode="original") == ["https://c.com/", "https://a.com/", "https://b.com/"]
    assert _lines(spark, ents, sortMode="alphabetical") == ["https://a.com/", "https://b.com/", "https://c.com/"]
    gh = _snap_entries(spark, [("https://github.com/repo", "Repo"), ("https://github.com/issues", "Issues"),
                               ("https://example.com", "Example")])
    assert _lines(spark, gh, urlIncludePattern="github", urlExcludePattern="issues") == ["https://github.com/repo"]
    shop = _snap_entries(spark, [("https://shop.example.com/product/123", "Product"),
                                 ("https://shop.example.com/dp/456", "DP"),
                                 ("https://shop.example.com/help", "Help")])
    assert _lines(spark, shop, urlIncludePattern="product, dp") == [
        "https://shop.example.com/product/123", "https://shop.example.com/dp/456"]
    assert _lines(spark, shop, urlIncludePattern=", ,") == [
        "https://shop.example.com/product/123", "https://shop.example.com/dp/456",
        "https://shop.example.com/help"]
    commas = _snap_entries(spark, [("https://example.com/affiliate/path", "Affiliate"),
                                   ("https://example.com/path,with,comma", "Comma Path")])
    assert _lines(spark, commas, useRegex=True, urlIncludePattern="affiliate, path") == []


def test_snapshot_defaults(spark):
    snap = spark.createDataFrame(
        [(1, None, None, [dict(domIndex=None, rawHref=None, resolvedHref=None, href="/valid", text="Valid"),
                          dict(domIndex=None, rawHref=None, resolvedHref=None, href="javascript:void(0)",
                               text="Skipped")])],
        SNAP).withColumn("url", F.lit("https://fallback.example/base"))
    rows = explode_entries(link_entries(from_snapshots(snap))).collect()
    assert [(r.page_url, r.display_url, r.dom_index, r.variant_index, r.surfaced) for r in rows] == [
        ("https://fallback.example/base", "https://fallback.example/valid", 0, 0, False)]
    empty = spark.createDataFrame([(2, None, None, None)], SNAP)
    out = link_entries(from_snapshots(empty)).first()
    assert out.page_url == "https://example.invalid/" and list(out.entries) == []


def test_html_scan(spark):
    html = ('<html><head><title> My  &amp; Title </title><base href="https://base.example/dir/">'
            '<script>var a = "<a href=/no>x</a>";</script></head><body>'
            '<a href="docs">Docs <b>here</b></a><!-- <a href="/hidden">h</a> -->'
            "<A HREF='/Up?x=1&amp;url=%2Ftarget'>Up</A><a name=x>no href</a>"
            '<a href="java&#x09;script:alert(1)">js</a><a href="">self</a></body></html>')
    pages = spark.createDataFrame([(7, "https://page.example/p", html)], "page_id bigint, url string, html string")
    ents = link_entries(scan_html(pages))
    row = ents.first()
    assert row.title == "My & Title"
    assert row.page_url == "https://base.example/dir/"
    got = [(e.dom_index, e.variant_index, e.display_url, e.text) for e in row.entries]
    assert got == [
        (0, 0, "https://base.example/dir/docs", "Docs here"),
        (1, 0, "https://base.example/Up?x=1&url=%2Ftarget", "Up"),
        (1, 1, "https://base.example/target", "Up"),
        (3, 0, "https://base.example/dir/", "self"),
    ]


def test_dedup_csv_hints(spark):
    ents = _snap_entries(spark, [("https://example.com/a", "First A"), ("https://example.com/a", "Second A"),
                                 ("https://example.com/b", "B")])
    assert _lines(spark, ents) == ["https://example.com/a", "https://example.com/b"]
    s = Settings.merge({"useRegex": True, "urlIncludePattern": "[", "textIncludePattern": "Gamma"})
    assert compile_filter(spark, s).errors == ("URL include regex is invalid.",)
    page = visible_pages(spark, ents, s).first()
    assert page.hint == "No links matched the active filters: Text include. Try Reset Filters."
    assert page.message == "URL include regex is invalid."
    assert format_label_list(["URL include", "URL exclude", "Text include"]) == \
        "URL include, URL exclude, and Text include"
    esc = spark.createDataFrame([('A "quoted", title\nwith newline',), (None,)], "x string")
    assert [r[0] for r in esc.select(csv_escape("x")).collect()] == [
        '"A ""quoted"", title\nwith newline"', ""]


def test_entities_and_slug(spark):
    assert one(spark, decode_entities("x"), "a &amp;lt; &#x41;&#66;&eacute;&bogus;") == "a &lt; ABé&bogus;"
    assert one(spark, slug("x", 20), "  Wikipedia The Free Encyclopedia ") == "wikipedia-the-free-e"


def test_settings():
    s = Settings.merge({"sortMode": "unexpected-mode", "themeMode": "neon", "useRegex": 1, "decodeUrls": "yes"})
    assert (s.sort_mode, s.theme_mode, s.use_regex, s.decode_urls) == ("original", "system", True, True)
    assert Settings.merge({"decodeUrls": "false"}).decode_urls is True
    r = Settings.merge({"sortMode": "alphabetical", "urlIncludePattern": "x", "useRegex": True}).reset_filters()
    assert (r.sort_mode, r.url_include, r.use_regex) == ("alphabetical", "", False)
    assert settings_summary(Settings()) == "Original page order • no active filters • regex off • URL decoding off"


def test_saved_html_files(spark, tmp_path):
    from anchorage.sources.pages import read_html_files
    (tmp_path / "a.html").write_text('<title>Saved</title><a href="b.html">B</a><a href="https://x.example">X</a>')
    pages = read_html_files(spark, str(tmp_path / "*.html"))
    row = link_entries(scan_html(pages)).first()
    assert row.title == "Saved" and row.page_url.startswith("file:")
    assert [e.display_url for e in row.entries] == [row.page_url.rsplit("/", 1)[0] + "/b.html", "https://x.example/"]
    rep = visible_pages(spark, link_entries(scan_html(pages)), Settings()).first()
    assert rep.is_local_file and rep.lines == 2


def test_entry_smoke(spark):
    import __spark_entry__ as m
    df = m.entry(spark)
    assert df.count() > 0
    assert set(m.QUERIES) <= set(m.queries()) and set(m.QUERIES) <= set(m.oracle_sql())


def test_ipv6_hosts(spark):
    cases = [("http://[0:0:0:0:0:0:0:1]/x", "http://[::1]/x"),
             ("http://[2001:DB8:0:0:1:0:0:1]/", "http://[2001:db8::1:0:0:1]/"),
             ("http://[::ffff:1.2.3.4]/", "http://[::ffff:102:304]/"),
             ("http://[1:0:0:2:0:0:0:3]/", "http://[1:0:0:2::3]/"),
             ("http://[1::2::3]/", None), ("http://[g::1]/", None),
             ("http://[::]/", "http://[::]/"), ("http://[1::]/", "http://[1::]/"), ("http://[0:0:1:0:0:0:0:0]:80/", "http://[0:0:1::]/"),
             ("http://[1:2:3:4:5:6:7:8]:8080/", "http://[1:2:3:4:5:6:7:8]:8080/"), ("http://[1:2:3:4:5:6:7::]/", "http://[1:2:3:4:5:6:7:0]/"),
             ("http://[1:2:3:4:5:6:7:8::]/", None), ("http://[1:2:3]/", None), ("http://[:1::]/", None), ("http://[00001::]/", None),
             ("http://[1:0:3:0:5:0:7:0]/", "http://[1:0:3:0:5:0:7:0]/"), ("http://[::1.2.3.256]/", None)]
    df = spark.createDataFrame(cases, "h string, e string")
    got = [r.g for r in df.select(U.resolve("h").alias("g")).collect()]
    assert got == [e for _, e in cases]


def test_idna_hosts(spark):
    cases = [("https://München.example/Straße?x", "https://xn--mnchen-3ya.example/Stra%C3%9Fe?x"),
             ("http://例え.テスト/", "http://xn--r8jz45g.xn--zckzah/"), ("http://plain.example/", "http://plain.example/"),
             ("http://a..é/", None), ("http://I❤.ws/", "http://xn--i-7iq.ws/")]
    df = spark.createDataFrame(cases, "h string, e string")
    got = [r.g for r in df.select(U.resolve("h").alias("g")).collect()]
    assert got == [e for _, e in cases]
