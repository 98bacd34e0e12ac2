"""Odd inputs must never fail a job (ANSI mode is on in Spark 4)."""

import random

from anchorage.operators.entries import explode_entries, link_entries
from anchorage.sources.pages import from_snapshots, scan_html

PIECES = ["http:", "https://", "//", "/", "\\", "..", ".", "%", "%2e", "%E0%A4", "?", "#", "&", "=",
          "url=", "next=", "to=", "@", ":", "[", "]", "::1", "0x", "0", "99999999999999999999999999999999999999999",
          "é", "ß", "漢", " ", "\t", "javascript:", "mailto:", "file:", "a", "B", "1", "+", "&amp;", "&#0;",
          "&#x110000;", "&bogus;", "<", ">", '"', "'", "xn--", "localhost", "255.255.255.255", "1.2.3.4.5"]


def _random_hrefs(n, seed=7):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 8))) for _ in range(n)]


def test_random_snapshot_hrefs(spark):
    hrefs = _random_hrefs(400)
    links = [dict(domIndex=None, rawHref=h, resolvedHref=None, href=None, text=h) for h in hrefs]
    snap = spark.createDataFrame(
        [(1, "https://example.com/a/b?c#d", "", links)],
        "page_id bigint, pageUrl string, title string, "
        "links array<struct<domIndex:bigint,rawHref:string,resolvedHref:string,href:string,text:string>>")
    rows = explode_entries(link_entries(from_snapshots(snap))).collect()
    assert all(r.display_url for r in rows)


def test_random_html(spark):
    hrefs = _random_hrefs(200, seed=11)
    html = "<title>&amp;x</title>" + "".join(f'<a href="{h.replace(chr(34), "")}">{h}</a><a>{h}' for h in hrefs)
    pages = spark.createDataFrame([(1, "https://example.com/", html), (2, "not a url", html), (3, None, None)],
                                  "page_id bigint, url string, html string")
    out = link_entries(scan_html(pages)).collect()
    assert len(out) == 3
