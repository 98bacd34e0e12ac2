"""Page sources (S1-S5): pages table / saved HTML / snapshots -> link arrays.

Every source yields one row per page with

    page_id bigint, page_url string, title string,
    links array<struct<dom_index:bigint, href:string, text:string>>

(HTML scans add ``base_href``, the document's ``<base href>`` if any)
plus ``scanned`` (True when ``href`` is the attribute text of an HTML
scan, resolved by the entry builder like ``anchor.href``; False for
snapshot values).  Nothing here shuffles: one input
row (one page) becomes one output row.
"""

from __future__ import annotations

import codecs
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from anchorage.functions.sql import case, col, lam, let, lit, struct
from anchorage.functions.text import clean_text_sql, collapse_ascii_ws_sql, decode_entities_sql, entity_table_sql

LINK_TYPE = "array<struct<dom_index:bigint,href:string,text:string>>"
DEFAULT_PAGE_URL = "https://example.invalid/"

# --- markup, read from left to right as one row of tokens ---------------------------
# Everything is possessive: walked without recursion, however long a token is.

# attributes: a quote opens a value only right after "="; an unquoted value runs to white space or ">"
_ATTRS = r"""(?:[^=>]++|=\s*+(?:"[^"]*+(?:"|\z)|'[^']*+(?:'|\z)|[^\s"'>][^\s>]*+)?+)*+"""
# elements whose content is text to the parser; that of a template is no text of the document either
_RAW = "script|style|textarea|title|noscript|iframe|xmp|noembed|noframes|template"
_RAW_ELEMENT = rf"<({_RAW})(?=[\s/>]){_ATTRS}>.*?(?:</\1(?=[\s/>])[^>]*+>|\z)"
# text | comment | declaration | raw-text element | tag | tag that never ends | a lone "<"
_TOKEN = (rf"(?is)[^<]++|<!--(?:-?>|.*?(?:--!?>|\z))|<(?:[!?]|/(?![a-z]))[^>]*+(?:>|\z)|{_RAW_ELEMENT}"
          rf"|</?[a-z][^\s/>]*+{_ATTRS}>|</?[a-z].*\z|<")
_RAW_CONTENT = rf"(?is)^<(?:{_RAW})(?=[\s/>]){_ATTRS}>(.*?)(?:</(?:{_RAW})(?=[\s/>])[^>]*+>)?+\z"
_ATTR = r"""(?s)([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]*+))?"""
_UNQUOTE = r"""(?s)^"(.*)"$|^'(.*)'$"""

# Marks between the tokens that are kept: an anchor's start, the end of its start tag, its end, and the place of any
# other tag (a reference does not go on behind it).  Four noncharacters; where a page has them, a fifth one shields them.
_OPEN, _MID, _CLOSE, _GAP, _SHIELD = (chr(0xFDD0 + k) for k in range(5))
_ANCHOR = f"{_OPEN}[^{_MID}]*+{_MID}[^{_OPEN}{_CLOSE}]*+"


def _shield_sql(x: str) -> str:
    out = x
    for k, mark in enumerate((_SHIELD, _OPEN, _MID, _CLOSE, _GAP)):
        out = f"replace({out}, {lit(mark)}, {lit(_SHIELD + str(k))})"
    return f"CASE WHEN {x} RLIKE {lit(f'[{_OPEN}-{_SHIELD}]')} THEN {out} ELSE {x} END"


def _unshield_sql(x: str) -> str:
    def body(v):
        out = v
        for k, mark in reversed([*enumerate((_SHIELD, _OPEN, _MID, _CLOSE, _GAP))]):
            out = f"replace({out}, {lit(_SHIELD + str(k))}, {lit(mark)})"
        return f"CASE WHEN contains({v}, {lit(_SHIELD)}) THEN {out} ELSE {v} END"
    return let(x, body)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """The pages table (page_id, url, html)."""
    return spark.read.parquet(path)


_META_CHARSET = re.compile(rb"""<meta[^>]*?charset\s*=\s*["']?\s*([^\s"'/>;]+)""", re.I)
_COMMENT = re.compile(rb"<!--.*?(?:-->|\Z)", re.S)
_PRESCAN = 1024  # bytes in which a declaration counts


def charset_of(data: bytes) -> tuple[str, int]:
    """Encoding of a saved page and the length of its byte order mark.

    A mark counts first, then a ``<meta charset>`` (or ``http-equiv`` content) in the first 1024 bytes, outside of comments; else UTF-8.
    As browsers have it, Latin-1 and ASCII mean Windows-1252, and a page that could be scanned is not UTF-16 whatever it declares.
    """
    for mark, name in ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be")):
        if data.startswith(mark):
            return name, len(mark)
    found = _META_CHARSET.search(_COMMENT.sub(b"", data[:_PRESCAN]))
    try:
        name = codecs.lookup(found[1].decode("ascii")).name if found else "utf-8"
    except (LookupError, UnicodeDecodeError):
        return "utf-8", 0
    return {"iso8859-1": "cp1252", "ascii": "cp1252"}.get(name, "utf-8" if name.startswith(("utf-16", "utf-32")) else name), 0


@F.pandas_udf(StringType())
def _decoded(content: pd.Series) -> pd.Series:
    def one(data):
        if data is None:
            return None
        name, skip = charset_of(data)
        return data[skip:].decode(name, "replace")
    return content.map(one)


def read_html_files(spark: SparkSession, path: str) -> DataFrame:
    """S1 for saved pages: one file = one page, its path as the URL, decoded by its own byte order mark or declaration."""
    return (spark.read.format("binaryFile").load(path)
            .select(F.xxhash64("path").alias("page_id"), F.col("path").alias("url"), _decoded("content").alias("html")))


def _attr_value_sql(attrs: str, name: str, table: str) -> str:
    """First attribute ``name`` (case-insensitive) of a tag's attribute text:
    its value ('' if it has none), null if absent."""
    def body(a):
        names = f"transform(regexp_extract_all({a}, {lit(_ATTR)}, 1), {lam(lambda n: f'lower({n})')})"

        def pick(idx):
            raw = f"try_element_at(regexp_extract_all({a}, {lit(_ATTR)}, 2), CAST(greatest({idx}, 1) AS INT))"
            unq = f"regexp_replace({raw}, {lit(_UNQUOTE)}, '$1$2')"
            return f"CASE WHEN {idx} > 0 THEN {_unshield_sql(decode_entities_sql(unq, table, attribute=True))} END"
        return let(f"array_position({names}, {lit(name)})", pick)
    return let(attrs, body)


def _start_tag(name: str) -> str:
    """Pattern of tokens that begin with a whole start tag ``name``, so not with one that never ends."""
    return rf"(?is)^<{name}(?=[\s/>]){_ATTRS}>"


def _kept_sql(t: str) -> str:
    """What is kept of a token: text as it is, an anchor's tags as marks and attributes, a raw-text element's content, else a gap."""
    content = f"regexp_extract({t}, {lit(_RAW_CONTENT)}, 1)"
    attrs = f"substring({t}, 3, length({t}) - 3)"
    return case(
        (f"NOT startswith({t}, '<') OR {t} = '<'", t),
        (f"{t} RLIKE {lit(_start_tag('a'))}", f"concat({lit(_OPEN)}, {attrs}, {lit(_MID)})"),
        (f"{t} RLIKE '(?i)^</a[\\\\s/>]'", lit(_CLOSE)),
        (f"{t} RLIKE '(?i)^<(script|style|noscript|iframe|xmp|noembed|noframes)[\\\\s/>]'",
         f"concat({lit(_GAP)}, replace({content}, '&', '&amp;'), {lit(_GAP)})"),
        (f"{t} RLIKE '(?i)^<textarea[\\\\s/>]'", f"concat({lit(_GAP)}, {content}, {lit(_GAP)})"),
        otherwise=lit(_GAP))


def _anchor_sql(a: str, table: str) -> str:
    attrs = f"substring_index(substring({a}, 2), {lit(_MID)}, 1)"
    content = f"substring({a}, instr({a}, {lit(_MID)}) + 1)"
    text = f"replace({decode_entities_sql(content, table)}, {lit(_GAP)}, '')"
    return struct(href=_attr_value_sql(attrs, "href", table), text=clean_text_sql(_unshield_sql(text)))


def scan_html_sql(html: str, table: str) -> str:
    """struct<base_href, title, links> of one page (see ``scan_html``); ``table``: named references."""
    def first(tokens, name):
        return f"try_element_at(filter({tokens}, {lam(lambda t: f'{t} RLIKE {lit(_start_tag(name))}')}), 1)"

    def build(tokens):
        title = _unshield_sql(decode_entities_sql(f"regexp_extract({first(tokens, 'title')}, {lit(_RAW_CONTENT)}, 1)", table))
        title = f"coalesce({collapse_ascii_ws_sql(title)}, '')"

        def base_of(b):
            return f"CASE WHEN {b} IS NOT NULL THEN {_attr_value_sql(f'substring({b}, 6, length({b}) - 6)', 'href', table)} END"

        base_href = f"CASE WHEN {html} RLIKE '(?i)<base[\\\\s/>]' THEN {let(first(tokens, 'base'), base_of)} END"
        kept = f"array_join(transform({tokens}, {lam(_kept_sql)}), '')"
        anchors = f"transform(regexp_extract_all({kept}, {lit(_ANCHOR)}, 0), {lam(lambda a: _anchor_sql(a, table))})"
        with_href = f"filter({anchors}, {lam(lambda x: f'{x}.href IS NOT NULL')})"
        link = lam(lambda x, i: struct(dom_index=f"CAST({i} AS BIGINT)", href=f"{x}.href",
                                       text=f"{x}.text"), 2)
        return struct(base_href=base_href, title=title, links=f"transform({with_href}, {link})")

    empty = struct(base_href="CAST(NULL AS STRING)", title="''", links=f"CAST(array() AS {LINK_TYPE})")
    tokens = f"regexp_extract_all({_shield_sql(html)}, {lit(_TOKEN)}, 0)"
    return f"CASE WHEN {html} IS NULL THEN {empty} ELSE {let(tokens, build)} END"


def scan_html(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """S2/S3 snapshotFromDocument over a pages table (no shuffle).

    ``links`` holds the ``a[href]`` anchors in document order with
    ``dom_index`` counted among them, ``href`` the attribute value
    (entity-decoded) and ``text`` the cleaned text content, that of inner scripts
    and styles included, as ``textContent`` has it; comments and
    raw-text elements (script, style, template, ...) hold no anchors.
    The markup is cut into tokens from left to right, so what looks like markup in a quoted
    value, a comment or a script, or like a comment in a value, is none.
    ``title`` is the whitespace-collapsed first ``<title>``.  ``page_url``
    is the page URL; a ``<base href>`` is kept in ``base_href`` and
    applied when the entries are built (it then also becomes the page URL,
    as ``document.baseURI`` does).  ``html`` is dropped right after the
    scan; a page without HTML is an empty scan (rA7).
    """
    scanned = F.expr(scan_html_sql(col(html), "_entities"))
    return pages.withColumn("_entities", F.expr(entity_table_sql())).select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.when(F.col(html).isNull(), F.lit(DEFAULT_PAGE_URL)).otherwise(F.col(url)).alias("page_url"),
        scanned.alias("_s"),
    ).select(
        "page_id", "page_url", "_s.base_href", "_s.title", "_s.links", F.lit(True).alias("scanned"),
    )


def from_snapshots(snapshots: DataFrame) -> DataFrame:
    """S4 extractLinksFromSnapshot head: snapshot records -> link arrays.

    Input columns: ``page_id`` and any of ``pageUrl``, ``url``, ``title``,
    ``links`` (array of ``domIndex, rawHref, resolvedHref, href, text``);
    values and fields may be null or missing.  Defaults follow rA6: page
    URL = ``pageUrl``, else ``url``, else ``https://example.invalid/``;
    links not an array -> none; href = first non-empty of
    ``resolvedHref``, ``rawHref``, ``href``; ``domIndex`` else the array
    index; null text -> ''.
    """
    cols = set(snapshots.columns)
    link_fields = set()
    if "links" in cols:
        link_fields = {f.name for f in snapshots.schema["links"].dataType.elementType.fields}

    def fld(x, name, typ="string"):
        return f"{x}.{name}" if name in link_fields else f"CAST(NULL AS {typ})"

    def nz(e):
        return f"nullif({e}, '')"

    def link(x, i):
        return struct(
            dom_index=f"coalesce(CAST({fld(x, 'domIndex', 'bigint')} AS BIGINT), CAST({i} AS BIGINT))",
            href=f"coalesce({nz(fld(x, 'resolvedHref'))}, {nz(fld(x, 'rawHref'))}, {nz(fld(x, 'href'))})",
            text=clean_text_sql(fld(x, "text")),
        )

    page_url = ("coalesce(" + ", ".join(
        [nz(col(c)) for c in ("pageUrl", "url") if c in cols] + [lit(DEFAULT_PAGE_URL)]) + ")")
    links = (f"coalesce(transform({col('links')}, {lam(link, 2)}), CAST(array() AS {LINK_TYPE}))"
             if "links" in cols else f"CAST(array() AS {LINK_TYPE})")
    title = f"coalesce({col('title')}, '')" if "title" in cols else "''"
    return snapshots.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.expr(page_url).alias("page_url"),
        F.expr(title).alias("title"),
        F.expr(links).alias("links"),
        F.lit(False).alias("scanned"),
    )
