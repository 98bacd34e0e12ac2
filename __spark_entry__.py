"""

Every query reads the given tables (``pages``, ``documents``) in full and
derives its input from them with Spark; ``oracle_sql`` gives the same
result as DuckDB SQL over the same parquet views.
"""

from __future__ import annotations

import functools
import os
import sys
from collections.abc import Callable

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from anchorage.plans.catalog import QUERIES  # noqa: E402
from anchorage.plans.visible import visible_links  # noqa: E402
from anchorage.plans.catalog import page_entries  # noqa: E402
from anchorage.settings import Settings  # noqa: E402

# The training-data operators are an optional part: without their folder and
# corpus_pipeline.py the rest works alone.  Other import errors still surface.
try:
    from anchorage.llm.catalog import ORACLE_SQL as LLM_ORACLE_SQL, QUERIES as LLM_QUERIES  # noqa: E402
except ModuleNotFoundError as missing:
    if not str(missing.name).startswith(("anchorage.llm", "corpus_pipeline")):
        raise
    LLM_QUERIES, LLM_ORACLE_SQL = {}, {}


def entry(spark: SparkSession) -> DataFrame:
    """Flagship query: visible links of every page at sf0.001."""
    return visible_links(spark, page_entries(spark, "/root/testdata/sf0.001"), Settings())


def _importable(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """``query`` with this folder on the Python path of the workers, wherever the driver was started."""
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        environment = spark.sparkContext.environment
        if HERE not in environment.get("PYTHONPATH", "").split(os.pathsep):
            environment["PYTHONPATH"] = os.pathsep.join(filter(None, [HERE, environment.get("PYTHONPATH")]))
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _importable(query) for name, query in {**QUERIES, **LLM_QUERIES}.items()}


# --- DuckDB oracle -------------------------------------------------------------------
# The test pages hold simple anchors <a href="/word">word</a>; the oracle
# extracts them with one regular expression and resolves them as
# origin + percent-encoded path.

_JS_SPACE = r"[\t\n\x{0B}\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"

_BASE = r"""
a AS (
  SELECT page_id, url,
         regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS hrefs,
         regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS texts,
         trim(regexp_replace(replace(replace(replace(replace(
             regexp_extract(html, '(?s)<title>(.*?)</title>', 1),
             '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'),
             '[\t\n\f\r ]+', ' ', 'g')) AS title
  FROM pages),
l AS (
  SELECT page_id, url, title, CAST(i AS BIGINT) AS dom_index, hrefs[i + 1] AS href,
         trim(regexp_replace(texts[i + 1], '\s+', ' ', 'g')) AS text
  FROM (SELECT *, unnest(range(len(hrefs))) AS i FROM a)),
e AS (
  SELECT page_id, url AS page_url, title, dom_index AS pos, dom_index,
         CAST(0 AS BIGINT) AS variant_index,
         regexp_extract(url, '^([a-z]+://[^/?#]+)', 1)
           || replace(replace(url_encode(href), '%2F', '/'), '%2C', ',') AS display_url,
         text, false AS surfaced, CAST(NULL AS VARCHAR) AS source_url
  FROM l)"""


def _visible(where: str = "true", order: str = "dom_index, variant_index, pos", url: str = "display_url") -> str:
    return f"""WITH {_BASE},
f AS (SELECT * FROM e WHERE {where}),
d AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY page_id, display_url ORDER BY pos) = 1)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY {order}) AS BIGINT) AS rank,
       dom_index, variant_index, display_url, text, surfaced, source_url, {url} AS url
FROM d"""


def _report(where: str, labels: str, error: str | None = None) -> str:
    err = f"'{error}'" if error else "NULL"
    return f"""WITH {_BASE},
src AS (SELECT page_id, page_url, title, count(*) AS n FROM e GROUP BY ALL),
vis AS (SELECT page_id, count(DISTINCT display_url) AS n FROM e WHERE {where} GROUP BY page_id),
r AS (
  SELECT src.page_id, src.page_url, src.title, CAST(src.n AS BIGINT) AS n_source,
         CAST(coalesce(vis.n, 0) AS BIGINT) AS n_visible
  FROM src LEFT JOIN vis USING (page_id)),
h AS (
  SELECT *, n_visible AS lines,
         CASE WHEN n_visible > 0 THEN ''
              WHEN n_source = 0 THEN 'No links were found on this page.'
              ELSE 'No links matched the active filters{labels}. Try Reset Filters.' END AS hint
  FROM r)
SELECT page_id, n_source, n_visible, lines, lines AS nonblank_lines, hint,
       CAST(n_visible AS VARCHAR) || ' links ready from '
         || coalesce(nullif(title, ''), nullif(page_url, ''), 'the active tab') || '.' AS summary,
       coalesce({err}, nullif(hint, ''), CAST(lines AS VARCHAR) || ' clean lines ready for copy or export.') AS message,
       starts_with(page_url, 'file:') AS is_local_file
FROM h"""


def _csv(x: str) -> str:
    return f"""CASE WHEN regexp_matches({x}, '[",\n]') THEN '"' || replace({x}, '"', '""') || '"' ELSE {x} END"""


def _slug(x: str, n: int) -> str:
    return (f"regexp_replace(substr(regexp_replace(lower(trim({x})), '[^a-z0-9]+', '-', 'g'), 1, {n}), "
            f"'^-+|-+$', '', 'g')")


_SAVED = f"""WITH {_BASE},
s AS (SELECT CAST(row_number() OVER (ORDER BY a.page_id) AS BIGINT) AS sequence, a.page_id AS source_id,
             a.url AS page_url, a.title, CAST(len(a.hrefs) AS BIGINT) AS n_entries FROM a),
saved AS (SELECT sequence, 'result-' || CAST(sequence AS VARCHAR) AS result_id, source_id, page_url, title,
                 n_entries FROM s)"""

_EXPORT_SUFFIX = "-links-include-github-text-main-page-textexcl-value"

# Wrapped links (see anchorage.plans.wrapped): the same nine hrefs per page,
# then query / fragment parameters parsed with string_split + url_decode.
_W = r"""
w AS (
  SELECT p.page_id, p.url, CAST(k.k AS BIGINT) AS dom_index,
    CASE k.k
      WHEN 0 THEN p.url
      WHEN 1 THEN 'https://go.example/out?url=' || url_encode(p.url)
      WHEN 2 THEN 'https://go.example/r?x=1#next=' || url_encode(p.url)
      WHEN 3 THEN 'https://go.example/out?to=%2Flocal%2F' || CAST(p.page_id AS VARCHAR)
      WHEN 4 THEN 'https://go.example/out?u=javascript%3Avoid(0)'
      WHEN 5 THEN 'mailto:p' || CAST(p.page_id AS VARCHAR) || '@example.com'
      WHEN 6 THEN 'JavaScript:void(' || CAST(p.page_id AS VARCHAR) || ')'
      WHEN 7 THEN p.url
      WHEN 8 THEN 'https://files.example/a%20b/' || CAST(p.page_id AS VARCHAR) || '?q=c%26d,e'
      WHEN 9 THEN 'https://go.example/out?url=' || url_encode('http://%5B::1%5D/' || CAST(p.page_id AS VARCHAR))
      WHEN 10 THEN 'https://go.example/out?url=' || url_encode(p.url) || '&next=' || url_encode(p.url)
      ELSE 'https://go.example/s#?url=' || url_encode(p.url) END AS href,
    CASE WHEN k.k = 7 THEN 'Again "x", y' ELSE 'Item ' || CAST(k.k AS VARCHAR) END AS text
  FROM pages p CROSS JOIN range(12) k(k)),
wk AS (
  SELECT *, href AS display_url,
         CASE WHEN contains(href, '?') THEN regexp_extract(href, '^[^?#]*[?]([^#]*)', 1) ELSE '' END AS q,
         CASE WHEN contains(href, '#') THEN regexp_extract(href, '#(.*)$', 1) ELSE '' END AS frag
  FROM w WHERE NOT regexp_matches(lower(trim(href)), '^(about|blob|data|javascript|moz-extension):')),
wl AS (
  SELECT *, list_concat(list_filter(string_split(q, '&'), lambda x: x <> ''),
                        CASE WHEN contains(frag, '=') THEN list_filter(string_split(regexp_replace(frag, '^[?]', ''), '&'), lambda x: x <> '')
                             ELSE [] END) AS pieces
  FROM wk),
wp AS (
  SELECT page_id, dom_index, display_url, text, CAST(i AS BIGINT) AS param_index,
         url_decode(replace(CASE WHEN contains(pieces[i + 1], '=') THEN split_part(pieces[i + 1], '=', 1) ELSE pieces[i + 1] END, '+', '%20')) AS key,
         url_decode(replace(CASE WHEN contains(pieces[i + 1], '=') THEN substr(pieces[i + 1], strpos(pieces[i + 1], '=') + 1) ELSE '' END, '+', '%20')) AS value
  FROM (SELECT *, unnest(range(len(pieces))) AS i FROM wl)),
wc AS (
  SELECT page_id, dom_index, display_url, text, param_index,
         CASE WHEN regexp_matches(trim(value), '^(about|blob|data|javascript|moz-extension):', 'i') THEN NULL
              WHEN contains(value, '%5B') THEN url_decode(trim(value))
              WHEN regexp_matches(trim(value), '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN trim(value)
              WHEN starts_with(trim(value), '/') THEN regexp_extract(display_url, '^([a-z]+://[^/?#]+)', 1) || trim(value)
         END AS target
  FROM wp WHERE lower(key) IN ('dest', 'destination', 'next', 'out', 'r', 'redir', 'redirect',
                               'redirect_uri', 'redirect_url', 'target', 'to', 'u', 'url') AND value <> ''),
wt AS (
  SELECT page_id, dom_index, text, display_url AS source_url, target,
         CAST(row_number() OVER (PARTITION BY page_id, dom_index ORDER BY param_index) AS BIGINT) AS variant_index
  FROM (SELECT * FROM wc WHERE target IS NOT NULL AND target <> display_url
        QUALIFY row_number() OVER (PARTITION BY page_id, dom_index, target ORDER BY param_index) = 1)),
we0 AS (
  SELECT page_id, dom_index, CAST(0 AS BIGINT) AS variant_index, display_url, text, false AS surfaced,
         CAST(NULL AS VARCHAR) AS source_url FROM wk
  UNION ALL
  SELECT page_id, dom_index, variant_index, target, text, true, source_url FROM wt),
we AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY page_id ORDER BY dom_index, variant_index) - 1 AS BIGINT) AS pos
  FROM we0)"""


def _decode_uri(x: str) -> str:
    return (f"url_decode(replace(regexp_replace({x}, '%(2[346BCFbcf]|3[ABDFabdf]|40)', '%25\\1', 'g'), "
            f"'+', '%2B'))")


def _wvisible(where: str = "true", order: str = "dom_index, variant_index, pos", url: str = "display_url",
              cols: str = "page_id, rank, dom_index, variant_index, display_url, text, surfaced, source_url, url") -> str:
    return f"""WITH {_W},
f AS (SELECT * FROM we WHERE {where}),
d AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY page_id, display_url ORDER BY pos) = 1),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY page_id ORDER BY {order}) AS BIGINT) AS rank,
             {url} AS url FROM d)
SELECT {cols} FROM r"""


_SETTINGS = """
e AS (
  SELECT user_id, event_type, regexp_extract(props, '([0-9]+)', 1) AS n, value FROM events
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1),
m AS (
  SELECT user_id AS profile_id, CASE event_type WHEN 'click' THEN 'alphabetical' ELSE 'original' END AS sortMode,
         CASE event_type WHEN 'signup' THEN 'dark' ELSE 'system' END AS themeMode,
         CASE WHEN n::INT % 3 = 0 THEN n ELSE chr(9) || ' ' END AS urlIncludePattern,
         CASE WHEN n::INT % 2 = 0 THEN 'local, ' || n ELSE '' END AS urlExcludePattern,
         CASE WHEN n::INT % 5 = 0 THEN 'item' ELSE '' END AS textIncludePattern, '' AS textExcludePattern,
         coalesce(value > 20, false) AS useRegex, coalesce(value - 5 <> 0, false) AS decodeUrls
  FROM e)"""


def oracle_sql() -> dict[str, str]:
    txt_max = 120 - len(_EXPORT_SUFFIX + ".txt")
    csv_max = 120 - len(_EXPORT_SUFFIX + ".csv")
    title = "coalesce(nullif(title, ''), 'links')"
    return {
        "anchors": f"WITH {_BASE} SELECT page_id, dom_index, href, text FROM l",
        "page_meta": f"WITH {_BASE} SELECT page_id, url AS page_url, title FROM a",
        "resolved_links": f"WITH {_BASE} SELECT page_id, dom_index, display_url, text FROM e",
        "entries": f"WITH {_BASE} SELECT page_id, pos, dom_index, variant_index, display_url, text, "
                   "surfaced, source_url FROM e",
        "visible_links": _visible(),
        "sort_alpha": _visible(order="display_url COLLATE noaccent.nocase, dom_index, variant_index, pos"),
        "filter_url_terms": _visible("contains(lower(display_url), 'th') OR contains(lower(display_url), 'an')"),
        "filter_url_exclude": _visible("NOT (contains(lower(display_url), 'the') OR contains(lower(display_url), 'er'))"),
        "filter_text_terms": _visible("contains(lower(text), 'ou') OR contains(lower(text), 'th')"),
        "filter_text_exclude": _visible("NOT contains(lower(text), 'e')"),
        "filter_regex": _visible(r"regexp_matches(display_url, '/[a-z]{2,4}$|a\{|\[', 'i')"),
        "decode_urls": _visible(url="url_decode(display_url)"),
        "page_report": _report("contains(lower(text), 'the')", ": Text include"),
        "filter_invalid_regex": f"""SELECT page_id, n_visible, hint, message FROM ({_report(
            "NOT regexp_matches(text, '^t', 'i')", ": Text exclude", "URL include regex is invalid.")})""",
        "plain_text": f"""WITH {_BASE},
d AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY page_id, display_url ORDER BY pos) = 1)
SELECT page_id, string_agg(display_url, chr(10) ORDER BY dom_index, variant_index, pos) AS text,
       CAST(count(*) AS BIGINT) AS lines
FROM d GROUP BY page_id""",
        "csv_document": f"""WITH {_BASE}
SELECT page_id, 'url,link_text,is_redirect,redirect_source' || chr(10) || string_agg(
         {_csv('display_url')} || ',' || {_csv('text')} || ',false,', chr(10) ORDER BY pos) AS csv
FROM e GROUP BY page_id""",
        "export_names": f"""WITH {_BASE}
SELECT page_id,
       coalesce(nullif({_slug(title, txt_max)}, ''), 'links') || '{_EXPORT_SUFFIX}.txt' AS txt_name,
       coalesce(nullif({_slug(title, csv_max)}, ''), 'links') || '{_EXPORT_SUFFIX}.csv' AS csv_name
FROM a""",
        "dedup_corpus": f"""WITH {_BASE}
SELECT display_url, page_id, pos, text FROM e
QUALIFY row_number() OVER (PARTITION BY display_url ORDER BY page_id, pos) = 1""",
        "clean_text": f"""SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '{_JS_SPACE}', ' ', 'g'),
       '^ | $', '', 'g') AS clean FROM documents""",
        "protocol_filter": f"""WITH {_W} SELECT page_id, dom_index, href,
            regexp_matches(lower(trim(href)), '^(about|blob|data|javascript|moz-extension):') AS skipped FROM w""",
        "redirect_params": f"WITH {_W} SELECT page_id, dom_index, param_index, key, value FROM wp",
        "redirect_targets": f"""WITH {_W} SELECT page_id, dom_index, variant_index, target,
            source_url AS wrapper FROM wt""",
        "wrapped_entries": f"""WITH {_W} SELECT page_id, pos, dom_index, variant_index, display_url, text,
            surfaced, source_url FROM we""",
        "dedup_page": f"""WITH {_W} SELECT page_id, pos, dom_index, variant_index, display_url, text,
            surfaced, source_url FROM we
            QUALIFY row_number() OVER (PARTITION BY page_id, display_url ORDER BY pos) = 1""",
        "wrapped_dedup_corpus": f"""WITH {_W} SELECT display_url, page_id, pos, text FROM we
            QUALIFY row_number() OVER (PARTITION BY display_url ORDER BY page_id, pos) = 1""",
        "dedup_corpus_runs": f"""WITH {_W} SELECT display_url, page_id, pos, text FROM we
            QUALIFY row_number() OVER (PARTITION BY display_url ORDER BY page_id, pos) = 1""",
        "sort_original": _wvisible(),
        "filter_all": _wvisible("contains(lower(display_url), 'example') AND NOT contains(lower(display_url), 'local') "
                                "AND (contains(lower(text), 'item') OR contains(lower(text), 'again')) "
                                "AND NOT contains(lower(text), '8')"),
        "wrapped_decode_urls": _wvisible(order="display_url COLLATE noaccent.nocase, dom_index, variant_index, pos",
                                         url=_decode_uri("display_url")),
        "csv_rows": _wvisible(url=_decode_uri("display_url"), cols=(
            "page_id, rank, " + _csv("url") + " || ',' || " + _csv("text")
            + " || ',' || CASE WHEN surfaced THEN 'true' ELSE 'false' END || ',' || "
            + _csv(f"CASE WHEN surfaced THEN {_decode_uri('coalesce(source_url, ' + chr(39) * 2 + ')')} ELSE '' END")
            + " AS line")),
        "snapshot_source": f"""WITH {_BASE}
SELECT a.page_id, a.url AS page_url, CASE WHEN a.page_id % 4 = 2 THEN '' ELSE a.title END AS title,
       CASE WHEN a.page_id % 4 = 0 THEN dom_index * 10 ELSE dom_index END AS dom_index, href,
       CASE WHEN a.page_id % 4 = 3 AND href IS NOT NULL THEN '' ELSE text END AS text
FROM a LEFT JOIN l ON l.page_id = a.page_id AND a.page_id % 8 <> 5""",
        "settings_merge": f"WITH {_SETTINGS} SELECT * FROM m",
        "settings_summary": f"""WITH {_SETTINGS},
c AS (
  SELECT *, CAST(urlIncludePattern NOT IN ('', chr(9) || ' ') AS INT) + CAST(urlExcludePattern <> '' AS INT)
            + CAST(textIncludePattern <> '' AS INT) AS n FROM m)
SELECT profile_id, concat_ws(' • ',
    CASE sortMode WHEN 'alphabetical' THEN 'Alphabetical' ELSE 'Original page order' END,
    CASE n WHEN 0 THEN 'no active filters' WHEN 1 THEN '1 active filter' ELSE n || ' active filters' END,
    CASE WHEN useRegex THEN 'regex on' ELSE 'regex off' END,
    CASE WHEN decodeUrls THEN 'URL decoding on' ELSE 'URL decoding off' END) AS summary
FROM c""",
        "profile_table": f"""WITH {_W}, {_SETTINGS},
q AS (SELECT DISTINCT user_id AS profile_id, event_id % (SELECT count(*) FROM pages) AS page_id FROM events),
f AS (
  SELECT profile_id, sortMode, decodeUrls, we.* FROM q JOIN we USING (page_id) JOIN m USING (profile_id)
  WHERE (urlIncludePattern = chr(9) || ' ' OR contains(display_url, urlIncludePattern))
    AND NOT CASE WHEN urlExcludePattern = '' THEN false WHEN useRegex THEN contains(display_url, urlExcludePattern)
            ELSE contains(lower(display_url), 'local') OR contains(display_url, split_part(urlExcludePattern, ', ', 2)) END
    AND (textIncludePattern = '' OR contains(lower(text), 'item'))),
d AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY profile_id, page_id, display_url ORDER BY pos) = 1)
SELECT profile_id, page_id, text, surfaced, CASE WHEN decodeUrls THEN {_decode_uri('display_url')} ELSE display_url END AS url,
       CAST(CASE sortMode
         WHEN 'alphabetical' THEN row_number() OVER (PARTITION BY profile_id, page_id ORDER BY display_url COLLATE noaccent.nocase, dom_index, variant_index, pos)
         ELSE row_number() OVER (PARTITION BY profile_id, page_id ORDER BY dom_index, variant_index, pos) END AS BIGINT) AS rank
FROM d""",
        "html_variants": """
SELECT page_id, 'https://site.example/c/' AS page_url, 'Té ' || chr(CAST(page_id % 90 + 33 AS INT)) || ' A' AS title, 0::BIGINT AS dom_index,
       'https://site.example/c/x?a=1&copy=' || page_id || '&copy=2' AS display_url, 'one <b>' AS text
FROM pages WHERE page_id % 3 = 0
UNION ALL
SELECT page_id, 'https://site.example/a/b', page_id::VARCHAR, NULL, NULL, NULL FROM pages WHERE page_id % 3 = 1
UNION ALL
SELECT page_id, 'https://site.example/a/b', '', k, CASE k
         WHEN 0 THEN 'https://xn--mnchen-3ya.example/' || page_id
         WHEN 1 THEN 'http://[2001:db8::' || CASE page_id % 10 WHEN 0 THEN '' ELSE (page_id % 10)::VARCHAR END || ']/'
         ELSE 'http://127.0.0.1/' || page_id END,
       CASE k WHEN 0 THEN 'idn' WHEN 1 THEN 'six' ELSE '’four' END
FROM pages, range(3) r(k) WHERE page_id % 3 = 2""",
        "html_markup": f"""WITH {_BASE}
SELECT page_id, title, dom_index + 5 AS dom_index, href, text FROM l
UNION ALL
SELECT page_id, title, k - 1, ['/1', '/2', '/3', '/q?a="4', '/5'][k],
       ['one', 'one', '1<2 and 3>2"<a href=/no>"', '&amp;', page_id::VARCHAR][k]
FROM a, range(1, 6) r(k)""",
        "idn_hosts": f"""SELECT page_id, k - 1 AS dom_index, 'http://' || [{', '.join(f"'{h}'" for h in (
            'xn--strae-oqa.example', 'xn--bcher-kva.example', 'xn--wgv71a.jp', 'xn--' + ('ü' * 70).encode('punycode').decode() + '.example',
            'a.example', 'xn--zca.example', 'xn--9ca.example'))}][k] || '/' || page_id AS display_url
FROM pages, range(1, 8) r(k)""",
        "extract_again": f"""{_SAVED},
kept AS (SELECT result_id, sequence FROM saved ORDER BY sequence DESC LIMIT 50)
SELECT kept.*, 'result-' || n AS current, n::BIGINT AS last FROM kept, (SELECT count(*) AS n FROM pages)""",
        "txt_export": _wvisible(url=_decode_uri("display_url"),
                                cols="page_id, rank, 'links-links.txt' AS export_name, url"),
        "csv_export": _wvisible(url=_decode_uri("display_url"), cols=(
            "page_id, rank, 'links-links.csv' AS export_name, url, text AS link_text, "
            "CASE WHEN surfaced THEN 'true' ELSE 'false' END AS is_redirect, "
            "CASE WHEN surfaced THEN " + _decode_uri("coalesce(source_url, '')") + " ELSE '' END AS redirect_source")),
        "profile_apply": " UNION ALL ".join([
            "SELECT * FROM (" + _wvisible(cols="'default' AS profile_id, page_id, rank, url, text, surfaced") + ")",
            "SELECT * FROM (" + _wvisible("NOT (contains(lower(display_url), 'go.example') OR contains(lower(display_url), 'files'))",
                                          cols="'targets_only' AS profile_id, page_id, rank, url, text, surfaced") + ")",
            "SELECT * FROM (" + _wvisible("contains(lower(text), 'item')",
                                          order="display_url COLLATE noaccent.nocase, dom_index, variant_index, pos",
                                          cols="'alpha_items' AS profile_id, page_id, rank, url, text, surfaced") + ")",
            "SELECT * FROM (" + _wvisible("regexp_matches(display_url, '^https://(go|files)[.]', 'i')",
                                          url=_decode_uri("display_url"),
                                          cols="'regex_decode' AS profile_id, page_id, rank, url, text, surfaced") + ")",
        ]),
        "stream_extract": f"WITH {_BASE} SELECT page_id, pos, dom_index, variant_index, display_url, text, "
                          "surfaced, source_url FROM e",
        "stream_refresh": f"""{_SAVED},
n AS (SELECT count(*) AS n FROM pages),
r AS (SELECT event_id % (SELECT n FROM n) AS source_id, max(ts) AS refreshed_at, count(*) AS n_requests
      FROM events GROUP BY ALL)
SELECT result_id, sequence, saved.source_id, n_entries, r.refreshed_at,
       CAST(coalesce(r.n_requests, 0) AS BIGINT) AS n_requests
FROM saved LEFT JOIN r USING (source_id)""",
        "results_update": f"""{_SAVED}
SELECT result_id, sequence, source_id, page_url,
       CASE WHEN contains(title, '&') THEN title || ' (updated)' ELSE title END AS title,
       CAST(NULL AS VARCHAR) AS error
FROM saved
UNION ALL
SELECT 'result-' || CAST(sequence + (SELECT count(*) FROM saved) AS VARCHAR), NULL, NULL, NULL, NULL,
       'Saved result could not be found. Please run a new extraction.'
FROM saved""",
        "results_refresh": f"""{_SAVED}
SELECT result_id, sequence, source_id, n_entries,
       CASE WHEN source_id % 10 = 0 THEN 'The original tab is no longer available. Run a fresh extraction.' END AS error FROM saved""",
        "results_by_id": f"""{_SAVED},
q AS (SELECT DISTINCT 'result-' || (event_id % (2 * (SELECT count(*) FROM pages))) AS result_id FROM events)
SELECT result_id, sequence, source_id, page_url FROM q LEFT JOIN saved USING (result_id)""",
        "settings_save": f"""WITH {_SETTINGS},
p AS (
  SELECT user_id AS profile_id, regexp_extract(props, '([0-9]+)', 1) AS n, value FROM events WHERE event_type = 'purchase'
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT profile_id, CASE WHEN p.value > 20 THEN 'alphabetical' ELSE sortMode END AS sortMode, themeMode, urlIncludePattern,
       coalesce('p' || p.n, urlExcludePattern) AS urlExcludePattern, textIncludePattern, textExcludePattern,
       coalesce(p.value < 10, useRegex) AS useRegex, decodeUrls
FROM m LEFT JOIN p USING (profile_id)""",
        "settings_reset": f"""WITH {_SETTINGS}
SELECT profile_id, sortMode, themeMode, '' AS urlIncludePattern, '' AS urlExcludePattern, '' AS textIncludePattern,
       '' AS textExcludePattern, false AS useRegex, false AS decodeUrls FROM m""",
        "results_append": f"{_SAVED} SELECT sequence, result_id, 'result:' || result_id AS storage_key, source_id, page_url, title, n_entries FROM saved",
        "results_prune": f"""{_SAVED},
cur AS (SELECT max_by(result_id, sequence) AS cid FROM saved),
c AS (SELECT result_id, row_number() OVER (ORDER BY sequence) AS rk FROM saved
      WHERE result_id <> (SELECT cid FROM cur))
SELECT sequence, result_id, source_id FROM saved
WHERE result_id NOT IN (SELECT result_id FROM c WHERE rk <= (SELECT count(*) FROM saved) - 50)""",
        "results_lookup": f"""{_SAVED}
SELECT result_id, sequence, source_id, page_url FROM saved ORDER BY sequence DESC LIMIT 1""",
        **LLM_ORACLE_SQL,
    }
