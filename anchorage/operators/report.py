"""Formatting, reports and export names.

All per page on the nested arrays: one row in, one row out.
"""

from __future__ import annotations

import re

from anchorage.functions.sql import lam, lit
from anchorage.functions.text import csv_escape_sql, slug_sql
from anchorage.functions.urls import decode_uri_sql, js_trim_sql
from anchorage.settings import Settings

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's (CSV header, messages,
# file-name limits, settings summary labels).
CSV_HEADER = "url,link_text,is_redirect,redirect_source"
NO_LINKS_HINT = "No links were found on this page."
MAX_FILENAME_LENGTH = 120
FILTER_VALUE_MAX_LENGTH = 20
SORT_LABELS = {"original": "Original page order", "alphabetical": "Alphabetical"}
# ---------------------------------------------------------------------------


def format_url_sql(x: str, decode: bool) -> str:
    """formatUrl(url, decodeUrls)."""
    return decode_uri_sql(x) if decode else x


def plain_text_sql(arr: str, decode: bool) -> str:
    """P5 + G1: one formatted URL per line, '\\n' joined, no trailing newline."""
    return f"array_join(transform({arr}, {lam(lambda e: format_url_sql(f'{e}.display_url', decode))}), {lit(chr(10))})"


def csv_row_sql(e: str, decode: bool) -> str:
    """One CSV line of an entry (U9 escaping)."""
    url = csv_escape_sql(format_url_sql(f"{e}.display_url", decode))
    text = csv_escape_sql(f"{e}.text")
    flag = f"CASE WHEN {e}.surfaced THEN 'true' ELSE 'false' END"
    source = csv_escape_sql(
        f"CASE WHEN {e}.surfaced THEN {format_url_sql(f'coalesce({e}.source_url, {lit(str())})', decode)} ELSE '' END")
    return f"concat_ws(',', {url}, {text}, {flag}, {source})"


def csv_document_sql(arr: str, decode: bool) -> str:
    """Header + rows, '\\n' joined."""
    rows = f"transform({arr}, {lam(lambda e: csv_row_sql(e, decode))})"
    return f"array_join(concat(array({lit(CSV_HEADER)}), {rows}), {lit(chr(10))})"


def line_count_sql(text: str) -> str:
    """Text ? text.split('\\n').length : 0."""
    return f"CASE WHEN {text} = '' THEN 0 ELSE size(split({text}, {lit(chr(10))}, -1)) END"


def nonblank_line_count_sql(text: str) -> str:
    """split('\\n').filter(Boolean).length."""
    return f"size(filter(split({text}, {lit(chr(10))}, -1), {lam(lambda x: f'{x} <> {lit(str())}')}))"


def summary_sql(n: str, title: str, page_url: str) -> str:
    """G3: '<n> links ready from <title or page URL or 'the active tab'>.'"""
    src = f"coalesce(nullif({title}, ''), nullif({page_url}, ''), 'the active tab')"
    return f"concat(CAST({n} AS STRING), ' links ready from ', {src}, '.')"


def py_slug(value: str, max_len=None) -> str:
    """U10 for driver-side constants (settings values)."""
    v = re.sub(r"[^a-z0-9]+", "-", str(value).strip().lower())
    if max_len is not None:
        v = v[:max_len]
    return re.sub(r"^-+|-+$", "", v)


def filter_suffix(s: Settings) -> str:
    """K3: '-include-x-exclude-y-text-z-textexcl-w' for the active patterns."""
    parts = [("include", s.url_include), ("exclude", s.url_exclude),
             ("text", s.text_include), ("textexcl", s.text_exclude)]
    return "".join(f"-{label}-{py_slug(str(v).strip(), FILTER_VALUE_MAX_LENGTH) or 'value'}"
                   for label, v in parts if str(v or "").strip())


DEFAULT_EXPORT_TITLE = "links"


def export_name_sql(title: str, s: Settings, extension: str = "txt",
                    default_title: str = DEFAULT_EXPORT_TITLE) -> str:
    """K3 buildDownloadFilename(title || default_title, settings, extension)."""
    ext = re.sub(r"[^a-z0-9]", "", str(extension or "txt").lower()) or "txt"
    fixed = f"-links{filter_suffix(s)}.{ext}"
    max_title = max(1, MAX_FILENAME_LENGTH - len(fixed))
    raw_title = f"coalesce(nullif({title}, ''), {lit(default_title)})"
    return f"concat(coalesce(nullif({slug_sql(raw_title, str(max_title))}, ''), 'links'), {lit(fixed)})"


def settings_summary(s: Settings) -> str:
    """G7 renderSettingsSummary (driver-side, one settings record)."""
    n = sum(1 for _, p in s.patterns() if p.strip())
    filters = "no active filters" if n == 0 else f"{n} active filter{'' if n == 1 else 's'}"
    return " • ".join([SORT_LABELS.get(s.sort_mode, SORT_LABELS["original"]), filters,
                       "regex on" if s.use_regex else "regex off",
                       "URL decoding on" if s.decode_urls else "URL decoding off"])


def settings_summary_sql() -> str:
    """G7 for a merged settings table (``operators.store.merge_settings``)."""
    n = " + ".join(f"CASE WHEN {js_trim_sql(c)} <> '' THEN 1 ELSE 0 END" for c in (
        "urlIncludePattern", "urlExcludePattern", "textIncludePattern", "textExcludePattern"))
    sort = (f"CASE WHEN sortMode = 'alphabetical' THEN {lit(SORT_LABELS['alphabetical'])} "
            f"ELSE {lit(SORT_LABELS['original'])} END")
    filters = (f"CASE WHEN ({n}) = 0 THEN 'no active filters' WHEN ({n}) = 1 THEN '1 active filter' "
               f"ELSE concat(CAST(({n}) AS STRING), ' active filters') END")
    return (f"concat_ws(' • ', {sort}, {filters}, CASE WHEN useRegex THEN 'regex on' ELSE 'regex off' END, "
            f"CASE WHEN decodeUrls THEN 'URL decoding on' ELSE 'URL decoding off' END)")
