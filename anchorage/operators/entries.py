"""Entries (P1-P3, F1, F2, U3, U7): link arrays -> per-page entry arrays.

An entry is ``struct<pos, dom_index, variant_index, display_url, text,
surfaced, source_url>``; ``pos`` is the emission order within the page,
on which de-duplication and stable ordering depend.  Each link yields
its own entry (variant 0) followed by one entry per hidden redirect
target (variant 1, 2, ...).

Plan: every page row gets a number at the source, so pages that share an id
(or have none) stay apart.  The link arrays are hash-partitioned on it once; links and
redirect candidates are exploded and resolved with one projection per
URL-parser stage (whole-stage codegen, no lambdas), and the entries are
re-assembled per link and per page by aggregates whose keys start with
the row number, so they reuse that single exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorage.functions.redirects import redirect_candidates_sql
from anchorage.functions.sql import lam, struct
from anchorage.functions.urls import (
    decode_component_sql, is_skipped_sql, js_trim_sql, serialize_url_sql, with_url,
)

ENTRY_FIELDS = ("pos", "dom_index", "variant_index", "display_url", "text", "surfaced", "source_url")
ENTRY_TYPE = (
    "struct<pos:bigint,dom_index:bigint,variant_index:bigint,display_url:string,"
    "text:string,surfaced:boolean,source_url:string>"
)
PAGE_COLS = ("page_id", "page_url", "title")


def entry_sql(display_url, text, dom_index, variant_index, surfaced="false",
              source_url="CAST(NULL AS STRING)", pos="CAST(NULL AS BIGINT)") -> str:
    """P1 createEntry."""
    return struct(
        pos=f"CAST({pos} AS BIGINT)",
        dom_index=f"CAST({dom_index} AS BIGINT)",
        variant_index=f"CAST({variant_index} AS BIGINT)",
        display_url=f"CAST({display_url} AS STRING)",
        text=f"CAST({text} AS STRING)",
        surfaced=f"CAST({surfaced} AS BOOLEAN)",
        source_url=f"CAST({source_url} AS STRING)",
    )


def page_bases(links: DataFrame) -> DataFrame:
    """Document base: ``<base href>`` against the page URL, else the page URL.
    Sources without a ``base_href`` column (snapshots) keep their page URL as it is."""
    if "base_href" not in links.columns:
        return with_url(links, "page_url", "_base")
    df = with_url(links, "page_url", "_doc")
    df = df.withColumn("_bh", F.coalesce("base_href", F.lit("")))
    df = with_url(df, "_bh", "_bp", base="_doc")
    df = df.withColumn("_base", F.expr("CASE WHEN base_href IS NOT NULL AND _bp IS NOT NULL "
                                       "THEN _bp ELSE _doc END"))
    return df.withColumn(
        "page_url", F.coalesce(F.expr(serialize_url_sql("_base")), F.col("page_url"))
    ).drop("_doc", "_bh", "_bp", "base_href")


def resolved_links(links: DataFrame) -> DataFrame:
    """One row per link with its display URL (parsed too) and
    ``keep`` (False for dropped links).

    Snapshot hrefs are raw: empty or skipped values are dropped before
    resolving.  Without a valid base no link resolves.  HTML scans hold the attribute value; like ``anchor.href``
    it is resolved first and the skip test sees the resolved URL.  Rows
    are flagged, not filtered: a filter above the parser stages would be
    pushed down through them and inline every stage.
    """
    df = page_bases(links)
    row = [c for c in ("_row",) if c in links.columns]
    df = df.select(*row, *PAGE_COLS, "scanned", "_base", F.posexplode_outer("links").alias("link_idx", "_l"))
    df = df.select(*row, *PAGE_COLS, "scanned", "_base", "link_idx",
                   F.col("_l.dom_index").alias("dom_index"), F.col("_l.href").alias("href"),
                   F.col("_l.text").alias("text"))
    pre_skip = f"(href IS NULL OR (NOT scanned AND (href = '' OR {is_skipped_sql('href')})))"
    df = df.withColumn("_h", F.expr(f"CASE WHEN {pre_skip} THEN NULL ELSE href END"))
    df = with_url(df, "_h", "_p", base="_base", string_out="display_url")
    return df.withColumn(
        "keep", F.expr(f"display_url IS NOT NULL AND _base IS NOT NULL AND NOT {is_skipped_sql('display_url')}")
    ).drop("_base", "href", "_h", "scanned")


def _with_targets(kept: DataFrame, surface: bool) -> DataFrame:
    """One row per link with ``targets`` (first-seen order,
    de-duplicated, never the link itself).

    Each candidate is tried raw, then decoded: both attempts are exploded
    into rows and resolved by one parser pass; the aggregate keeps the
    first attempt that resolves to a non-skipped URL.
    """
    cands = F.expr(f"CASE WHEN keep THEN {redirect_candidates_sql('_p')} "
                   "ELSE CAST(array() AS array<string>) END") if surface \
        else F.expr("CAST(array() AS array<string>)")
    df = kept.select("_row", *PAGE_COLS, "link_idx", "dom_index", "text", "display_url", "keep", "_p",
                     F.posexplode_outer(cands).alias("cand_idx", "cand"))
    attempts = (f"CASE WHEN cand IS NULL THEN CAST(array() AS array<struct<att:int,v:string>>) ELSE "
                f"array(struct(0 AS att, {js_trim_sql('cand')} AS v), "
                f"struct(1 AS att, {js_trim_sql(decode_component_sql('cand'))} AS v)) END")
    df = df.select("*", F.explode_outer(F.expr(attempts)).alias("_a"))
    ok = f"(_a.v <> '' AND NOT {is_skipped_sql('_a.v')})"
    df = df.withColumn("_t", F.expr(f"CASE WHEN {ok} THEN _a.v END"))
    df = with_url(df, "_t", "_q", base="_p", string_out="_r")
    valid = f"_t IS NOT NULL AND _r IS NOT NULL AND NOT {is_skipped_sql('_r')}"
    df = df.withColumn("_tg", F.expr(f"CASE WHEN {valid} THEN struct(cand_idx, _a.att AS att, _r AS target) END"))
    return df.groupBy("_row", "link_idx").agg(
        *(F.first(c).alias(c) for c in PAGE_COLS),
        F.first("dom_index").alias("dom_index"),
        F.first("text").alias("text"),
        F.first("display_url").alias("display_url"),
        F.first("keep").alias("keep"),
        F.expr("array_sort(collect_list(_tg))").alias("_tried"),
    ).withColumn("targets", F.expr(
        "array_distinct(transform(filter(filter(_tried, (x, i) -> i = 0 OR "
        "x.cand_idx <> element_at(_tried, i).cand_idx), x -> x.target <> display_url), x -> x.target))")
    ).drop("_tried")


def link_entries(links: DataFrame, surface_redirects: bool = True) -> DataFrame:
    """P3 extractLinksFromSnapshot: page link arrays -> page entry arrays.

    Output ``page_id, page_url, title, entries`` (one row per page, pages
    without links included).  One hash exchange on the row number; the
    per-link and per-page aggregates after it reuse that partitioning and
    carry the page fields, so nothing is joined back.
    """
    parted = links.withColumn("_row", F.monotonically_increasing_id()).repartition("_row")
    per_link = _with_targets(resolved_links(parted), surface_redirects)
    own = entry_sql("display_url", "text", "dom_index", 0)
    hidden = ("transform(targets, "
              + lam(lambda t, i: entry_sql(t, "text", "dom_index", f"{i} + 1", "true", "display_url"), 2)
              + ")")
    per_link = per_link.select(
        "_row", *PAGE_COLS, "link_idx",
        F.expr(f"CASE WHEN keep THEN concat(array({own}), {hidden}) END").alias("_ents"))
    per_page = per_link.groupBy("_row").agg(
        *(F.first(c).alias(c) for c in PAGE_COLS),
        F.expr("flatten(transform(array_sort(collect_list(CASE WHEN _ents IS NOT NULL "
               "THEN struct(link_idx, _ents) END)), x -> x._ents))").alias("_flat"))
    numbered = ("transform(_flat, " + lam(lambda e, i: entry_sql(
        f"{e}.display_url", f"{e}.text", f"{e}.dom_index", f"{e}.variant_index",
        f"{e}.surfaced", f"{e}.source_url", pos=i), 2) + ")")
    return per_page.select(*PAGE_COLS, F.expr(numbered).alias("entries"))


def explode_entries(pages: DataFrame, col: str = "entries") -> DataFrame:
    """Nested entries -> one row per entry (canonical ``entries`` schema)."""
    keep = [c for c in pages.columns if c != col]
    return pages.select(*keep, F.explode(col).alias("_e")).select(
        *keep, *[F.col("_e")[f].alias(f) for f in ENTRY_FIELDS])
