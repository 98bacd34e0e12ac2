"""E1 getVisibleEntries over a table of pages, and J4 (many profiles).

Input: nested per-page entries (``operators.entries.link_entries``).
filter -> de-duplicate -> order -> format -> hint, all inside the page
row: no shuffle after the entries are built.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from anchorage.functions.jsregex import InvalidPattern, to_java
from anchorage.functions.sql import lam, lit
from anchorage.functions.urls import js_trim_sql
from anchorage.operators.entries import ENTRY_FIELDS
from anchorage.operators.filters import BLANKS, compile_filter, no_match_hint
from anchorage.operators.order import dedup_sql, sort_sql
from anchorage.operators.report import (
    NO_LINKS_HINT, format_url_sql, line_count_sql, nonblank_line_count_sql, plain_text_sql,
    summary_sql,
)
from anchorage.settings import Settings


def visible_sql(spark: SparkSession, s: Settings, arr: str = "entries"):
    """(visible array SQL, errors, hint-if-filtered-out) for one settings record."""
    cf = compile_filter(spark, s)
    pred = lam(lambda e: cf.predicate(f"{e}.display_url", f"{e}.text"))
    filtered = f"filter({arr}, {pred})" if pred.split("-> ", 1)[1] != "true" else arr
    return sort_sql(dedup_sql(filtered), s.sort_mode), list(cf.errors), no_match_hint(s, cf.invalid_labels)


def visible_pages(spark: SparkSession, pages: DataFrame, s: Settings) -> DataFrame:
    """One row per page: visible entries, text, line counts, hint, message."""
    vis, errors, hint_filtered = visible_sql(spark, s)
    df = pages.select("page_id", "page_url", "title",
                      F.size("entries").cast("bigint").alias("n_source"), F.expr(vis).alias("visible"))
    df = df.withColumn("text", F.expr(plain_text_sql("visible", s.decode_urls)))
    hint = (f"CASE WHEN size(visible) > 0 THEN '' WHEN n_source = 0 THEN {lit(NO_LINKS_HINT)} "
            f"ELSE {lit(hint_filtered)} END")
    df = df.withColumn("hint", F.expr(hint))
    df = df.withColumn("lines", F.expr(line_count_sql("text")).cast("bigint"))
    first_error = lit(errors[0]) if errors else "NULL"
    message = (f"coalesce({first_error}, nullif(hint, ''), "
               f"concat(CAST(lines AS STRING), ' clean lines ready for copy or export.'))")
    return df.select(
        "page_id", "page_url", "title", "n_source", "visible", "text", "hint",
        F.lit(errors).cast("array<string>").alias("errors"),
        F.size("visible").cast("bigint").alias("n_visible"),
        "lines",
        F.expr(nonblank_line_count_sql("text")).cast("bigint").alias("nonblank_lines"),
        F.expr(summary_sql("size(visible)", "title", "page_url")).alias("summary"),
        F.expr(message).alias("message"),
        F.col("page_url").startswith("file:").alias("is_local_file"),
    )


def visible_links(spark: SparkSession, pages: DataFrame, s: Settings) -> DataFrame:
    """E1 as rows: page_id, rank (1-based display order) and the entry."""
    vis, _, _ = visible_sql(spark, s)
    fields = [f for f in ENTRY_FIELDS if f != "pos"]
    return (
        pages.select("page_id", F.posexplode(F.expr(vis)).alias("_i", "_e"))
        .select("page_id", (F.col("_i") + 1).cast("bigint").alias("rank"),
                *[F.col(f"_e.{f}").alias(f) for f in fields],
                F.expr(format_url_sql("_e.display_url", s.decode_urls)).alias("url"))
    )


def profile_apply(spark: SparkSession, pages: DataFrame, profiles: dict[str, Settings]) -> DataFrame:
    """Many saved filter profiles over all pages in one pass.

    The profiles are configuration (bounded, validated on the driver like
    the reference compiles its matchers once); each becomes literal
    predicates, so every page row yields one visible array per profile:
    no join, no shuffle.
    """
    arrays = []
    for pid, s in profiles.items():
        vis, _, _ = visible_sql(spark, s)
        arrays.append(f"struct({lit(pid)} AS profile_id, {vis} AS v, {lit(s.decode_urls)} AS d)")
    per = pages.select("page_id", F.explode(F.expr("array(" + ", ".join(arrays) + ")")).alias("_p"))
    return (
        per.select("page_id", "_p.profile_id", F.posexplode("_p.v").alias("_i", "_e"), "_p.d")
        .select("profile_id", "page_id", (F.col("_i") + 1).cast("bigint").alias("rank"),
                F.expr(f"CASE WHEN d THEN {format_url_sql('_e.display_url', True)} "
                       "ELSE _e.display_url END").alias("url"),
                F.col("_e.text").alias("text"), F.col("_e.surfaced").alias("surfaced"))
    )


def _terms_sql(c: str) -> str:
    """U2 on a column: terms of a plain pattern."""
    return f"filter(transform(split(lower({c}), ','), t -> {js_trim_sql('t')}), t -> t <> '')"


@F.pandas_udf(StringType())
def _java_patterns(patterns: pd.Series) -> pd.Series:
    """F5/F6 on a column: the Java form of a pattern; null of a blank or invalid one, which filters nothing."""
    def one(pattern):
        try:
            return to_java(pattern) if pattern and pattern.strip(BLANKS) else None
        except InvalidPattern:
            return None
    return patterns.map(one)


def profile_join(pages: DataFrame, settings: DataFrame, requests: DataFrame, key: str = "profile_id") -> DataFrame:
    """J4 for a table of stored settings of any size: each profile on the pages it asks for.

    ``settings`` as ``operators.store.merge_settings`` returns them, ``requests(<key>, page_id)`` distinct.  Settings
    and pages are joined to the requests, and each row evaluates its own patterns: nothing is collected,
    and a page that many profiles ask for is a skewed join that Spark splits.
    """
    names = ("urlIncludePattern", "urlExcludePattern", "textIncludePattern", "textExcludePattern")
    rules = settings.select(key, "sortMode", "useRegex", "decodeUrls",
                            *(F.expr(_terms_sql(c)).alias(f"_t_{c}") for c in names),
                            *(_java_patterns(F.when(F.col("useRegex"), F.col(c))).alias(f"_r_{c}") for c in names))

    def rule(c: str) -> str:
        v = "coalesce(e.display_url, '')" if c.startswith("url") else "coalesce(e.text, '')"
        no = "NOT " if "Exclude" in c else ""
        return (f"CASE WHEN useRegex THEN _r_{c} IS NULL OR {no}({v} RLIKE _r_{c}) "
                f"ELSE size(_t_{c}) = 0 OR {no}exists(_t_{c}, t -> contains(lower({v}), t)) END")

    found = (requests.join(rules, key).join(pages.select("page_id", "entries"), "page_id")
             .withColumn("_v", F.expr(f"filter(entries, e -> {' AND '.join(map(rule, names))})"))
             .withColumn("_v", F.expr(dedup_sql("_v")))
             .withColumn("_v", F.expr(f"CASE WHEN sortMode = 'alphabetical' THEN {sort_sql('_v', 'alphabetical')} "
                                      f"ELSE {sort_sql('_v', 'original')} END")))
    return found.select(key, "page_id", "decodeUrls", F.posexplode("_v").alias("_i", "_e")).select(
        key, "page_id", (F.col("_i") + 1).cast("bigint").alias("rank"),
        F.expr(f"CASE WHEN decodeUrls THEN {format_url_sql('_e.display_url', True)} ELSE _e.display_url END").alias("url"),
        F.col("_e.text").alias("text"), F.col("_e.surfaced").alias("surfaced"))
