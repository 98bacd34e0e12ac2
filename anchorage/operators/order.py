"""De-duplication (D1, D2) and ordering (O1, O2) of entries.

Per page, entries are one array per row, so both run as array functions
without a shuffle: de-duplication sorts by (URL, pos) and keeps the
first element of each run (n log n, not quadratic); ordering is one
``array_sort`` on a struct led by the sort keys, with the URL compared
under the ``UNICODE_CI_AI`` collation (ICU root, primary strength, like
``localeCompare(..., {sensitivity: 'base'})``).  Corpus-wide
de-duplication is a ``min_by`` aggregate (map-side partial aggregation,
so a URL repeated on every page costs one row per task before the
shuffle).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorage.functions.sql import lam, let

SORT_KEYS = {
    "original": ("{e}.dom_index", "{e}.variant_index", "collate({e}.display_url, 'UNICODE_CI_AI')", "{e}.pos"),
    "alphabetical": ("collate({e}.display_url, 'UNICODE_CI_AI')", "{e}.dom_index", "{e}.variant_index", "{e}.pos"),
}


def dedup_sql(arr: str) -> str:
    """deduplicateEntries: first entry (lowest pos) per display URL, in pos order."""
    def body(srt):
        keep = lam(lambda x, i: f"{i} = 0 OR NOT ({x}.k <=> element_at({srt}, {i}).k)", 2)
        firsts = f"filter({srt}, {keep})"
        return f"transform(array_sort(transform({firsts}, {lam(lambda x: f'struct({x}.p AS p, {x}.e AS e)')})), {lam(lambda x: f'{x}.e')})"
    keyed = f"transform({arr}, {lam(lambda e: f'struct({e}.display_url AS k, {e}.pos AS p, {e} AS e)')})"
    return let(f"array_sort({keyed})", body)


def sort_sql(arr: str, mode: str) -> str:
    """sortEntries: stable order for ``mode`` (unknown modes -> original)."""
    keys = SORT_KEYS.get(mode, SORT_KEYS["original"])

    def key_struct(e):
        fields = ", ".join(f"{k.format(e=e)} AS k{j}" for j, k in enumerate(keys))
        return f"struct({fields}, {e} AS e)"
    return f"transform(array_sort(transform({arr}, {lam(key_struct)})), {lam(lambda x: f'{x}.e')})"


def dedup_page(pages: DataFrame, col: str = "entries") -> DataFrame:
    """D1 on nested per-page entries."""
    return pages.withColumn(col, F.expr(dedup_sql(col)))


def sort_page(pages: DataFrame, mode: str, col: str = "entries") -> DataFrame:
    """O1 / O2 on nested per-page entries."""
    return pages.withColumn(col, F.expr(sort_sql(col, mode)))


def dedup_corpus(entries: DataFrame) -> DataFrame:
    """One row per display URL across all pages, the first page /
    position winning (``entries`` exploded)."""
    cols = [c for c in entries.columns if c != "display_url"]
    first = F.min_by(F.struct(*cols), F.struct("page_id", "pos"))
    return (entries.groupBy("display_url").agg(first.alias("_f"))
            .select("display_url", *[F.col(f"_f.{c}").alias(c) for c in cols]))
