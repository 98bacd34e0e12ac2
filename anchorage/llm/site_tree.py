"""Operator 12, main text of web pages: site style trees.

The pages of a host are merged into one tree: elements with the same path of tags, classes and ids
are one node.  A node's importance is made of two entropies over the pages that have it:

- presentation: how evenly its styles (the tags inside the element) are spread; one style everywhere says nothing;
- content: how far its texts are particular to pages; a text on every page has entropy 1, its node importance 0.

Branches of low importance are removed from each page; so are, at the source, those whose names say that they are menus, footers,
adverts and the like (``html_blocks``): their texts may differ on every page, which entropy alone would take for content.

The pages are parsed once in the tasks; the tree is aggregates in Spark over (host, node, text) keys, so a host that has a third of all pages
is partly aggregated in every task and never in one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorage.llm.html_blocks import blocks_of
from anchorage.session import materialize

GAMMA = 0.9
THRESHOLD = 0.2
LEAST_PAGES = 8  # a node of fewer pages is not judged by entropy
HELD = 1 << 18  # unimportant nodes that are broadcast; more are joined
_SALTS = 64
_BLOCKS = pa.list_(pa.struct([("path", pa.int64()), ("style", pa.int64()), ("text", pa.string())]))
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/?#:]+)"


def parsed_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, host, blocks): the block texts of each page, in order, with the keys of their nodes; host null without one."""
    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for k in range(0, batch.num_rows, 64):  # a few pages at a time
                some = batch.slice(k, 64)
                blocks = [[b._asdict() for b in blocks_of(h.as_py())] for h in some.column(3)]
                yield pa.RecordBatch.from_arrays([*(some.column(i) for i in range(3)), pa.array(blocks, _BLOCKS)],
                                                 names=["page_id", "url", "host", "blocks"])

    url = F.col(url_col).cast("string")
    host = F.lower(F.nullif(F.regexp_extract(url, _HOST, 1), F.lit("")))
    return pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"),
                        F.when(host.isNotNull(), F.xxhash64(host)).alias("host"), F.col(html_col).cast("string").alias("html")).mapInArrow(
        batches, "page_id long, url string, host long, blocks array<struct<path:long,style:long,text:string>>")


def node_importance(parsed: DataFrame, gamma: float = GAMMA) -> DataFrame:
    """(host, path, pages, presentation, content, importance) of the nodes of all hosts.

    With ``l`` styles, importance is ``(1 - gamma ** l) * presentation + gamma ** l * content``.  A node on one page has importance 1.
    """
    def marks(kind: int, value) -> F.Column:
        return F.transform("blocks", lambda b: F.struct(F.lit(kind).alias("kind"), b["path"].alias("path"), value(b).alias("value")))

    seen = (parsed.where("host is not null")
            .select("host", F.explode(F.array_distinct(F.concat(
                marks(0, lambda b: F.lit(0).cast("long")), marks(1, lambda b: F.xxhash64(b["text"])), marks(2, lambda b: b["style"])))).alias("m"))
            .groupBy("host", "m.path", "m.kind", "m.value").agg(F.count(F.lit(1)).alias("n")))

    def of(kind: int, value) -> F.Column:
        return F.when(F.col("kind") == kind, value)

    n = F.col("n").cast("double")
    nodes = seen.groupBy("host", "path").agg(
        F.max(of(0, F.col("n"))).alias("pages"), F.avg(of(1, F.ln(n))).alias("spread"),
        F.count(of(2, n)).alias("styles"), F.sum(of(2, n)).alias("shown"), F.sum(of(2, n * F.ln(n))).alias("shown_ln"))
    log_pages, many = F.ln(F.col("pages").cast("double")), F.col("pages") > 1
    weight = F.pow(F.lit(gamma), F.col("styles"))
    return (nodes.withColumn("presentation", F.when(many, (F.ln("shown") - F.col("shown_ln") / F.col("shown")) / log_pages).otherwise(1.0))
            .withColumn("content", F.when(many, 1 - F.col("spread") / log_pages).otherwise(1.0))
            .select("host", "path", "pages", "presentation", "content",
                    ((1 - weight) * F.col("presentation") + weight * F.col("content")).alias("importance")))


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", threshold: float = THRESHOLD,
               least_pages: int = LEAST_PAGES, held: int = HELD) -> DataFrame:
    """(page_id, url, text, n_chars), one row per row of ``pages``: block texts joined by line feeds.

    Null or empty HTML, and a page without main text, give '' and 0.  A page of which all branches are unimportant keeps them: its host has
    nothing but copies of it.  A page without a host in its URL is judged by names alone.  Repeated rows and null ids are rows of their own; other
    columns are not read.  A very long page is parsed by one task, in linear time.  An empty table gives no rows.
    """
    parsed = materialize(parsed_pages(pages, id_col, url_col, html_col).withColumn("row", F.monotonically_increasing_id()), "llm", "parsed")
    low = materialize(node_importance(parsed).where((F.col("pages") >= least_pages) & (F.col("importance") < threshold))
                      .select("host", "path"), "llm", "unimportant")
    if low.limit(held + 1).count() <= held:
        judged = parsed.join(F.broadcast(low.groupBy("host").agg(F.collect_list("path").alias("low"))), "host", "left")
    else:  # by page and node, salted: a node may be on a third of all pages
        salts = F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt")
        on_page = parsed.where("host is not null").select("row", "host", (F.col("row") % _SALTS).cast("int").alias("salt"),
                                                          F.explode(F.array_distinct("blocks.path")).alias("path"))
        of_row = (on_page.join(low.select("*", salts).hint("merge"), ["host", "path", "salt"])
                  .groupBy("row").agg(F.collect_list("path").alias("low")))
        judged = parsed.join(of_row.hint("merge"), "row", "left")
    low_paths = F.coalesce("low", F.array().cast("array<long>"))
    kept = F.filter("blocks", lambda b: ~F.array_contains(low_paths, b["path"]))
    texts = F.transform(F.when(F.size(kept) > 0, kept).otherwise(F.col("blocks")), lambda b: b["text"])
    return (judged.withColumn("text", F.array_join(texts, "\n"))
            .select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars")))


def op12_site_style_tree(spark, sf_dir: str) -> DataFrame:
    return main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet"))


#: The given pages hold their text in one article of headings and paragraphs; their references are few.
OP12_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(html, '(?s)<article>(.*?)</article>', 1) AS body FROM pages),
b AS (SELECT page_id, url, unnest(string_split_regex(body, '</?(?:h1|p)>')) AS raw, generate_subscripts(string_split_regex(body, '</?(?:h1|p)>'), 1) AS k FROM a),
t AS (
  SELECT page_id, url, k, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
           regexp_replace(regexp_replace(raw, '<br>', ' ', 'g'), '<[^>]*>', '', 'g'),
           '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS block FROM b),
j AS (SELECT page_id, url, string_agg(block, chr(10) ORDER BY k) FILTER (WHERE block <> '') AS text FROM t GROUP BY page_id, url)
SELECT p.page_id, p.url, coalesce(j.text, '') AS text, length(coalesce(j.text, ''))::BIGINT AS n_chars
FROM pages p LEFT JOIN j ON p.page_id = j.page_id AND p.url = j.url"""
