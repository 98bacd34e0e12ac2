"""Sinks K1 (TXT) and K2 (CSV) for visible links.

The reference downloads one file per page.  At corpus scale one folder per
page is a small-files problem, so the default writes one file per task whose
rows name page, rank and export file; with ``per_page=True`` the rows are
written under ``page_id=<id>`` folders (for small selections).  Input is the
per-page frame of ``plans.visible.visible_pages``: no join, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorage.operators.report import CSV_HEADER, export_name_sql, format_url_sql
from anchorage.settings import Settings

CSV_COLUMNS = CSV_HEADER.split(",")


def _rows(pages: DataFrame, s: Settings, ext: str) -> DataFrame:
    """Visible pages (``plans.visible.visible_pages``) -> one row per link
    with the page's export file name (computed once per page row)."""
    fields = ("display_url", "text", "surfaced", "source_url")
    return (
        pages.select("page_id", F.expr(export_name_sql("title", s, ext)).alias("export_name"),
                     F.posexplode("visible").alias("_i", "_e"))
        .select("page_id", (F.col("_i") + 1).cast("bigint").alias("rank"), "export_name",
                *[F.col(f"_e.{f}").alias(f) for f in fields])
    )


def _url(s: Settings, col: str = "display_url") -> F.Column:
    return F.expr(format_url_sql(col, s.decode_urls))


def write_txt(pages: DataFrame, s: Settings, path: str, per_page: bool = False) -> None:
    """K1: text files of one formatted URL per line, in display order.

    A line is ``page_id <tab> rank <tab> export name <tab> URL``; in the URL a backslash is ``\\0`` and a line feed ``\\n``.  A page's lines are
    together in the one file of its task, so the number of files goes by tasks, not by pages or names.  With ``per_page=True``
    lines are plain URLs, in folders named by page and export name.
    """
    df = _rows(pages, s, "txt").select("page_id", "rank", "export_name", _url(s).alias("url"))
    if per_page:
        keys = ["page_id", "export_name"]
        (df.repartition("page_id").sortWithinPartitions(*keys, "rank")
         .select(*keys, "url").write.mode("overwrite").partitionBy(*keys).text(path))
        return
    url = F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\\"), F.lit("\\0")), F.lit("\n"), F.lit("\\n"))
    line = F.concat_ws("\t", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.col("rank").cast("string"), "export_name", url)
    df.select(line.alias("value")).write.mode("overwrite").option("lineSep", "\n").text(path)


def read_txt(spark, path: str, per_page: bool = False) -> DataFrame:
    """Files of ``write_txt``: page_id, rank, export_name, url; with ``per_page=True`` the folders give page and name."""
    if per_page:
        files = spark.read.text(path, wholetext=True)
        return files.select("page_id", "export_name", F.posexplode(F.split(F.regexp_replace("value", "\\n$", ""), "\n")).alias("i", "url")) \
            .select(F.col("page_id").cast("bigint").alias("page_id"), (F.col("i") + 1).cast("bigint").alias("rank"), "export_name", "url")
    v = spark.read.text(path, lineSep="\n").select(F.split("value", "\t", 4).alias("v")).select(*(F.col("v")[k].alias(f"v{k}") for k in range(4)))
    return v.select(F.nullif("v0", F.lit("")).cast("bigint").alias("page_id"), F.col("v1").cast("bigint").alias("rank"), F.col("v2").alias("export_name"),
                    F.replace(F.replace("v3", F.lit("\\n"), F.lit("\n")), F.lit("\\0"), F.lit("\\")).alias("url"))


def csv_frame(pages: DataFrame, s: Settings) -> DataFrame:
    """P6 columns of the CSV export (values formatted, not yet escaped)."""
    src = f"CASE WHEN surfaced THEN {format_url_sql('coalesce(source_url, ' + chr(39) * 2 + ')', s.decode_urls)} ELSE '' END"
    return _rows(pages, s, "csv").select(
        "page_id", "rank", "export_name", _url(s).alias("url"),
        F.coalesce("text", F.lit("")).alias("link_text"),
        F.when(F.col("surfaced"), F.lit("true")).otherwise(F.lit("false")).alias("is_redirect"),
        F.expr(src).alias("redirect_source"))


def write_csv(pages: DataFrame, s: Settings, path: str, per_page: bool = False) -> None:
    """K2: header ``url,link_text,is_redirect,redirect_source``; a value is
    quoted only if it holds '"', ',' or a line break; quotes doubled."""
    df = csv_frame(pages, s).sortWithinPartitions("page_id", "rank")
    cols = (["page_id"] if per_page else ["page_id", "rank", "export_name"]) + CSV_COLUMNS
    writer = df.select(*cols).write.mode("overwrite").option("header", True) \
        .option("quote", '"').option("escape", '"').option("emptyValue", "") \
        .option("nullValue", "").option("ignoreLeadingWhiteSpace", False) \
        .option("ignoreTrailingWhiteSpace", False)
    if per_page:
        writer = writer.partitionBy("page_id")
    writer.csv(path)


def read_csv(spark, path: str) -> DataFrame:
    return (spark.read.option("header", True).option("quote", '"').option("escape", '"')
            .option("multiLine", True).option("ignoreLeadingWhiteSpace", False)
            .option("ignoreTrailingWhiteSpace", False).csv(path))
