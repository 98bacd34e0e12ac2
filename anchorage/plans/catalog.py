"""Query catalogue: each function takes (spark, sf_dir) and returns a
DataFrame over the given tables (see ``__spark_entry__``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anchorage.functions.text import clean_text
from anchorage.operators.entries import explode_entries, link_entries, page_bases, resolved_links
from anchorage.operators.first_seen import add_first_seen, first_seen
from anchorage.operators.order import dedup_corpus
from anchorage.operators.report import csv_document_sql, export_name_sql, settings_summary_sql
from anchorage.operators import store as S
from anchorage.plans.visible import visible_links, visible_pages
from anchorage.session import materialize, shared_dir
from anchorage.settings import Settings
from anchorage.streaming.jobs import stream_extract, stream_refresh
from anchorage.functions.redirects import url_params_sql
from anchorage.functions.urls import is_skipped
from anchorage.operators.export import CSV_COLUMNS, read_csv, read_txt, write_csv, write_txt
from anchorage.operators.order import dedup_page
from anchorage.operators.report import csv_row_sql
from anchorage.plans.visible import profile_apply, profile_join
from anchorage.plans.wrapped import read_wrapped
from anchorage.sources.pages import from_snapshots, read_pages, scan_html


def _pages(spark, sf_dir):
    return read_pages(spark, f"{sf_dir}/pages.parquet")


def page_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested entries of every page (scan -> entries)."""
    return link_entries(scan_html(_pages(spark, sf_dir)))


def q_anchors(spark, sf_dir):
    scanned = scan_html(_pages(spark, sf_dir))
    return scanned.select("page_id", F.explode("links").alias("l")).select(
        "page_id", "l.dom_index", "l.href", "l.text")


def q_page_meta(spark, sf_dir):
    return page_bases(scan_html(_pages(spark, sf_dir))).select("page_id", "page_url", "title")


def q_entries(spark, sf_dir):
    return explode_entries(page_entries(spark, sf_dir)).drop("page_url", "title")


def q_resolved_links(spark, sf_dir):
    return resolved_links(scan_html(_pages(spark, sf_dir))).where("keep").select("page_id", "dom_index", "display_url", "text")


def _visible(settings):
    def q(spark, sf_dir):
        return visible_links(spark, page_entries(spark, sf_dir), settings)
    return q


def _report(settings, cols):
    def q(spark, sf_dir):
        return visible_pages(spark, page_entries(spark, sf_dir), settings).select(*cols)
    return q


REPORT_COLS = ("page_id", "n_source", "n_visible", "lines", "nonblank_lines", "hint",
               "summary", "message", "is_local_file")

SETTINGS = {
    "visible_links": Settings(),
    "sort_alpha": Settings(sort_mode="alphabetical"),
    "filter_url_terms": Settings(url_include="th, an"),
    "filter_url_exclude": Settings(url_exclude="the,,  er "),
    "filter_text_terms": Settings(text_include=" ou , Th"),
    "filter_text_exclude": Settings(text_exclude="e"),
    "filter_regex": Settings(use_regex=True, url_include=r"/[a-z]{2,4}$|a{|[[]"),
    "filter_invalid_regex": Settings(use_regex=True, url_include="[", text_exclude="^t"),
    "page_report": Settings(text_include="the"),
    "decode_urls": Settings(decode_urls=True),
}


def q_plain_text(spark, sf_dir):
    return visible_pages(spark, page_entries(spark, sf_dir), Settings()).select("page_id", "text", "lines")


def q_csv_document(spark, sf_dir):
    return page_entries(spark, sf_dir).select(
        "page_id", F.expr(csv_document_sql("entries", False)).alias("csv"))


def q_export_names(spark, sf_dir):
    s = Settings(url_include="github", text_include="Main Page", text_exclude="!!!")
    ents = scan_html(_pages(spark, sf_dir))
    return ents.select("page_id", F.expr(export_name_sql("title", s, "txt")).alias("txt_name"),
                       F.expr(export_name_sql("title", s, "csv")).alias("csv_name"))


def q_dedup_corpus(spark, sf_dir):
    return dedup_corpus(explode_entries(page_entries(spark, sf_dir)).select(
        "page_id", "pos", "display_url", "text"))


def q_clean_text(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", clean_text("text").alias("clean"))


def _saved(spark, sf_dir):
    """E2 extract job: every page saved as a result record (lazy)."""
    return S.save_results(page_entries(spark, sf_dir))


def _store(spark, sf_dir):
    """The saved results written once to the shared folder and read back
    (the store the later jobs work on; also cuts the lineage)."""
    return materialize(_saved(spark, sf_dir), "results")


def q_results_append(spark, sf_dir):
    return _saved(spark, sf_dir).select("sequence", "result_id", S.storage_key("result_id").alias("storage_key"),
                                        "source_id", "page_url", "title",
                                        F.size("entries").cast("bigint").alias("n_entries"))


def q_results_prune(spark, sf_dir):
    """E2 with its prune: the store after every page was saved."""
    store, _, _ = S.extract_job(page_entries(spark, sf_dir))
    return store.select("sequence", "result_id", "source_id")


def q_results_lookup(spark, sf_dir):
    saved = _store(spark, sf_dir).select("sequence", "result_id", "source_id", "page_url")
    return S.current_record(saved, S.current_of(saved))


def wrapped_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested entries of the wrapped links (snapshot path, redirects on)."""
    return link_entries(from_snapshots(read_wrapped(spark, sf_dir)))


def q_protocol_filter(spark, sf_dir):
    snap = read_wrapped(spark, sf_dir)
    return (snap.select("page_id", F.explode("links").alias("l"))
            .select("page_id", F.col("l.domIndex").alias("dom_index"), F.col("l.rawHref").alias("href"))
            .withColumn("skipped", is_skipped("href")))


def q_redirect_params(spark, sf_dir):
    links = resolved_links(from_snapshots(read_wrapped(spark, sf_dir))).where("keep")
    return links.select("page_id", "dom_index", F.posexplode(F.expr(url_params_sql("_p"))).alias("i", "p")) \
        .select("page_id", "dom_index", F.col("i").cast("bigint").alias("param_index"),
                F.col("p.key").alias("key"), F.col("p.value").alias("value"))


def q_redirect_targets(spark, sf_dir):
    ents = explode_entries(wrapped_entries(spark, sf_dir))
    return ents.where("surfaced").select("page_id", "dom_index", "variant_index",
                                         F.col("display_url").alias("target"),
                                         F.col("source_url").alias("wrapper"))


def q_wrapped_entries(spark, sf_dir):
    return explode_entries(wrapped_entries(spark, sf_dir)).drop("page_url", "title")


def _wrapped_visible(settings):
    def q(spark, sf_dir):
        return visible_links(spark, wrapped_entries(spark, sf_dir), settings)
    return q


def q_dedup_page(spark, sf_dir):
    return explode_entries(dedup_page(wrapped_entries(spark, sf_dir))).drop("page_url", "title")


def q_wrapped_dedup_corpus(spark, sf_dir):
    return dedup_corpus(explode_entries(wrapped_entries(spark, sf_dir)).select(
        "page_id", "pos", "display_url", "text"))


def q_dedup_corpus_runs(spark, sf_dir):
    """D2 across runs: odd pages first, then the even ones; the index of both is that of one run over all."""
    entries = materialize(explode_entries(wrapped_entries(spark, sf_dir)).select("page_id", "pos", "display_url", "text"), "first_seen_in")
    index = shared_dir(spark, "first_seen")
    for run, half in enumerate(("page_id % 2 = 1", "NOT coalesce(page_id % 2 = 1, false)")):
        add_first_seen(entries.where(half), index, run)
    return first_seen(spark, index)


def q_csv_rows(spark, sf_dir):
    vis = visible_pages(spark, wrapped_entries(spark, sf_dir), Settings(decode_urls=True))
    return vis.select("page_id", F.posexplode(F.expr(
        f"transform(visible, e -> {csv_row_sql('e', True)})")).alias("i", "line")).select(
        "page_id", (F.col("i") + 1).cast("bigint").alias("rank"), "line")


def q_profile_apply(spark, sf_dir):
    return profile_apply(spark, wrapped_entries(spark, sf_dir), PROFILES)


PROFILES = {
    "default": Settings(),
    "targets_only": Settings(url_exclude="go.example, files"),
    "alpha_items": Settings(sort_mode="alphabetical", text_include="item"),
    "regex_decode": Settings(use_regex=True, url_include=r"^https://(go|files)\.", decode_urls=True),
}


def q_stream_extract(spark, sf_dir):
    return stream_extract(spark, sf_dir, "pages.parquet")


def q_stream_refresh(spark, sf_dir):
    return stream_refresh(spark, sf_dir).select(
        "result_id", "sequence", "source_id", F.size("entries").cast("bigint").alias("n_entries"),
        "refreshed_at", "n_requests")


def _store_and_updates(spark, sf_dir):
    saved = _store(spark, sf_dir).select("sequence", "result_id", "source_id", "page_url", "title")
    # updates: every record whose title has a '&' gets a new title, plus
    # one request per record for an id past the end (reported missing)
    n = saved.count()
    upd = saved.where(F.col("title").contains("&")).select(
        "result_id", F.explode(F.array(F.lit(" (draft)"), F.lit(" (updated)"))).alias("_mark"), "title").select(
        "result_id", F.concat("title", "_mark").alias("title"), F.when(F.col("_mark") == " (draft)", 1).otherwise(2).alias("at"))
    missing = saved.select(F.concat(F.lit("result-"), (F.col("sequence") + F.lit(n)).cast("string"))
                           .alias("result_id"), F.lit("x").alias("title"), F.lit(1).alias("at"))
    return saved, upd.unionByName(missing)


def q_results_update(spark, sf_dir):
    saved, updates = _store_and_updates(spark, sf_dir)
    merged, errors = S.update_results(saved, updates, order="at")
    return merged.select("result_id", "sequence", "source_id", "page_url", "title",
                         F.lit(None).cast("string").alias("error")).unionByName(
        errors.select("result_id", F.lit(None).cast("bigint").alias("sequence"),
                      F.lit(None).cast("bigint").alias("source_id"),
                      F.lit(None).cast("string").alias("page_url"),
                      F.lit(None).cast("string").alias("title"), "error"))


def q_results_refresh(spark, sf_dir):
    """E3 for every saved record: re-scan its page, overlay entries; every tenth page is gone."""
    pages = _pages(spark, sf_dir).where("page_id % 10 <> 0")
    saved = _store(spark, sf_dir)
    store, errors = S.refresh_results(saved, pages, saved.select("result_id"))
    return store.select("result_id", "sequence", "source_id",
                        F.size("entries").cast("bigint").alias("n_entries")).join(
        errors, "result_id", "left")


def q_txt_export(spark, sf_dir):
    """K1 round trip: write the wrapped visible links, read the rows back."""
    s = Settings(decode_urls=True)
    path = shared_dir(spark, "txt_export")
    write_txt(visible_pages(spark, wrapped_entries(spark, sf_dir), s), s, path)
    return read_txt(spark, path)


def q_csv_export(spark, sf_dir):
    """K2 round trip: CSV written with the reference's quoting, read back."""
    s = Settings(decode_urls=True)
    path = shared_dir(spark, "csv_export")
    write_csv(visible_pages(spark, wrapped_entries(spark, sf_dir), s), s, path)
    back = read_csv(spark, path)
    return back.select(F.col("page_id").cast("bigint"), F.col("rank").cast("bigint"), "export_name",
                       *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in CSV_COLUMNS])


def q_snapshot_source(spark, sf_dir):
    """S4 fallbacks: which snapshot fields a page has goes by its id."""
    k = F.col("page_id") % 4
    link = ("named_struct('domIndex', IF(page_id % 4 = 0, CAST(i * 10 AS BIGINT), NULL), 'resolvedHref', IF(page_id % 4 < 2, l.href, ''), "
            "'rawHref', IF(page_id % 4 = 2, l.href, NULL), 'href', IF(page_id % 4 = 3, l.href, 'unused'), 'text', IF(page_id % 4 = 3, NULL, l.text))")
    snaps = scan_html(_pages(spark, sf_dir)).select(
        "page_id", F.when(k < 3, F.col("page_url")).alias("pageUrl"), F.when(k != 1, F.col("page_url")).alias("url"),
        F.when(k != 2, F.col("title")).alias("title"), F.expr(f"IF(page_id % 8 = 5, NULL, transform(links, (l, i) -> {link}))").alias("links"))
    return from_snapshots(snaps).select("page_id", "page_url", "title", F.explode_outer("links").alias("l")).select(
        "page_id", "page_url", "title", "l.dom_index", "l.href", "l.text")


def _user_settings(spark, sf_dir):
    """Stored settings of every user in ``events``: the latest event says how links are sorted, decoded and filtered."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    last = events.groupBy("user_id").agg(F.max_by(F.struct("event_type", "props", "value"), F.struct("ts", "event_id")).alias("e"))
    n = "regexp_extract(e.props, '([0-9]+)', 1)"
    return last.selectExpr(
        "user_id AS profile_id", "CASE e.event_type WHEN 'view' THEN 'original' WHEN 'click' THEN 'alphabetical' ELSE e.event_type END AS sortMode",
        "CASE e.event_type WHEN 'signup' THEN 'dark' WHEN 'error' THEN 'neon' END AS themeMode",
        f"IF({n} % 3 = 0, {n}, '\t ') AS urlIncludePattern", f"IF({n} % 2 = 0, concat('local, ', {n}), NULL) AS urlExcludePattern",
        f"IF({n} % 5 = 0, 'item', '') AS textIncludePattern", "IF(e.value > 20, 'x', '') AS useRegex", "e.value - 5 AS decodeUrls")


def q_settings_merge(spark, sf_dir):
    return S.merge_settings(_user_settings(spark, sf_dir))


def q_settings_save(spark, sf_dir):
    """K7: each user's last purchase changes some of the stored settings."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type = 'purchase'")
    last = events.groupBy("user_id").agg(F.max_by(F.struct("props", "value"), F.struct("ts", "event_id")).alias("e"))
    partial = last.selectExpr(
        "user_id AS profile_id", "IF(e.value > 20, 'alphabetical', NULL) AS sortMode",
        "concat('p', regexp_extract(e.props, '([0-9]+)', 1)) AS urlExcludePattern", "e.value < 10 AS useRegex")
    return S.save_settings(_user_settings(spark, sf_dir), partial)


def q_settings_reset(spark, sf_dir):
    return S.reset_filters(q_settings_merge(spark, sf_dir))


def q_results_by_id(spark, sf_dir):
    """S6 for the ids that events name, known or not."""
    n_pages = _pages(spark, sf_dir).count()  # one scalar
    ids = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.concat(F.lit("result-"), (F.col("event_id") % (2 * n_pages)).cast("string")).alias("result_id")).distinct()
    return S.lookup_many(_store(spark, sf_dir), ids).select("result_id", "sequence", "source_id", "page_url")


def q_settings_summary(spark, sf_dir):
    return q_settings_merge(spark, sf_dir).select("profile_id", F.expr(settings_summary_sql()).alias("summary"))


def q_profile_table(spark, sf_dir):
    """J4 from a table: every user's stored settings on the pages their events name."""
    n_pages = _pages(spark, sf_dir).count()  # one scalar
    requests = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("user_id").alias("profile_id"), (F.col("event_id") % n_pages).alias("page_id")).distinct()
    return profile_join(wrapped_entries(spark, sf_dir), q_settings_merge(spark, sf_dir), requests)


def q_html_variants(spark, sf_dir):
    """S2-S5, U7 on odd markup built from every page: titles and anchors in comments and scripts, a base, quotes, references,
    hosts in other forms, pages without links."""
    pages = _pages(spark, sf_dir).select("page_id", F.lit("https://site.example/a/b").alias("url"), F.expr("""CASE page_id % 3
        WHEN 0 THEN concat('<!-- <title>no</title><a href=/no>no</a> --><title>T&eacute; &#', page_id % 90 + 33, '; &#x0041</title>',
            '<script>"<a href=/no>"</script><base href="../c/"><A title=">" HREF=\\'x?a=1&amp;copy=', page_id, '&copy=2\\'>one&nbsp&lt;b&gt;</A>')
        WHEN 1 THEN concat('<title>', page_id, '</title><p>no links &amp <a name=x>none</a>')
        ELSE concat('<a href="https://M\u00fcnchen.example/', page_id, '">idn</a><a href="http://[2001:DB8:0:0:0:0:0:', page_id % 10, ']/">six</a>',
            '<a href="http://0x7f.1/', page_id, '">&#146;four</a><a href="http://0xfffffffffffffffff/">bad</a><a href="javascript:void(0)">skip</a>') END""").alias("html"))
    found = link_entries(scan_html(pages))
    return found.select("page_id", "page_url", "title", F.explode_outer("entries").alias("e")).select(
        "page_id", "page_url", "title", "e.dom_index", "e.display_url", "e.text")


ODD_MARKUP = """<p title="<a href=/no>z</a>">q</p><!--> <a href="/1" title="<!-- x">one </a><!-- a --!><a href="/2" data-t="<script>">o<img alt="x > y">ne</a>
<a href=/3>1<2 and 3>2<script>"<a href=/no>"</script></a><a title"x href=/q?a="4>&am<b>p;</a><script>'<a href=/no>'</script><a href='/5'>"""


def q_html_markup(spark, sf_dir):
    """S2, S3 on every page's own markup behind a row of quoted, commented and broken markup."""
    pages = _pages(spark, sf_dir).withColumn("html", F.concat(F.lit(ODD_MARKUP), F.col("page_id").cast("string"), F.lit("</a>"), "html"))
    return scan_html(pages).select("page_id", "title", F.explode("links").alias("l")).select("page_id", "title", "l.*")


#: Hosts beyond ASCII and what UTS #46 makes of them.
IDN_HOSTS = ("straße.example", "Bücher.example", "日本。jp", "ü" * 70 + ".example", "Ａ.example", "ẞ.example", "e\u0301.example")


def q_idn_hosts(spark, sf_dir):
    """Links of every page to hosts beyond ASCII."""
    anchors = "".join(f"<a href='http://{h}/{{id}}'>x</a>" for h in IDN_HOSTS)
    pages = _pages(spark, sf_dir).select("page_id", "url", F.replace(F.lit(anchors), F.lit("{id}"), F.col("page_id").cast("string")).alias("html"))
    return explode_entries(link_entries(scan_html(pages))).select("page_id", "dom_index", "display_url")


def q_extract_again(spark, sf_dir):
    """E2 twice: every page is saved, then nothing; the current record and the last number stay."""
    store, current, sequence = S.extract_job(page_entries(spark, sf_dir))
    last = sequence.first()["last"]
    again, current, sequence = S.extract_job(page_entries(spark, sf_dir).where("false"), store, last, current=current)
    return again.select("result_id", "sequence").crossJoin(F.broadcast(current.select(F.col("result_id").alias("current")))).crossJoin(
        F.broadcast(sequence))


QUERIES = {
    "anchors": q_anchors,
    "page_meta": q_page_meta,
    "resolved_links": q_resolved_links,
    "entries": q_entries,
    "plain_text": q_plain_text,
    "csv_document": q_csv_document,
    "export_names": q_export_names,
    "dedup_corpus": q_dedup_corpus,
    "clean_text": q_clean_text,
    "results_append": q_results_append,
    "results_prune": q_results_prune,
    "results_lookup": q_results_lookup,
    "page_report": _report(SETTINGS["page_report"], REPORT_COLS),
    "filter_invalid_regex": _report(SETTINGS["filter_invalid_regex"],
                                    ("page_id", "n_visible", "hint", "message")),
}
QUERIES.update({
    "snapshot_source": q_snapshot_source,
    "settings_merge": q_settings_merge,
    "settings_summary": q_settings_summary,
    "profile_table": q_profile_table,
    "settings_save": q_settings_save,
    "settings_reset": q_settings_reset,
    "results_by_id": q_results_by_id,
    "html_variants": q_html_variants,
    "html_markup": q_html_markup,
    "idn_hosts": q_idn_hosts,
    "extract_again": q_extract_again,
    "txt_export": q_txt_export,
    "csv_export": q_csv_export,
    "stream_extract": q_stream_extract,
    "stream_refresh": q_stream_refresh,
    "results_update": q_results_update,
    "results_refresh": q_results_refresh,
    "protocol_filter": q_protocol_filter,
    "redirect_params": q_redirect_params,
    "redirect_targets": q_redirect_targets,
    "wrapped_entries": q_wrapped_entries,
    "dedup_page": q_dedup_page,
    "wrapped_dedup_corpus": q_wrapped_dedup_corpus,
    "dedup_corpus_runs": q_dedup_corpus_runs,
    "csv_rows": q_csv_rows,
    "profile_apply": q_profile_apply,
    "sort_original": _wrapped_visible(Settings(sort_mode="original")),
    "filter_all": _wrapped_visible(Settings(url_include="example", url_exclude="local",
                                            text_include="item, again", text_exclude="8")),
    "wrapped_decode_urls": _wrapped_visible(Settings(decode_urls=True, sort_mode="alphabetical")),
})
for _k in ("visible_links", "sort_alpha", "filter_url_terms", "filter_url_exclude",
           "filter_text_terms", "filter_text_exclude", "filter_regex", "decode_urls"):
    QUERIES[_k] = _visible(SETTINGS[_k])
