"""Store and export-name cases from the reference's storage / helper tests."""

import pytest
from pyspark.sql import functions as F

from anchorage.operators import store as S
from anchorage.operators.report import export_name_sql
from anchorage.settings import Settings


def _store(spark, ids):
    return spark.createDataFrame([(i, f"T {i}") for i in ids], "result_id string, title string")


def _cur(spark, rid):
    return spark.createDataFrame([(rid,)], "result_id string")


def _kept(spark, ids, cur, n):
    kept = S.prune_results(_store(spark, ids), _cur(spark, cur), n)
    return sorted(r.result_id for r in kept.collect())


def test_prune(spark):
    ids = [f"result-{i}" for i in range(1, 56)]
    assert _kept(spark, ids, "result-55", 50) == sorted(ids[5:])
    assert _kept(spark, [f"result-{i}" for i in range(1, 5)], "result-2", 2) == ["result-2", "result-4"]
    assert _kept(spark, ["result-1", "result-2"], "result-2", 2) == ["result-1", "result-2"]
    assert _kept(spark, ["not-a-sequence", "result-1", "result-2"], None, 1) == ["not-a-sequence", "result-2"]
    assert _kept(spark, ["result-1"], "result-1", 0) == ["result-1"]


def test_update_and_lookup(spark):
    store = spark.createDataFrame([(3, "result-3", "Before", "https://before.example")],
                                  "sequence bigint, result_id string, title string, page_url string")
    upd = spark.createDataFrame([("result-3", "After", None), ("result-12", "Missing", None)],
                                "result_id string, title string, page_url string")
    merged, errors = S.update_results(store, upd)
    assert [(r.result_id, r.title, r.page_url) for r in merged.collect()] == [
        ("result-3", "After", "https://before.example")]
    assert [(r.result_id, r.error) for r in errors.collect()] == [("result-12", S.MISSING_RESULT_ERROR)]
    assert S.lookup(store, "result-404").count() == 0
    assert S.storage_key(F.lit("result-7")) is not None


def _pages(spark, n, ids="id"):
    return spark.range(n).selectExpr(f"{ids} AS page_id", "concat('https://e.example/', id) AS page_url", "repeat('t', 40) AS title",
                                     "array(named_struct('pos', id)) AS entries")


def test_saved_numbers_are_consecutive_and_never_used_again(spark):
    first = S.save_results(_pages(spark, 30_000))
    n = first.selectExpr("count(*) AS n", "count(distinct sequence) AS d", "min(sequence) AS a", "max(sequence) AS b").first()
    assert tuple(n) == (30_000, 30_000, 1, 30_000)
    assert [r.source_id for r in first.orderBy("sequence").limit(3).collect()] == [0, 1, 2]
    store, current, last = S.extract_job(_pages(spark, 3), max_results=1)
    assert [r.result_id for r in store.collect()] == ["result-3"] and last.first()["last"] == 3
    kept = S.prune_results(S.save_results(_pages(spark, 3)), _cur(spark, "result-1"), 1)
    assert [r.result_id for r in kept.collect()] == ["result-1"]
    again = S.save_results(_pages(spark, 1), kept, last=3)
    assert [r.result_id for r in again.collect()] == ["result-4"]


def test_pages_that_share_an_id_are_records_of_their_own(spark):
    rows = S.save_results(_pages(spark, 40, "IF(id % 4 = 0, NULL, 7)")).collect()
    assert len(rows) == 40 and sorted(r.sequence for r in rows) == list(range(1, 41))


def test_prune_keeps_the_newest_of_many(spark):
    store = spark.range(1, 300_001).selectExpr("concat('result-', id) AS result_id", "repeat('x', 30) AS title")
    kept = S.prune_results(store, _cur(spark, "result-300000"), 50)
    assert sorted(int(r.result_id[7:]) for r in kept.collect()) == list(range(299_951, 300_001))


def test_prune_counts_ids_of_any_length(spark):
    ids = ["result-" + "9" * 25, "result-1" + "0" * 30, "result-007", "result-8"]
    assert _kept(spark, ids, None, 2) == sorted(ids[:2])


def test_update_takes_one_row_for_an_id_and_knows_what_is_given(spark):
    store = spark.createDataFrame([(1, "result-1", "a", "u"), (2, "result-2", "b", "v")],
                                  "sequence bigint, result_id string, title string, page_url string")
    updates = spark.createDataFrame([("result-1", "x", None, 1, ["title"]), ("result-1", "y", None, 2, ["title", "page_url"]),
                                     ("result-9", "z", None, 3, ["title"]), ("result-9", "z", None, 4, ["title"])],
                                    "result_id string, title string, page_url string, at int, given array<string>")
    merged, errors = S.update_results(store, updates, order="at", given="given")
    assert sorted(map(tuple, merged.collect())) == [(1, "result-1", "y", None), (2, "result-2", "b", "v")]
    assert [r.result_id for r in errors.collect()] == ["result-9"]
    assert S.current_after_update(store, updates, "at", _cur(spark, "result-2")).first().result_id == "result-1"
    assert S.current_after_update(store, updates.where("at > 2"), "at", _cur(spark, "result-2")).first().result_id == "result-2"


def test_refresh_stream_in_many_batches_counts_every_request_once(spark, tmp_path):
    from anchorage.streaming import jobs
    sf = "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{sf}/events.parquet")
    requests, out = str(tmp_path / "requests"), str(tmp_path / "out")
    events.repartition(4).write.parquet(requests)
    got = jobs.stream_refresh(spark, sf, out, requests_dir=requests, files_per_batch=1)
    assert len([p for p in (tmp_path / "out" / "store").iterdir() if p.name.startswith("batch=")]) == 5
    n = events.count()
    assert got.selectExpr("sum(n_requests)").first()[0] == n
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    k = pages.count()
    again = events.limit(500).selectExpr(f"event_id % {k} AS page_id", "ts")
    for _ in range(2):  # a batch and its retry
        jobs.refresh_batch(spark, again, 4, pages.where("page_id > 5"), f"{out}/store")
    now = jobs.newest_records(spark, f"{out}/store")
    assert now.selectExpr("sum(n_requests)").first()[0] == n + 500
    assert now.where("page_url is null").count() == 0
    jobs.compact(spark, f"{out}/store", f"{out}/compact")
    assert jobs.newest_records(spark, f"{out}/compact").count() == k


def test_export_names(spark):
    df = spark.createDataFrame(
        [(1, "Project Links"), (2, "Wikipedia The Free Encyclopedia"), (3, "!!!"), (4, None), (5, "")],
        "id int, title string")

    def names(settings, ext="txt"):
        return [r[0] for r in df.orderBy("id").select(F.expr(export_name_sql("title", settings, ext))).collect()]

    assert names(Settings())[0] == "project-links-links.txt"
    assert names(Settings(url_include="github"))[1] == "wikipedia-the-free-encyclopedia-links-include-github.txt"
    assert names(Settings(url_include="!!!"), "???")[2] == "links-links-include-value.txt"
    assert names(Settings())[3:] == ["links-links.txt", "links-links.txt"]
    long = spark.createDataFrame(
        [("An Extremely Long Page Title That Should Be Truncated Before The Filter Suffixes Are Lost",)], "title string")
    s = Settings(url_include="wiki", url_exclude="Special:", text_include="featured articles",
                 text_exclude="Main Page")
    name = long.select(F.expr(export_name_sql("title", s))).first()[0]
    assert "-include-wiki" in name and "-exclude-special" in name and "-text-featured-articles" in name
    assert "-textexcl-main-page" in name and len(name) <= 120


def test_settings_table(spark):
    stored = spark.createDataFrame(
        [("p1", "unexpected-mode", "neon", "1", "yes", None),
         ("p2", "alphabetical", "dark", "false", None, "github")],
        "profile_id string, sortMode string, themeMode string, useRegex string, decodeUrls string, "
        "urlIncludePattern string")
    rows = {r.profile_id: r for r in S.merge_settings(stored).collect()}
    assert (rows["p1"].sortMode, rows["p1"].themeMode, rows["p1"].useRegex, rows["p1"].decodeUrls) == \
        ("original", "system", True, True)
    assert (rows["p2"].sortMode, rows["p2"].useRegex, rows["p2"].decodeUrls, rows["p2"].urlIncludePattern) == \
        ("alphabetical", True, False, "github")
    partial = spark.createDataFrame([("p2", None, "issues")], "profile_id string, sortMode string, "
                                                              "urlExcludePattern string")
    merged = {r.profile_id: r for r in S.save_settings(stored, partial).collect()}
    assert (merged["p2"].sortMode, merged["p2"].urlExcludePattern, merged["p2"].urlIncludePattern) == \
        ("alphabetical", "issues", "github")
    reset = S.reset_filters(S.merge_settings(stored)).where("profile_id = 'p2'").first()
    assert (reset.sortMode, reset.themeMode, reset.urlIncludePattern, reset.useRegex) == \
        ("alphabetical", "dark", "", False)
    typed = spark.createDataFrame([("p3", False, 0.0), ("p4", True, float("nan"))],
                                  "profile_id string, useRegex boolean, decodeUrls double")
    flags = {r.profile_id: (r.useRegex, r.decodeUrls) for r in S.merge_settings(typed).collect()}
    assert flags == {"p3": (False, False), "p4": (True, False)}
    profiles = S.load_profiles(stored)
    assert profiles["p2"].url_include == "github" and profiles["p1"].sort_mode == "original"


def test_settings_summary_table(spark):
    from anchorage.operators.report import settings_summary, settings_summary_sql
    stored = spark.createDataFrame([("p", "alphabetical", "a", " ", "b", True)],
                                   "profile_id string, sortMode string, urlIncludePattern string, "
                                   "urlExcludePattern string, textIncludePattern string, useRegex boolean")
    got = S.merge_settings(stored).select(F.expr(settings_summary_sql())).first()[0]
    assert got == "Alphabetical • 2 active filters • regex on • URL decoding off"
    assert got == settings_summary(Settings(sort_mode="alphabetical", url_include="a", url_exclude=" ",
                                            text_include="b", use_regex=True))


def test_extract_job_without_pages_keeps_current_and_sequence(spark):
    pages = _pages(spark, 5)
    store, current, sequence = S.extract_job(pages, max_results=3)
    last = sequence.first()["last"]
    none = pages.where("false")
    for given in (last, None):
        for known in (current, None):
            again, now, then = S.extract_job(none, store, given, max_results=3, current=known)
            assert (now.first()[0], then.first()[0]) == ("result-5", 5)
            assert sorted(r.sequence for r in again.collect()) == [3, 4, 5]
    # a record that was made current by hand is not pruned by an empty batch
    older = current.selectExpr("'result-3' AS result_id")
    again, now, _ = S.extract_job(none, store, last, max_results=1, current=older)
    assert now.first()[0] == "result-3" and [r.result_id for r in again.collect()] == ["result-3"]
    more, now, then = S.extract_job(pages, store, last, max_results=10, current=older)
    assert (now.first()[0], then.first()[0], more.count()) == ("result-10", 10, 8)
    nothing, now, then = S.extract_job(none)
    assert (nothing.count(), now.first()[0], then.first()[0]) == (0, None, 0)


def test_refresh_reads_only_the_buckets_it_was_asked_for(spark, tmp_path):
    import datetime

    from anchorage.streaming import jobs
    from anchorage.sources.pages import scan_html
    from anchorage.operators.entries import link_entries

    rows = [(k, "https://a.example/", f"<title>t{k}</title><a href={k}>x</a>") for k in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    saved = S.save_results(link_entries(scan_html(pages))).selectExpr("*", "cast(null as timestamp) refreshed_at", "0L n_requests")
    root = str(tmp_path / "store")
    jobs.write_version(saved, root, -1)
    at = datetime.datetime(2024, 1, 1)
    for batch_id, ids in ((0, [3, 3, 7]), (1, [7, 99])):
        asked = spark.createDataFrame([(i, at) for i in ids], "page_id long, ts timestamp")
        for _ in range(2):  # a retry counts nothing twice
            jobs.refresh_batch(spark, asked, batch_id, pages, root)
    got = {r.source_id: r.n_requests for r in jobs.newest_records(spark, root).collect()}
    assert got == {**dict.fromkeys(range(40), 0), 3: 2, 7: 2}
    one = spark.createDataFrame([(3,)], "page_id long")
    read = jobs.newest_records(spark, root, 2, one)
    assert [r.source_id for r in read.collect()] == [3]
    plan = read._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan parquet" in line and "bucket" in line)
    assert "PartitionFilters" in scan and "bucket" in scan.split("PartitionFilters")[1]
    assert len({f.split("bucket=")[1] for f in spark.read.parquet(root).where("bucket = 1").inputFiles()}) > 1  # what pruning leaves out exists


@pytest.mark.parametrize("data, want", [
    ("<meta charset=windows-1252><title>Té</title><a href=/é>“x”</a>".encode("cp1252"), "“x”"),
    ("<meta http-equiv=content-type content='text/html; charset=ISO-8859-1'><title>Té</title><a href=/é>“x”</a>".encode("cp1252"), "“x”"),
    ("<title>Té</title><a href=/é>“x”</a>".encode(), "“x”"), ("﻿<meta charset=latin1><title>Té</title><a href=/é>“x”</a>".encode(), "“x”"),
    ("﻿<title>Té</title><a href=/é>“x”</a>".encode("utf-16-le"), "“x”"), ("﻿<title>Té</title><a href=/é>“x”</a>".encode("utf-16-be"), "“x”"),
    ("<!-- <meta charset=latin1> --><meta charset='utf-16'><title>Té</title><a href=/é>“x”</a>".encode(), "“x”"),
    ("<meta charset=nonsense><title>Té</title><a href=/é>“x”</a>".encode(), "“x”"),
    ("<meta charset=shift_jis><title>Té</title><a href=/é>テ</a>".replace("é", "e").encode("shift_jis"), "テ")])
def test_saved_pages_in_their_own_encoding(spark, tmp_path, data, want):
    from anchorage.operators.entries import explode_entries, link_entries
    from anchorage.sources.pages import read_html_files, scan_html

    (tmp_path / "page.html").write_bytes(data)
    row = explode_entries(link_entries(scan_html(read_html_files(spark, str(tmp_path))))).first()
    assert row.text == want and row.title in ("Té", "Te") and row.display_url in ("file:///%C3%A9", "file:///e")


def test_text_export_has_no_file_per_page_and_keeps_every_line(spark, tmp_path):
    from anchorage.operators.export import read_txt, write_txt

    odd = ["https://a.example/x\\n\\0", "https://a.example/two\nlines\r", "https://a.example/tab\there", "", "https://a.example/é\u2028"]
    rows = [(k if k else None, f"Title {k}", [{"display_url": u, "text": "t", "surfaced": False, "source_url": None} for u in odd[k % 3:]])
            for k in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, title string, visible array<struct<display_url:string,text:string,surfaced:boolean,source_url:string>>")
    path = str(tmp_path / "txt")
    write_txt(pages.repartition(3), Settings(), path)
    assert len(list((tmp_path / "txt").rglob("*.txt"))) <= 3  # 300 pages, 300 export names
    got = {(r.page_id, r.rank): (r.export_name, r.url) for r in read_txt(spark, path).collect()}
    assert got == {(p, i + 1): (f"title-{p or 0}-links.txt", e["display_url"]) for p, _, v in rows for i, e in enumerate(v)}
    path = str(tmp_path / "folders")
    write_txt(pages.where("page_id % 3 = 2 and page_id < 20"), Settings(), path, per_page=True)
    assert read_txt(spark, path, per_page=True).where("page_id = 5").count() == len(odd[2:])
