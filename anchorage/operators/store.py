"""Saved results and settings as tables.

``results``: ``sequence bigint, result_id string, source_id bigint,
page_url string, title string, entries array<entry>``.  ``result_id`` is
``result-<sequence>``; the current result is the one-row table
``current(result_id)``.

Consecutive sequence numbers come from ``operators.ranking`` (no global
single-task window).  The last number given out is kept apart from the records
(a one-row table ``sequence(last)``), so numbers of pruned records are not used again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorage.operators.ranking import with_rank
from anchorage.session import materialize

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's.
RESULT_ID_PREFIX = "result-"
RESULT_STORAGE_PREFIX = "result:"  # key prefix of a stored record (configurable)
DEFAULT_MAX_RESULTS = 50
MISSING_RESULT_ERROR = "Saved result could not be found. Please run a new extraction."
MISSING_SOURCE_ERROR = "The original tab is no longer available. Run a fresh extraction."
# ---------------------------------------------------------------------------


def sequence_of(result_id) -> F.Column:
    """Numeric sequence of 'result-<digits>', null otherwise."""
    c = F.col(result_id) if isinstance(result_id, str) else result_id
    return F.when(c.rlike(r"^result-[0-9]+$"),
                  F.regexp_extract(c, r"^result-([0-9]+)$", 1).try_cast("bigint"))


def storage_key(result_id, prefix: str = RESULT_STORAGE_PREFIX) -> F.Column:
    """U13 getResultStorageKey: prefix + result id."""
    c = F.col(result_id) if isinstance(result_id, str) else result_id
    return F.concat(F.lit(prefix), c)


def sequence_key(result_id) -> F.Column:
    """U12 as an ordering key for digits of any number: struct(how many, digits) without leading zeros; null otherwise."""
    c = F.col(result_id) if isinstance(result_id, str) else result_id
    digits = F.regexp_replace(F.regexp_extract(c, r"^result-([0-9]+)$", 1), r"^0+(?=.)", "")
    return F.when(c.rlike(r"^result-[0-9]+$"), F.struct(F.length(digits).alias("length"), digits.alias("digits")))


def save_results(pages: DataFrame, store: DataFrame | None = None, last: int | None = None) -> DataFrame:
    """K4 saveResultRecord for every page row: new records numbered in page_id
    order.  Returns the new rows.

    Numbering goes on after ``last``, the last number given out so far (``last_sequence`` of the
    previous save); without it, after the store's highest.  Pages that share an id or
    have none are records of their own.  The pages are written once; only their row numbers and ids are ranked.
    """
    if last is None:
        last = store.agg(F.max("sequence")).first()[0] if store is not None else 0  # one scalar
    rows = materialize(pages.withColumn("_row", F.monotonically_increasing_id()), "results")
    ranks = with_rank(rows.select("page_id", "_row"), ["page_id", "_row"], out="_n").select("_row", "_n")
    return rows.join(ranks, "_row").withColumn("sequence", F.col("_n") + F.lit(last or 0)).select(
        "sequence",
        F.concat(F.lit(RESULT_ID_PREFIX), F.col("sequence").cast("string")).alias("result_id"),
        F.col("page_id").alias("source_id"), "page_url", "title", "entries")


def last_sequence(new_rows: DataFrame, last: int = 0) -> DataFrame:
    """The one-row table ``sequence(last)`` after a save; ``last`` is its value before."""
    return new_rows.agg(F.greatest(F.max("sequence"), F.lit(last)).cast("bigint").alias("last"))


def extract_job(pages: DataFrame, store: DataFrame | None = None, last: int | None = None, max_results: int = 50,
                current: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Save every page's entries, make the last record current, prune.

    ``pages`` as ``link_entries`` returns them.  Returns (store, current, sequence).  Without pages the ``current`` given
    stays (without one, the store's last record is current), and so does the last number given out: ``last``, or
    the store's highest.
    """
    if last is None:
        last = (store.agg(F.max("sequence")).first()[0] if store is not None else 0) or 0  # one scalar
    new = materialize(save_results(pages, store, last), "saved")
    found = current_of(new).withColumn("at", F.lit(1))
    known = current if current is not None else current_of(store) if store is not None else None
    if known is not None:
        found = found.unionByName(known.select("result_id", F.lit(0).alias("at")))
    # one row, written: the prune reads it, and the store it was found in is replaced
    found = materialize(found.where("result_id IS NOT NULL").agg(F.max_by("result_id", "at").alias("result_id")), "current")
    whole = new if store is None else store.unionByName(new.select(*store.columns))
    return prune_results(whole, found, max_results), found, last_sequence(new, last)


def current_of(new_rows: DataFrame) -> DataFrame:
    """rI1: the last saved record becomes current (one row)."""
    return new_rows.agg(F.max_by("result_id", "sequence").alias("result_id"))


def prune_results(store: DataFrame, current: DataFrame, max_results: int = DEFAULT_MAX_RESULTS) -> DataFrame:
    """K6 pruneOldResults: the kept rows of ``store``.

    Rows whose id has no ``result-<n>`` form are neither counted nor
    removed; the current row counts but is never removed; the
    ``overflow`` oldest other rows go (overflow = counted - max).
    """
    safe_max = max(0, int(max_results or 0))
    row = current.select("result_id").first()  # the one-row current table
    cur = row[0] if row else None
    tagged = store.withColumn("_seq", sequence_key("result_id")).withColumn(
        "_cand", F.col("_seq").isNotNull() & ~F.coalesce(F.col("result_id") == F.lit(cur), F.lit(False)))
    n = tagged.agg(F.count("_seq").alias("counted"), F.count_if("_cand").alias("cands")).first()  # two scalars
    overflow = n["counted"] - safe_max
    if overflow <= 0:
        return store
    # the newest candidates stay, max_results of them at most: a top-k, no global order
    stay = (tagged.where("_cand").orderBy(F.col("_seq").desc(), F.col("result_id").desc())
            .limit(max(0, n["cands"] - overflow)).select("result_id"))
    others = tagged.where("NOT _cand").select(*store.columns)
    return others.unionByName(store.join(stay, "result_id", "left_semi").select(*store.columns))


def removed_ids(store: DataFrame, kept: DataFrame) -> DataFrame:
    """Ids (and storage keys) removed by a prune."""
    return (store.select("result_id").join(kept.select("result_id"), "result_id", "left_anti")
            .withColumn("storage_key", storage_key("result_id")))


def lookup(store: DataFrame, result_id: str) -> DataFrame:
    """S6 getResultRecord: the record or no row."""
    return store.where(F.col("result_id") == F.lit(result_id))


def lookup_many(store: DataFrame, ids: DataFrame) -> DataFrame:
    """S6 for a table of ids: each with its record, or nulls."""
    return ids.select("result_id").join(store, "result_id", "left")


def current_record(store: DataFrame, current: DataFrame) -> DataFrame:
    """The current record (semi join with the one-row current table)."""
    return store.join(current.select("result_id"), "result_id", "left_semi")


def update_results(store: DataFrame, updates: DataFrame, order: str | None = None,
                   given: str | None = None) -> tuple[DataFrame, DataFrame]:
    """K5 updateResultRecord for many ids: (new store, error rows).

    ``updates`` has ``result_id`` plus any of the record columns.  Of several updates of an id the one
    with the greatest ``order`` counts (without ``order``, any one of them, always the same: that of the greatest hash).  ``given`` names an
    array column of the fields that an update sets, null values included; without it a null means "not given" and
    keeps the stored value.  Ids missing from the store are reported once, not inserted.
    """
    fields = [c for c in store.columns if c not in ("result_id", "sequence") and c in updates.columns]
    extra = [given] if given else []
    # one row for an id; maps and arrays have no order, so rows are told apart by a hash
    by = F.struct(*([F.col(order)] if order else []), F.xxhash64(*fields, *extra))
    one = updates.groupBy("result_id").agg(F.max_by(F.struct(*fields, *extra), by).alias("_u"))
    joined = store.join(one, "result_id", "left")

    def value(c):
        new = F.col(f"_u.{c}")
        if given:
            return F.when(F.coalesce(F.array_contains(F.col(f"_u.{given}"), c), F.lit(False)), new).otherwise(F.col(c))
        return F.coalesce(new, F.col(c))

    merged = joined.select(*((value(c) if c in fields else F.col(c)).alias(c) for c in store.columns))
    errors = one.select("result_id").join(store.select("result_id"), "result_id", "left_anti") \
        .withColumn("error", F.lit(MISSING_RESULT_ERROR))
    return merged, errors


def current_after_update(store: DataFrame, updates: DataFrame, order: str, current: DataFrame) -> DataFrame:
    """rI2: the record updated last becomes current; without any known id ``current`` stays (one row)."""
    known = updates.join(store.select("result_id"), "result_id", "left_semi")
    last = known.agg(F.max_by("result_id", F.struct(order, "result_id")).alias("result_id")).withColumn("at", F.lit(1))
    both = last.unionByName(current.select("result_id", F.lit(0).alias("at"))).where("result_id IS NOT NULL")
    return both.agg(F.max_by("result_id", "at").alias("result_id"))


def refresh_results(store: DataFrame, pages: DataFrame, result_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """J1/E3 refreshResult: re-extracted entries of each requested record's source
    page overlaid onto the record (no prune).  Returns (store, errors).

    ``pages(page_id, url, html)``: only the requested ones are scanned.
    """
    from anchorage.operators.entries import link_entries
    from anchorage.sources.pages import scan_html

    req = result_ids.select("result_id").distinct().join(store.select("result_id", "source_id"), "result_id", "left")
    wanted = req.where(F.col("source_id").isNotNull()).select(F.col("source_id").alias("page_id")).distinct()
    rescanned = link_entries(scan_html(pages.join(wanted, "page_id", "left_semi")))
    fresh = materialize(req.join(rescanned.withColumnRenamed("page_id", "source_id"), "source_id")
                        .select("result_id", "page_url", "title", "entries"), "refreshed")
    errors = (req.join(fresh.select("result_id"), "result_id", "left_anti")
              .select("result_id", F.lit(MISSING_SOURCE_ERROR).alias("error")))
    new_store, _ = update_results(store, fresh)
    return new_store, errors


# --- settings as a table (P7, K7, S8) ----------------------------------------------

SETTINGS_DEFAULTS = {
    "sortMode": "'original'", "themeMode": "'system'",
    "urlIncludePattern": "''", "urlExcludePattern": "''",
    "textIncludePattern": "''", "textExcludePattern": "''",
    "useRegex": "false", "decodeUrls": "false",
}


def _truthy(df: DataFrame, name: str) -> str:
    """JavaScript Boolean() of a stored value, by the column's type:
    booleans as they are, numbers non-zero and not NaN, strings non-empty
    (so the string 'false' is true); null is false."""
    t = df.schema[name].dataType.typeName()
    c = f"`{name}`"
    if t == "boolean":
        return f"coalesce({c}, false)"
    if t in ("integer", "long", "short", "byte", "float", "double", "decimal"):
        return f"coalesce({c} <> 0 AND NOT isnan(CAST({c} AS DOUBLE)), false)"
    return f"coalesce(CAST({c} AS STRING) <> '', false)"


def merge_settings(stored: DataFrame) -> DataFrame:
    """P7 mergeSettings for many stored records (one row each).

    Missing columns take the defaults; unknown sort / theme values fall
    back to the default; ``useRegex`` / ``decodeUrls`` follow JavaScript
    truthiness for the column's type.
    """
    cols = set(stored.columns)
    out = [F.col(c) for c in stored.columns if c not in SETTINGS_DEFAULTS]
    for name, default in SETTINGS_DEFAULTS.items():
        if name not in cols:
            expr = default
        elif name == "sortMode":
            expr = "CASE WHEN sortMode IN ('original', 'alphabetical') THEN sortMode ELSE 'original' END"
        elif name == "themeMode":
            expr = "CASE WHEN themeMode IN ('system', 'light', 'dark') THEN themeMode ELSE 'system' END"
        elif name in ("useRegex", "decodeUrls"):
            expr = _truthy(stored, name)
        else:
            expr = f"coalesce(CAST({name} AS STRING), '')"
        out.append(F.expr(expr).alias(name))
    return stored.select(*out)


def save_settings(current: DataFrame, partial: DataFrame, key: str = "profile_id") -> DataFrame:
    """K7 saveSettings: overlay ``partial`` (null = not given) onto the
    merged ``current`` settings per ``key``, then normalise again."""
    cur = merge_settings(current)
    names = [c for c in SETTINGS_DEFAULTS if c in partial.columns]

    def given(c):
        if c in ("useRegex", "decodeUrls"):
            return F.when(F.col(c).isNotNull(), F.expr(_truthy(partial, c)))
        return F.col(c).cast("string")
    p = partial.select(key, *[given(c).alias(f"_p_{c}") for c in names])
    joined = cur.join(p, key, "full")
    cols = [F.col(key)] + [
        (F.coalesce(F.col(f"_p_{c}"), F.col(c)) if c in names else F.col(c)).alias(c)
        for c in SETTINGS_DEFAULTS]
    return merge_settings(joined.select(*cols))


def reset_filters(settings: DataFrame) -> DataFrame:
    """P8 getResetFilterState: clear the patterns, regex and decode flags."""
    return settings.withColumns({
        "urlIncludePattern": F.lit(""), "urlExcludePattern": F.lit(""),
        "textIncludePattern": F.lit(""), "textExcludePattern": F.lit(""),
        "useRegex": F.lit(False), "decodeUrls": F.lit(False)})


def load_profiles(settings: DataFrame, key: str = "profile_id") -> dict:
    """Merged settings rows -> {id: Settings} for ``plans.visible.profile_apply``: the few saved
    profiles of one user.  Profiles in a large table are applied by ``plans.visible.profile_join``."""
    from anchorage.settings import Settings
    return {r[key]: Settings.merge(r.asDict()) for r in merge_settings(settings).collect()}
