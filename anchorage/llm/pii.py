"""Operator 9, PII: bootstrapped contextual extraction.

Seeds are the spans that four fixed patterns find.  The words beside a span are
its lexical patterns: ``<`` and the word before it, ``>`` and the word after it.  Words
that look like an identifier (a digit, @ or _, a mark between letters, a capital inside) and that no seed covers are
candidates and have patterns too.  On the graph of
patterns and instances (the values found) Spark alternates ``ROUNDS`` times: a
pattern's score is the mean score of its instances, held down while it has few; only patterns of
``CONFIDENT`` discover.  The score of a place is that at least one of such patterns beside it is right (noisy or
of two at most), a candidate's score is the mean of its distinct contexts, so it doesn't grow with their number; seeds stay
at 1.  A word is a span of kind ``context`` where its place has ``CONFIDENT``, and everywhere if its value has.

Only DataFrame functions run.  The graph is summed up before each shuffle, and patterns
or values that very many rows share are one row each after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorage.llm.spans import Kind, find_spans, free_of, listed, replace_spans
from anchorage.session import materialize

_LOCAL = "[A-Za-z0-9._%+-]"
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_DIGITS = "regexp_replace({v}, '[^0-9]', '')"
#: Luhn: of the digits from the right, every second one doubled and its digits added.
_LUHN = f"""aggregate(sequence(1, length({_DIGITS})), 0, (a, i) -> a + CASE
    WHEN i % 2 = 1 THEN cast(substring({_DIGITS}, -i, 1) AS int)
    ELSE element_at(array(0, 2, 4, 6, 8, 1, 3, 5, 7, 9), cast(substring({_DIGITS}, -i, 1) AS int) + 1) END) % 10 = 0"""
KINDS = [
    Kind("email", rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "[0-9]",
         "{v} rlike '^" + _BYTE + "(?:[.]" + _BYTE + "){3}$'"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "[0-9]",
         f"CASE WHEN length({_DIGITS}) BETWEEN 12 AND 19 THEN {_LUHN} ELSE false END"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", f"length({_DIGITS}) BETWEEN 9 AND 15"),
]
NAMES = [k.name for k in KINDS]
_SPACE = r"\x20\x09-\x0D"
#: What sets an identifier apart from a plain word: a digit, @ or _, a mark between letters, a capital inside.
_MARKED = "[0-9@_]|[A-Za-z][.:/][A-Za-z]|[a-z][A-Z]"
CANDIDATE = Kind("word", rf"(?<![^{_SPACE}])(?=[^{_SPACE}]*?(?:{_MARKED}))[^{_SPACE}]++", _MARKED)
ROUNDS = 3
CONFIDENT = 0.8
#: A pattern counts as if it had so many more instances, of score 0.
DOUBT = 2
_MASKS = {"email": "<EMAIL>", "ip": "<IP>", "card": "<CARD>", "phone": "<PHONE>", "context": "<ID>"}


def base_and_candidates(docs: DataFrame) -> DataFrame:
    """``docs`` without the text, with ``base`` spans and candidate spans ``words``, each with its neighbours."""
    every = ", ".join(f"spans_{n}" for n in NAMES)
    found = find_spans(docs, [*KINDS, CANDIDATE], context=True)
    kept = [c for c in found.columns if not c.startswith("spans_")]
    words = rf"""transform(spans_word, s -> named_struct(
        'start', s.start + length(s.value) - length(regexp_replace(s.value, '^[^A-Za-z0-9]+', '')), 'kind', s.kind,
        'end', s.end - length(s.value) + length(regexp_replace(s.value, '[^A-Za-z0-9]+$', '')),
        'value', regexp_replace(regexp_replace(s.value, '^[^A-Za-z0-9]+', ''), '[^A-Za-z0-9]+$', ''),
        'before', s.before, 'after', s.after))"""
    return (found.selectExpr(*kept, f"array_sort(concat({every})) AS base", f"{words} AS words")
            .withColumn("words", F.expr(free_of("words", "base"))))


def _patterns(side: str):
    """The lexical patterns of a span column: its neighbours in lower case without edge punctuation."""
    def word(name: str, mark: str):
        bare = F.regexp_replace(F.regexp_replace(F.lower(f"{side}.{name}"), r"^[^\p{L}\p{N}]+", ""), r"[^\p{L}\p{N}]+$", "")
        return F.when(bare != "", F.concat(F.lit(mark), bare))

    return F.array_compact(F.array(word("before", "<"), word("after", ">")))


def score_candidates(contexts: DataFrame, rounds: int = ROUNDS, doubt: int = DOUBT, confident: float = CONFIDENT) -> DataFrame:
    """(instance, patterns, score) of the candidates' ``contexts(instance, patterns, seed)``, distinct rows: the larger of
    the context's own score and its instance's.  Rows of score 0 may be missing.

    Every round is two joins and two sums over the edges; a written table ends it.
    """
    edges = materialize(contexts.select("instance", "seed", F.explode("patterns").alias("pattern")).distinct(), "llm", "edges")
    mine = contexts.where("NOT seed").select("instance", "patterns")
    sizes = mine.where(F.size("patterns") > 0).groupBy("instance").agg(F.count(F.lit(1)).alias("n"))
    kinds = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    scores = None
    for _ in range(rounds):
        known = edges.where("seed").withColumn("score", F.lit(1.0))
        if scores is not None:
            known = known.unionByName(edges.where("NOT seed").join(scores, "instance"))
        found = known.groupBy("pattern").agg(F.sum("score").alias("sum"))
        patterns = found.join(kinds, "pattern").select(
            "pattern", F.least(F.col("sum") / (F.col("n") + doubt), F.lit(0.999999)).alias("right")).where(F.col("right") >= confident)
        own = materialize(
            mine.withColumn("pattern", F.explode("patterns")).join(patterns, "pattern").groupBy("instance", "patterns")
            .agg((1 - F.exp(F.sum(F.ln(1 - F.col("right"))))).alias("own")), "llm", "places")
        scores = materialize(own.groupBy("instance").agg(F.sum("own").alias("sum")).join(sizes, "instance")
                             .select("instance", (F.col("sum") / F.col("n")).alias("score")), "llm", "scores")
    return (mine.join(scores, "instance").join(own, ["instance", "patterns"], "left")
            .select("instance", "patterns", F.greatest("score", "own").alias("score")))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", confident: float = CONFIDENT) -> DataFrame:
    """(row, doc_id, base, more): base spans and discovered spans of each row of ``docs``.

    ``row`` numbers the rows of one run.  A null or empty text has no spans; ids may be null or
    repeat; other columns are not read.
    """
    found = materialize(base_and_candidates(docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).cast("string").alias("text"))), "llm", "found")
    seeds = found.select(F.explode("base").alias("s"), F.lit(True).alias("seed"))
    words = found.select("row", F.explode("words").alias("s"))
    contexts = materialize(
        seeds.unionByName(words.select("s", F.lit(False).alias("seed")))
        .select(F.col("s.value").alias("instance"), _patterns("s").alias("patterns"), "seed").distinct(),
        "llm", "contexts")
    sure = score_candidates(contexts, confident=confident).where(F.col("score") >= confident)
    more = (words.withColumn("patterns", _patterns("s")).withColumn("instance", F.col("s.value"))
            .join(sure, ["instance", "patterns"], "left_semi")
            .groupBy("row").agg(F.array_sort(F.collect_list(F.struct(
                "s.start", F.lit(len(KINDS)).alias("kind"), "s.end", "s.value"))).alias("more")))
    plain = F.expr("transform(base, s -> named_struct('start', s.start, 'kind', s.kind, 'end', s.end, 'value', s.value))")
    return (found.select("row", "doc_id", plain.alias("base")).join(more, "row", "left")
            .withColumn("more", F.coalesce("more", F.expr("filter(base, s -> false)"))))


def op9_pii(spark, sf_dir: str) -> DataFrame:
    found = personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.selectExpr(
        "doc_id", *(f"cast(size(filter(base, s -> s.kind = {k})) AS bigint) AS n_{n}" for k, n in enumerate(NAMES)),
        f"sha2({listed('base', NAMES)}, 256) AS base_sha256",
        f"{listed('concat(base, more)', [*NAMES, 'context'])} AS spans")


def merged(spans: str) -> str:
    """SQL: spans sorted by start with overlapping ones joined, as kind of the first."""
    joined = ("struct(last.start AS start, last.kind AS kind, greatest(last.end, s.end) AS end)")
    return (f"aggregate(array_sort(transform({spans}, s -> struct(s.start AS start, s.kind AS kind, s.end AS end))), "
            "cast(array() AS array<struct<start:bigint,kind:int,end:bigint>>), (a, s) -> "
            "CASE WHEN size(a) > 0 AND s.start < element_at(a, -1).end THEN "
            f"concat(slice(a, 1, size(a) - 1), array({joined.replace('last', 'element_at(a, -1)')})) "
            "ELSE concat(a, array(s)) END)")


def masked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every personal span replaced by its kind's mark, all other columns as they are.

    Spans that overlap become one, of the first one's kind.  Discovered values are joined to the
    values of the rows that hold candidates, by a row number written with the rows.
    """
    rows = materialize(docs.withColumn("__row", F.monotonically_increasing_id()), "llm", "rows")
    found = personal_data(rows, "__row", text_col).select(
        F.col("doc_id").alias("__row"), F.expr(merged("concat(base, more)")).alias("__spans")).where(F.size("__spans") > 0)
    marks = ", ".join(f"'{_MASKS[n]}'" for n in [*NAMES, "context"])
    text = replace_spans(f"`{text_col}`", "__spans", f"element_at(array({marks}), s.kind + 1)")
    # how many rows hold spans grows with the documents: a merge join at every size
    return (rows.join(found.hint("merge"), "__row", "left")
            .withColumn(text_col, F.when(F.col("__spans").isNull(), F.col(text_col)).otherwise(F.expr(text)))
            .select(*docs.columns))
