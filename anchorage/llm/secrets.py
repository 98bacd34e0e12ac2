"""Operator 5, secret scans: a battery of randomness tests.

Beside three fixed patterns, any unbroken run of 20 or more token characters
is a candidate.  Its encoding is inferred (decimal, hex, letters, base32, base64) and its
characters are tested against an even draw from that alphabet: chi-squared for
uniformity, runs above and below the middle of the alphabet, and serial
correlation of neighbours.  The smallest of the three p-values, times three, must not
reject an even draw.

Evidence against ordinary text is the likelihood ratio of the even draw to a
letter-frequency model; by Markov's inequality its inverse bounds the chance that
ordinary text looks as random.  Longer runs have more evidence, so candidates
are put into bands of length, and in each band the e-value form of the
Benjamini-Hochberg procedure keeps the rate of false discoveries at ``FALSE_RATE``.

Only DataFrame functions run.  The procedure needs how many candidates of a band reach each
whole unit of evidence: at most ``BINS`` rows a band, whatever the corpus holds.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from anchorage.llm.spans import Kind, find_spans, free_of, listed
from anchorage.session import materialize

KINDS = [
    Kind("assign", r"""(?:(?i:password|passwd|secret|token)|(?i:api)_?(?i:key))["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""",
         "[:=]", r"""length(regexp_extract({v}, '([:=])\\x20*["\']?([A-Za-z0-9+/_.=-]+)$', 2)) >= 6"""),
    Kind("access", r"AKIA[A-Z0-9]{16,}", "AKIA"),
    Kind("hex", r"[0-9a-f]{24,}", "[0-9a-f]{24}"),
]
NAMES = [k.name for k in KINDS]
CANDIDATE = Kind("run", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}+", "[A-Za-z0-9+/_-]{20}")
DIGITS = "0123456789"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Inferred encodings in order: name, pattern of the whole run without padding, alphabet.
ENCODINGS = [
    ("decimal", "^[0-9]+$", DIGITS),
    ("hex", "^[0-9a-f]+$", DIGITS + LOWER[:6]),
    ("HEX", "^[0-9A-F]+$", DIGITS + LOWER[:6].upper()),
    ("lower", "^[a-z]+$", LOWER),
    ("upper", "^[A-Z]+$", LOWER.upper()),
    ("base32", "^[A-Z2-7]+$", LOWER.upper() + DIGITS[2:8]),
    ("letters", "^[A-Za-z]+$", LOWER.upper() + LOWER),
    ("base64", "", LOWER.upper() + LOWER + DIGITS + "+/"),
]
#: Percent of letters in ordinary text, a to z; upper case a tenth of it, a digit or sign half a percent.
LETTERS = [8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.2, 0.8, 4.0, 2.4, 6.7, 7.5, 1.9, 0.1, 6.0, 6.3, 9.1, 2.8, 1.0, 2.4, 0.2, 2.0, 0.1]
REJECT = 0.001
FALSE_RATE = 0.05
BINS = 200


def _upper_tail(z):
    """Chance that a standard normal value is above ``z`` (logistic approximation)."""
    return 1 / (1 + F.exp(1.5976 * z + 0.070566 * z * z * z))


def _two_sided(z):
    return F.least(F.lit(1.0), 2 * _upper_tail(F.abs(z)))


def _count_of(text, char: str):
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def tested(runs: DataFrame) -> DataFrame:
    """``runs(value, ...)`` plus encoding, n, p_uniform, p_runs, p_serial, p_random and evidence (a log)."""
    body = F.translate(F.regexp_replace("value", "=+$", ""), "-_", "+/")
    kind = F.lit(ENCODINGS[-1][0])
    for name, pattern, _ in reversed(ENCODINGS[:-1]):
        kind = F.when(F.col("body").rlike(pattern), name).otherwise(kind)
    runs = runs.withColumn("body", body).withColumn("encoding", kind).withColumn("n", F.length("body").cast("double"))

    def by_encoding(made):
        out = None
        for name, _, alphabet in ENCODINGS:
            value = made(alphabet)
            out = F.when(F.col("encoding") == name, value) if out is None else out.when(F.col("encoding") == name, value)
        return out

    # characters outside the run's own alphabet count 0, so one sum over all of them serves every encoding
    squares = sum((F.pow(_count_of(F.col("body"), c).cast("double"), F.lit(2.0)) for c in ENCODINGS[-1][2]), F.lit(0.0))

    def half(alphabet: str):
        k = len(alphabet)
        return F.translate("body", alphabet, "0" * (k // 2) + "1" * (k - k // 2))

    def places(alphabet: str):
        return F.transform(F.split("body", ""), lambda c: F.instr(F.lit(alphabet), c).cast("double") - 1)

    k = by_encoding(lambda a: F.lit(float(len(a))))
    runs = (runs.withColumn("k", k).withColumn("squares", squares).withColumn("half", by_encoding(half))
            .withColumn("v", by_encoding(places)))
    n, df = F.col("n"), F.col("k") - 1
    chi = F.col("squares") * F.col("k") / n - n
    spread = 2 / (9 * df)
    z_uniform = (F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - spread)) / F.sqrt(spread)
    ones = _count_of(F.col("half"), "1").cast("double")
    both = 2 * ones * (n - ones)
    seen = F.length(F.regexp_replace("half", "0+|1+", "x")).cast("double")
    z_runs = (seen - (1 + both / n)) / F.sqrt(both * (both - n) / (n * n * (n - 1)))
    runs = runs.withColumn("mean", F.expr("aggregate(v, 0D, (a, x) -> a + x) / n"))
    runs = runs.withColumn("serial", F.expr(
        "aggregate(zip_with(slice(v, 1, size(v) - 1), slice(v, 2, size(v)), (x, y) -> (x - mean) * (y - mean)), 0D, (a, x) -> a + x)"
        " / nullif(aggregate(v, 0D, (a, x) -> a + (x - mean) * (x - mean)), 0D)"))
    z_serial = (F.col("serial") + 1 / n) * F.sqrt(n)

    ordinary = dict.fromkeys(DIGITS + "+/", 0.005)
    for c, percent in zip(LOWER, LETTERS):
        ordinary |= {c: percent / 100 * 0.85, c.upper(): percent / 100 * 0.1}

    every = ENCODINGS[-1][2]
    weights = F.array(*(F.lit(-math.log(ordinary[c])) for c in every))
    evidence = F.aggregate(F.split("body", ""), F.lit(0.0), lambda a, c: a + F.get(weights, F.instr(F.lit(every), c) - 1)) - n * F.log("k")

    runs = (runs.withColumn("p_uniform", _two_sided(z_uniform))
            .withColumn("p_runs", F.when(both > n, _two_sided(z_runs)).otherwise(0.0))
            .withColumn("p_serial", F.coalesce(_two_sided(z_serial), F.lit(0.0)))
            .withColumn("evidence", evidence))
    return (runs.withColumn("p_random", F.least(F.lit(1.0), 3 * F.least("p_uniform", "p_runs", "p_serial")))
            .drop("body", "k", "squares", "half", "v", "mean", "serial"))


def discovered(runs: DataFrame, false_rate: float = FALSE_RATE, reject: float = REJECT) -> DataFrame:
    """The rows of ``tested()`` that pass the battery and their band's false-discovery control.

    The tests run once: their figures are written, and both the bins and the choice read them back.
    """
    runs = materialize(runs, "llm", "tested")
    runs = runs.withColumn("band", F.least(F.floor(F.log2("n")), F.lit(20)))
    runs = runs.withColumn("bin", F.least(F.greatest(F.floor("evidence"), F.lit(-1)), F.lit(BINS)))
    most = Window.partitionBy("band").orderBy(F.col("bin").desc())
    whole = Window.partitionBy("band")
    bins = (runs.groupBy("band", "bin").agg(F.count(F.lit(1)).alias("n"))
            .withColumn("reach", F.sum("n").over(most)).withColumn("all", F.sum("n").over(whole)))
    cut = (bins.where((F.col("bin") >= 0) & (F.exp(F.col("bin").cast("double")) * F.col("reach") * false_rate >= F.col("all")))
           .groupBy("band").agg(F.min("bin").alias("cut")))  # 21 rows at most
    return runs.join(F.broadcast(cut), "band").where((F.col("bin") >= F.col("cut")) & (F.col("p_random") >= reject))


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", false_rate: float = FALSE_RATE) -> DataFrame:
    """(row, doc_id, base, more): fixed spans and discovered random runs of each row of ``docs``.

    A run that overlaps a fixed span is no candidate.  ``row`` numbers the rows of one run.  A null or
    empty text has no spans; ids may be null or repeat; other columns are not read.
    """
    every = ", ".join(f"spans_{n}" for n in NAMES)
    found = find_spans(docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).cast("string").alias("text")), [*KINDS, CANDIDATE])
    found = materialize(
        found.selectExpr("row", "doc_id", f"array_sort(concat({every})) AS base", "spans_run")
        .withColumn("runs", F.expr(free_of("spans_run", "base"))).drop("spans_run"), "llm", "found")
    runs = found.select("row", F.explode("runs").alias("s")).select("row", "s.start", "s.end", "s.value")
    more = (discovered(tested(runs), false_rate).groupBy("row").agg(F.array_sort(F.collect_list(F.struct(
        "start", F.lit(len(KINDS)).alias("kind"), "end", "value"))).alias("more")))
    return (found.select("row", "doc_id", "base").join(more, "row", "left")
            .withColumn("more", F.coalesce("more", F.expr("filter(base, s -> false)"))))


def op5_secret_scans(spark, sf_dir: str) -> DataFrame:
    found = secret_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.selectExpr(
        "doc_id", *(f"cast(size(filter(base, s -> s.kind = {k})) AS bigint) AS n_{n}" for k, n in enumerate(NAMES)),
        f"sha2({listed('base', NAMES)}, 256) AS base_sha256",
        f"{listed('concat(base, more)', [*NAMES, 'random'])} AS spans")
