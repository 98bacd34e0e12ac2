"""Operator 1, toxicity: class-conditional Kneser-Ney models.

Two character models of order ``ORDER``, one of toxic and one of ordinary
texts, predict every character of a word from those before it in the word.
Their highest order has its own counts for each class; all lower orders are
one Kneser-Ney model of continuation counts pooled over both classes, so an
expression that is rare in both is smoothed to the same probability and says
nothing.  An n-gram that is in neither, after a context that is, has the log ratio of
the context's two backoff weights.  A document has two lengths of evidence, each the difference of its two
log-likelihoods divided by its number of words: of all its words, and of its telling words alone (``NEUTRAL``).  A
logistic curve of both, fitted on held-back training rows, turns them into a score.

Counts cover all training rows.  The curve is fitted on a fifth of them, with the evidence of a second model
whose counts leave that fifth out.  Spark makes the counts (words, then n-grams, then the orders as joins).  The model is a table of any size, of every n-gram in the
documents: it is joined to the n-grams of the distinct words, so every word's log ratio is computed once and
joined back to the documents.  The ratios of the ``BUCKETS`` commonest n-grams are broadcast, to spare work: a word that has
no other n-gram needs no join.  All other words are joined.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anchorage.llm.words import mix, slices
from anchorage.session import materialize

ORDER = 5
DISCOUNT = 0.75
#: A word whose two probabilities differ by less than this factor (as a log) counts in the evidence of all words only, not in
#: that of telling words: such differences come from the mix of languages and topics in a small training set.
NEUTRAL = 3.0
#: One in so many training rows is held back, from the counts of the model that the curve is fitted with.
CURVE_ROWS = 5
THRESHOLD = 0.7
_BEGIN, _END = "\x02", "\x03"
#: Characters of words that a task cuts into n-grams at once.
_FLUSH = 1_000_000
#: Words that a task counts before it passes them on.
_FLUSH_WORDS = 800_000
_BINS = 40  # of each evidence, a unit
#: Most n-grams whose ratios are broadcast.
BUCKETS = 1 << 22
#: Different words whose sums a task remembers.
_KNOWN = 600_000
#: Log ratios are summed as whole numbers of such steps, so that no sum depends on its order.
_STEPS = 1e8


def _folded(id_col: str):
    return F.crc32(F.col(id_col).cast("string").cast("binary"))


def count_words(rows: DataFrame) -> DataFrame:
    """(word, t, o, t_held, o_held): how often each word occurs in toxic and in ordinary texts of ``rows(text, toxic, held)``,
    the last two of held rows; of a row whose ``toxic`` is null the words are listed but not counted.
    Counts of a word may be dealt over several rows."""
    names = ["t", "o", "t_held", "o_held"]

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, others = [Counter() for _ in names], set()

        def flush() -> pa.RecordBatch:
            words = others.union(*counts)
            out = pa.RecordBatch.from_arrays(
                [pa.array([w.decode() for w in words], pa.string()),
                 *(pa.array([c[w] for w in words], pa.int64()) for c in counts)], names=["word", *names])
            for seen in (*counts, others):
                seen.clear()
            return out

        for batch in source:
            for text, toxic, held in zip(*batch.columns):
                seen = others if toxic.as_py() is None else counts[1 - toxic.as_py() + 2 * held.as_py()]
                seen.update((text.as_py() or "").lower().encode().split())
                if sum(map(len, counts)) + len(others) > _FLUSH_WORDS:
                    yield flush()
        yield flush()

    return rows.mapInArrow(batches, "word string, " + ", ".join(f"{c} long" for c in names))


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, start, n): the code points of the padded words one after the other, where in them each of the words'
    ``ORDER``-character n-grams starts, and how many each word has."""
    codes = np.frombuffer("".join(_BEGIN * (ORDER - 1) + w + _END for w in words).encode("utf-32-le"), "<u4").astype(np.uint64)
    n = np.fromiter(map(len, words), np.int64, len(words)) + 1
    return codes, np.arange(n.sum()) + (ORDER - 1) * np.repeat(np.arange(len(words)), n), n


def _spelled(codes: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two whole numbers that spell an n-gram, of three and of two code points."""
    c = [codes[start + k] << np.uint64(21 * (2 - k if k < 3 else 4 - k)) for k in range(ORDER)]
    return c[0] | c[1] | c[2], c[3] | c[4]


def count_grams(words: DataFrame) -> DataFrame:
    """(gram, ...): counts of the ``ORDER``-character n-grams of the words, padded at their begin, for each column
    of ``words(word, ...)``."""
    names, most = words.columns[1:], _FLUSH

    def counted(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        codes, start, n = _grams(table.column(0).to_pylist())
        first, last = _spelled(codes, start)
        order = np.lexsort((last, first))
        first, last = first[order], last[order]
        new = np.flatnonzero(np.append(True, (first[1:] != first[:-1]) | (last[1:] != last[:-1])))
        word = np.repeat(np.arange(len(n)), n)[order]
        text = codes[start[order[new]][:, None] + np.arange(ORDER)].astype("<u4").tobytes().decode("utf-32-le")
        return pa.RecordBatch.from_arrays(
            [pa.array([text[i:i + ORDER] for i in range(0, len(text), ORDER)], pa.string()),
             *(pa.array(np.add.reduceat(table.column(c).to_numpy()[word], new), pa.int64()) for c in names)], names=["gram", *names])

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in source:
            bounds = np.append(0, np.cumsum(pc.binary_length(batch.column(0)).to_numpy(zero_copy_only=False) + 1))
            for lo, hi in slices(bounds, most):
                held.append(batch.slice(lo, hi - lo))
                size += bounds[hi] - bounds[lo]
                if size > most:
                    yield counted(held)
                    held, size = [], 0
        if held:
            yield counted(held)

    return (words.mapInArrow(batches, "gram string, " + ", ".join(f"{c} long" for c in names))
            .groupBy("gram").agg(*(F.sum(c).alias(c) for c in names)))


def shared_backoff(grams: DataFrame, seen: dict[str, Column] | None = None) -> DataFrame:
    """(gram, p): interpolated Kneser-Ney probability of every n-gram of order ORDER - 1, from pooled
    continuation counts: in how many different n-grams one longer it is the end.

    With ``seen``, a probability for each of its names, of the ``grams`` for which its column holds alone; null of
    n-grams that end none of these.
    """
    seen = seen or {"p": F.lit(True)}
    counts, below = [], grams.select("gram", *(c.cast("long").alias(name) for name, c in seen.items()))
    for k in range(ORDER - 1, 0, -1):
        below = below.groupBy(F.col("gram").substr(2, k).alias("gram")).agg(*(F.count_if(F.col(c) > 0).alias(c) for c in seen))
        counts.append(below)
    total = counts[-1].agg(*(F.sum(c).alias(c) for c in seen)).first()  # one row
    p = counts[-1].select("gram", *(F.when(F.col(c) > 0, F.col(c) / F.lit(total[c] or 1)).alias(c) for c in seen))
    context = Window.partitionBy("h")  # as many rows as there are different characters, at most
    for k, level in zip(range(2, ORDER), reversed(counts[:-1])):
        level = (level.withColumn("h", F.col("gram").substr(1, k - 1)).withColumn("end", F.col("gram").substr(2, k - 1))
                 .select("gram", "end", *seen, *(F.sum(c).over(context).alias(f"all_{c}") for c in seen),
                         *(F.sum((F.col(c) > 0).cast("long")).over(context).alias(f"kinds_{c}") for c in seen)))
        p = (level.join(p.select(F.col("gram").alias("end"), *(F.col(c).alias(f"lower_{c}") for c in seen)), "end")
             .select("gram", *(F.when(F.col(c) > 0, (F.col(c) - DISCOUNT + DISCOUNT * F.col(f"kinds_{c}") * F.col(f"lower_{c}"))
                                      / F.col(f"all_{c}")).alias(c) for c in seen)))
    return p


def log_ratios(grams: DataFrame, counts: dict[str, tuple[str, str]] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(gram, llr): log of the toxic over the ordinary probability of every n-gram in ``grams(gram, t, o)``.

    An n-gram without counts has in each class the context's backoff weight times the shared lower
    probability, which cancels out; after a context without counts it says nothing.
    With ``counts``, a ratio for each of its names, by that model's two counts (SQL); a context without counts in
    one of them gives 0 there.  Columns in ``keep`` stay.
    """
    counts = counts or {"llr": ("t", "o")}
    own = {f"{c}_{name}": F.expr(sql) for name, pair in counts.items() for c, sql in zip("to", pair)}
    grams = grams.select("gram", F.col("gram").substr(1, ORDER - 1).alias("h"), F.col("gram").substr(2, ORDER - 1).alias("end"), *keep,
                         *(c.alias(at) for at, c in own.items()))
    seen = {name: F.col(f"t_{name}") + F.col(f"o_{name}") > 0 for name in counts}
    lower = shared_backoff(grams, seen).select(F.col("gram").alias("end"), *(F.col(c).alias(f"lower_{c}") for c in counts))
    context = Window.partitionBy("h")  # as many rows as there are different characters, at most
    grams = grams.select("gram", "end", *keep, *own, *(F.sum(c).over(context).alias(f"all_{c}") for c in own),
                         *(F.sum((F.col(c) > 0).cast("long")).over(context).alias(f"kinds_{c}") for c in own))

    def p(c: str, name: str):
        c, less = f"{c}_{name}", F.when(seen[name], F.col(f"lower_{name}")).otherwise(1.0)
        in_class = (F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col(f"kinds_{c}") * less) / F.col(f"all_{c}")
        return F.when(F.col(f"all_{c}") > 0, in_class).otherwise(less)

    return grams.join(lower, "end", "left").select("gram", *keep, *(
        F.when(F.col(f"all_t_{c}") + F.col(f"all_o_{c}") > 0, F.ln(p("t", c)) - F.ln(p("o", c))).otherwise(0.0).alias(c) for c in counts))


def _key(word: bytes) -> int:
    return int.from_bytes(blake2b(word, digest_size=8).digest(), "little", signed=True)


def word_ratios(words: DataFrame, model: DataFrame, neutral: float = NEUTRAL) -> DataFrame:
    """(key, ...): log ratios, in steps, of each of the ``words(word)`` by the word's 64-bit hash, for each column of
    ``model(gram, ...)``; 0 where below ``neutral``, and without words that are so by all."""
    names = model.columns[1:]

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for lo in range(0, batch.num_rows, 1000):
                grams, keys, times = [], [], []
                for word in batch.column(0).slice(lo, 1000).to_pylist():
                    padded = _BEGIN * (ORDER - 1) + word + _END
                    own = Counter(padded[i:i + ORDER] for i in range(len(word) + 1))
                    grams += own
                    times += own.values()
                    keys += [_key(word.encode())] * len(own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(grams, pa.string()), pa.array(keys, pa.int64()), pa.array(times, pa.int64())],
                    names=["gram", "key", "n"])

    # words and model grow with the documents: a merge join at every size
    steps = model.select("gram", *(F.round(F.col(c) * _STEPS).cast("long").alias(c) for c in names))
    sums = (words.select("word").mapInArrow(batches, "gram string, key long, n long").join(steps.hint("merge"), "gram")
            .groupBy("key").agg(*(F.sum(F.col("n") * F.col(c)).alias(c) for c in names)))
    return (sums.select("key", *(F.when(F.abs(c) >= neutral * _STEPS, F.col(c)).otherwise(0).alias(c) for c in names))
            .where(" OR ".join(f"{c} <> 0" for c in names)))


def _hashes(codes: np.ndarray, start: np.ndarray) -> np.ndarray:
    first, rest = _spelled(codes, start)
    return mix(first ^ mix(rest)).view(np.int64)


def commonest(model: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes, and ratios in steps, of the n-grams of ``model(gram, words, ...)`` that are in the most words: ``BUCKETS``
    at most, and all whose number of words has as many bits, or none of these."""
    names = [c for c in model.columns if c not in ("gram", "words")]
    steps = model.select("gram", F.length(F.bin("words")).alias("bits"), *(F.round(F.col(c) * _STEPS).cast("long").alias(c) for c in names))
    steps = steps.where(" AND ".join(f"abs({c}) < {(1 << 31) - 1}" for c in names))
    least, n = 65, 0
    for r in sorted(steps.groupBy("bits").count().collect(), reverse=True):  # 64 rows at most
        n += r["count"]
        if n > BUCKETS:
            break
        least = r.bits

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            codes = np.frombuffer("".join(batch.column(0).to_pylist()).encode("utf-32-le"), "<u4").astype(np.uint64)
            own = _hashes(codes, ORDER * np.arange(batch.num_rows))
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), *batch.columns[1:]], names=["hash", *names])

    table = (steps.where(F.col("bits") >= least).select("gram", *(F.col(c).cast("int") for c in names))
             .mapInArrow(batches, "hash long, " + ", ".join(f"{c} int" for c in names)).toArrow())  # BUCKETS rows at most
    hashes = table.column("hash").to_numpy()
    order = np.argsort(hashes)
    return hashes[order], np.stack([table.column(c).to_numpy()[order] for c in names])


class _Sums:
    """Ratios, in steps, of the words learned: ``sums``, a row for each model, at the ``place`` of a word; where ``joined``, not
    all of its n-grams are known."""

    def __init__(self, hashes: np.ndarray, ratios: np.ndarray):
        self.hashes, self.ratios = hashes, ratios
        self.clear(_KNOWN)

    def clear(self, size: int) -> None:
        self.place: dict[bytes, int] = {}
        self.sums, self.joined = np.zeros((len(self.ratios), size), np.int64), np.zeros(size, bool)

    def learn(self, words: set[bytes]) -> None:
        """All of ``words`` are known then, of others those that there is room for."""
        new = [w for w in words if w not in self.place]
        if len(self.place) + len(new) > len(self.joined):
            self.clear(max(_KNOWN, len(words)))
            new = list(words)
        if not new:
            return
        codes, start, n = _grams([w.decode() for w in new])
        grams, which = np.unique(_hashes(codes, start), return_inverse=True)
        at = np.searchsorted(self.hashes, grams)
        known = np.zeros(len(grams), bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == grams[inside]
        ratios = np.zeros((len(self.ratios), len(grams)), np.int64)
        ratios[:, known] = self.ratios[:, at[known]]
        first, lo, hi = np.append(0, np.cumsum(n)[:-1]), len(self.place), len(self.place) + len(new)
        self.joined[lo:hi] = ~np.logical_and.reduceat(known[which], first)
        self.sums[:, lo:hi] = np.add.reduceat(ratios[:, which], first, axis=1)
        self.sums[:, lo:hi][:, self.joined[lo:hi]] = 0
        self.place.update(zip(new, range(lo, hi)))


def evidence(docs: DataFrame, model: DataFrame) -> DataFrame:
    """(doc_id, n_words, ...): length-normalised difference of the log-likelihoods of every whole text, for each column
    of ``model(gram, ...)``, which holds every n-gram of ``docs``: of the telling words by the column's name, and of all by
    its name with ``_all``.  ``words`` is no such column, but says in how many words an n-gram is."""
    if "words" not in model.columns:
        model = model.withColumn("words", F.lit(1).cast("long"))
    names = [c for c in model.columns if c not in ("gram", "words")]
    columns = [*names, *(f"{c}_all" for c in names)]
    shared = docs.sparkSession.sparkContext.broadcast(commonest(model))
    hit = pa.list_(pa.struct([("key", pa.int64()), ("word", pa.string()), ("n", pa.int64())]))

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Sums(*shared.value)
        for batch in source:
            size = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            for lo, hi in slices(np.append(0, np.cumsum(size))):
                texts = [(t or "").lower().encode().split() for t in batch.column(1).slice(lo, hi - lo).to_pylist()]
                known.learn(set().union(*texts))
                n_words = np.fromiter(map(len, texts), np.int64, len(texts))
                words = list(chain.from_iterable(texts))
                at, ends = np.fromiter(map(known.place.__getitem__, words), np.int64, len(words)), np.append(0, np.cumsum(n_words))
                hits: list[Counter] = [Counter() for _ in texts]
                for k in np.flatnonzero(known.joined[at]).tolist():
                    hits[np.searchsorted(ends, k, "right") - 1][words[k]] += 1
                own = known.sums[:, at]
                sums = [np.append(0, np.cumsum(x)) for x in (*np.where(np.abs(own) >= NEUTRAL * _STEPS, own, 0), *own)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(n_words), *(pa.array(x[ends[1:]] - x[ends[:-1]]) for x in sums),
                     pa.array([[{"key": _key(w), "word": w.decode(), "n": n} for w, n in h.items()] for h in hits], hit)],
                    names=["doc_id", "n_words", *columns, "hits"])

    fields = ", ".join(["doc_id long, n_words long", *(f"{c} long" for c in columns), "hits array<struct<key:bigint,word:string,n:bigint>>"])
    rows = materialize(docs.mapInArrow(batches, fields).withColumn("row", F.monotonically_increasing_id()), "llm", "hits")
    words = rows.select(F.explode("hits.word").alias("word")).distinct()
    ratios = materialize(word_ratios(words, model.select("gram", *names), 0.0), "llm", "ratios")
    hits = rows.select("row", F.explode(F.expr("transform(hits, h -> struct(h.key, h.n))")).alias("h")).select("row", "h.*")
    telling = (F.when(F.abs(c) >= NEUTRAL * _STEPS, F.col(c)).otherwise(0) for c in names)
    sums = (hits.join(ratios.hint("merge"), "key")
            .groupBy("row").agg(*(F.sum(F.col("n") * x).alias(f"joined_{c}") for c, x in zip(columns, [*telling, *map(F.col, names)]))))
    return (rows.drop("hits").join(sums.hint("merge"), "row", "left")
            .select("doc_id", "n_words", *(
                F.when(F.col("n_words") == 0, 0.0)
                .otherwise((F.col(c) + F.coalesce(f"joined_{c}", F.lit(0))) / _STEPS / F.col("n_words")).alias(c) for c in columns)))


def fit_curve(binned: list[tuple[float, ...]]) -> tuple[float, ...]:
    """(slope, ..., intercept) of a logistic curve over (evidence, ..., ordinary rows, toxic rows).

    Newton steps, halved while they don't lessen the loss.  A weak pull to slope 20, to 0 of further evidence and even
    odds keeps separable or missing classes finite; the first slope is never below 1.
    """
    *x, ordinary, toxic = (np.array(v, float) for v in zip(*(binned or [(0.0, 0, 0)])))
    pull, rest = np.array([1e-3, *[1e-1] * (len(x) - 1), 1e-2]), np.array([20.0, *[0.0] * len(x)])
    design, at = np.stack([*x, np.ones_like(ordinary)], 1), rest

    def loss(at: np.ndarray) -> float:
        z = design @ at
        return float((ordinary * np.logaddexp(0, z) + toxic * np.logaddexp(0, -z)).sum() + (pull * (at - rest) ** 2).sum() / 2)

    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(design @ at, -500, 500)))
        gradient = design.T @ ((ordinary + toxic) * p - toxic) + pull * (at - rest)
        step = np.linalg.solve((design * ((ordinary + toxic) * p * (1 - p))[:, None]).T @ design + np.diag(pull), gradient)
        while loss(at - step) > loss(at) and np.abs(step).max() > 1e-9:
            step = step / 2
        at = at - step
        if np.abs(step).max() <= 1e-9:
            break
    return float(max(at[0], 1.0)), *map(float, at[1:])


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted, llr, llr_all, n_words), one row per row of ``docs``.

    ``labels(doc_id, toxic)``: rows without id or label are not learned from; of repeated
    labels of an id the larger counts.  Rows whose crc32 of the id as text modulo 3 is 1 are
    held out of learning.  A null id is not held out and never learned from.  A null or
    empty text has evidence 0.  Repeated rows give repeated results; other columns
    are not read.  Without any label every score is that of no evidence.  Words are told by 64-bit hashes.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    labels = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
              .where("doc_id is not null and toxic is not null")
              .groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic")))
    learn = _folded("doc_id") % 3 != 1
    curve = (_folded("doc_id") / 3).cast("long") % CURVE_ROWS == 0
    # labels grow with the documents: a merge join at every size, never a broadcast
    known = F.coalesce(learn, F.lit(False))
    # each different word is cut into n-grams once, not once in every task; tasks are as many as the documents', however many the
    # join has, since each lists its own words
    words = count_words(
        docs.where(known).join(labels.hint("merge"), "doc_id", "left").select("text", "toxic", curve.alias("held"))
        .unionByName(docs.where(~known).select("text", F.lit(None).cast("int").alias("toxic"), F.lit(False).alias("held")))
        .coalesce(max(1, docs.rdd.getNumPartitions())))
    words = words.groupBy("word").agg(*(F.sum(c).alias(c) for c in words.columns[1:]))
    grams = materialize(count_grams(words.withColumn("words", F.lit(1).cast("long"))), "llm", "grams")
    # both models by the same joins
    model = materialize(log_ratios(grams, {"llr": ("t + t_held", "o + o_held"), "rest": ("t", "o")}, keep=("words",)), "llm", "model")
    scored = materialize(evidence(docs, model), "llm", "evidence")
    # bins of both kinds of evidence, 401 each way at most; a bin stands at the mean of its rows
    steps = [F.round(F.least(F.greatest(c, F.lit(-5.0)), F.lit(5.0)) * _STEPS).cast("long") for c in ("rest", "rest_all")]
    binned = (scored.where(learn & curve).join(labels, "doc_id").select("toxic", *(x.alias(c) for x, c in zip(steps, "xy")))
              .groupBy(*(F.floor(F.col(c) * _BINS / _STEPS).alias(f"bin_{c}") for c in "xy"))
              .agg(F.sum("x").alias("x"), F.sum("y").alias("y"), F.count_if(F.col("toxic") == 0).alias("o"), F.count_if(F.col("toxic") == 1).alias("t")))
    slope, slope_all, intercept = fit_curve(sorted((r.x / _STEPS / (r.o + r.t), r.y / _STEPS / (r.o + r.t), r.o, r.t) for r in binned.collect())
                                            or [(0.0, 0.0, 0, 0)])
    score = 1 / (1 + F.exp(-(F.lit(slope) * F.col("llr") + F.lit(slope_all) * F.col("llr_all") + F.lit(intercept))))
    return (scored.withColumn("held_out", F.coalesce(_folded("doc_id") % 3 == 1, F.lit(False)))
            .withColumn("score", score).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
            .select("doc_id", "held_out", "score", "predicted", "llr", "llr_all", "n_words"))


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"),
                           spark.read.parquet(f"{sf_dir}/labels.parquet"))
