"""Operators 1, 2, 4, 6, 7, 8 and 10 against brute force on small odd tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from anchorage.llm import chat, graph, jaccard_join, mixing, repetition, spotsigs, substring_dedup, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \n\t", "one", "One two", "a b c d", "A  b\nC\x0bd", "a b c d", "é É ü\x85x", "z" * 20_000, "w " * 5_000, "😀 漢字 " * 30]


def words_of(text):
    return WORD.findall(text or "")


def corpus(seed, n=120, long=80):
    """Random texts with copies, edited copies and shared passages."""
    rnd = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)] + ["the", "of", "and"] * 40
    passages = [[rnd.choice(vocabulary) for _ in range(rnd.randint(30, 70))] for _ in range(6)]
    texts = []
    for _ in range(n):
        kind = rnd.random()
        if texts and kind < 0.3:
            own = rnd.choice(texts).split(" ")
            for _ in range(rnd.choice([0, 0, 1, 2, 5])):
                own[rnd.randrange(len(own))] = rnd.choice(vocabulary)
        else:
            own = [rnd.choice(vocabulary) for _ in range(rnd.randint(1, long))]
            if kind < 0.6:
                at = rnd.randint(0, len(own))
                own[at:at] = rnd.choice(passages)
        texts.append(" ".join(own))
    return texts


def table(spark, texts, first=0):
    """Rows with clashing column names, repeated rows, a repeated id and null ids."""
    rows = [(first + 3 * k, t, f"s{k % 3}" if k % 7 else None, "x", 1) for k, t in enumerate(texts)]
    rows += [rows[1], rows[-1], (None, texts[0], None, None, None), (None, None, None, None, None)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, key string, size int")


@pytest.fixture(scope="module")
def odd_rows(spark):
    return table(spark, ODD + corpus(1))


# --- 4 ---------------------------------------------------------------------------------

def shingles(text, k):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = words_of(lower)
    return {tuple(w[i:i + k]) for i in range(max(len(w) - k + 1, min(len(w), 1)))}


def brute_components(rows, k, percent):
    sets = {}
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            sets.setdefault(doc_id, []).append(shingles(text, k))
    least = {d: d for d in sets}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = sorted((find(a), find(b)))
                least[y] = x
    return {d: find(d) for d in ids}


@pytest.mark.parametrize("seed, k, percent, long", [(1, 4, 85, 80), (2, 4, 85, 400), (3, 1, 60, 40), (4, 2, 70, 12), (5, 5, 80, 60)])
def test_components_equal_brute_force(spark, seed, k, percent, long):
    rows, docs = table(spark, ODD + corpus(seed, 150, long))
    want = brute_components(rows, k, percent)
    got = jaccard_join.jaccard_components(docs, k=k, percent=percent).collect()
    assert len(got) == len(rows)
    texts = {}
    for doc_id, text, *_ in rows:
        texts.setdefault(doc_id, set()).add(len(shingles(text, k)))
    for r in got:
        assert r.component_id == (None if r.doc_id is None else want[r.doc_id])
        assert r.n_shingles in texts[r.doc_id]


def test_blocks_and_degenerate_documents_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 3)
    plain = jaccard_join.bands
    monkeypatch.setattr(jaccard_join, "bands", lambda percent: (
        (b := plain(percent))[0], b[1], np.where(b[1] > 0, b[1] + 1, 0)))  # so few cells that many sets are degenerate
    rows, docs = table(spark, corpus(9, 120, 60))
    want = brute_components(rows, 4, 85)
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(docs).collect() if r.doc_id is not None}
    assert got == want


def test_large_group_of_near_copies_with_an_outlier_on_its_keys(spark, monkeypatch):
    """Near copies are a third of all rows; a few texts share keys with them without being linked to them."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    monkeypatch.setattr(jaccard_join, "_FLUSH", 300)
    rnd = random.Random(6)
    base = [f"b{i}" for i in range(120)]
    texts = [" ".join(base[:i] + [f"x{i}"] + base[i + 1:]) for i in range(60)]
    texts += [" ".join(base[:40] + [f"o{j}.{i}" for i in range(30)] + base[70:]) for j in range(4)]
    texts += [" ".join(f"w{rnd.randrange(10 ** 6)}" for _ in range(100)) for _ in range(116)]
    rnd.shuffle(texts)
    rows, docs = table(spark, texts)
    want = brute_components(rows, 4, 85)
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(docs).collect() if r.doc_id is not None}
    assert got == want and max(Counter(got.values()).values()) >= 60


def test_rows_outside_a_component_are_dealt_not_all_rows(spark):
    """One key of 20 blocks in one component and 3 rows outside: the cost is small side by large side."""
    n = 20 * jaccard_join.BLOCK
    rows = (spark.range(n + 3).select(F.lit(7).alias("key"), F.col("id").alias("doc"), F.greatest(F.lit(0), F.col("id") - (n - 1)).alias("component"))
            .unionByName(spark.range(n).selectExpr("8 AS key", "id AS doc", "0L AS component")))
    sketches = spark.range(n + 3).selectExpr("id AS doc", "1 AS n", "CAST('x' AS BINARY) AS sketch")
    got = jaccard_join.dealt(rows, sketches).groupBy("key", "x", "y").agg(F.count(F.lit(1)).alias("size")).collect()
    assert {r.key for r in got} == {7}
    assert sum(r.size for r in got) <= n + 3 + 3 * 21
    assert max(r.size for r in got) <= 2 * jaccard_join.BLOCK


def test_sketch_distance_never_exceeds_the_difference():
    rnd = np.random.default_rng(3)
    for _ in range(300):
        a = rnd.integers(0, 1 << 63, rnd.integers(1, 200)).astype(np.uint64)
        b = np.unique(np.concatenate([a[rnd.integers(0, len(a)):], rnd.integers(0, 1 << 63, rnd.integers(0, 150)).astype(np.uint64)]))
        a = np.unique(a)
        differ = len(np.setxor1d(a, b))
        if len(b):
            assert jaccard_join.distance(jaccard_join.bit_sketch(a), jaccard_join.bit_sketch(b)) <= differ


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(200, 260)] + [(300, 301), (301, 302), (302, 300), (5, 5)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 100 for k in range(100, 161)}, **{k: 7 for k in [7, *range(200, 260)]}, 300: 300, 301: 300, 302: 300}
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


# --- 7 ---------------------------------------------------------------------------------

def brute_removed(rows, n):
    first = {}
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            w = words_of(text)
            for i in range(len(w) - n + 1):
                first[tuple(w[i:i + n])] = min(first.get(tuple(w[i:i + n]), doc_id), doc_id)
    out = []
    for doc_id, text, *_ in rows:
        w = words_of(text)
        gone = set()
        if doc_id is not None:
            for i in range(len(w) - n + 1):
                if first[tuple(w[i:i + n])] < doc_id:
                    gone.update(range(i, i + n))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


def in_order(rows):
    return sorted(rows, key=lambda r: tuple((v is not None, v) for v in r))


@pytest.mark.parametrize("window", [50, 20, 7, 2])
def test_repeats_removed_equal_brute_force(spark, window):
    rows, docs = table(spark, ODD + corpus(window, 100, 90))
    got = substring_dedup.remove_repeats(docs, window=window, with_text=True).collect()
    assert in_order(map(tuple, got)) == in_order(brute_removed(rows, window))


# --- 10 --------------------------------------------------------------------------------

def brute_quality(text):
    text = text or ""
    w = words_of(text)
    chars = sum(map(len, w))

    def inside(n):
        seen = {}
        for i in range(len(w) - n + 1):
            seen.setdefault(tuple(w[i:i + n]), []).append(i)
        return {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + n)}

    lines, dup_lines, dup_chars = set(), 0, 0
    for line in text.split("\n"):
        if words_of(line):
            if line in lines:
                dup_lines += 1
                dup_chars += sum(map(len, words_of(line)))
            lines.add(line)
    dup = {n: sum(len(w[j]) for j in inside(n)) for n in (5, 7, 10)}
    failed = len(w) < 10 or 100 * len(inside(5)) > 20 * len(w)
    kept = not failed and 100 * dup_chars <= 30 * chars and all(100 * dup[n] <= p * chars for n, p in ((5, 20), (7, 15), (10, 10)))
    return (len(w), chars, len(re.findall(r"[#*$%&|<>]", text)), dup_lines, len(inside(5)), dup_chars, dup[5], dup[7], dup[10], failed, kept)


def test_quality_equals_brute_force(spark):
    texts = ODD + corpus(5, 60) + ["a # b $ | x\n\n b\nb\n b\nb \nsame line here\nsame line here\n", "x y z w v u " * 40,
                                   " ".join(f"a{k}" for k in range(60)) + " " + " ".join(f"a{k}" for k in range(8))]
    rows, docs = table(spark, texts)
    got = repetition.repetition_quality(docs).collect()
    assert in_order(map(tuple, got)) == in_order((i, *brute_quality(t)) for i, t, *_ in rows)
    kept = repetition.keep_good(docs)
    assert kept.columns == docs.columns
    assert in_order(map(tuple, kept.collect())) == in_order(r for r in rows if brute_quality(r[1])[-1])


# --- 2 ---------------------------------------------------------------------------------

def test_mix_meets_its_targets(spark):
    rows, docs = table(spark, ODD + corpus(6, 400))
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(rows)
    assert in_order((r.doc_id, r.size) for r in got) == in_order((i, len(words_of(t))) for i, t, *_ in rows)
    groups = {}
    for r in got:
        assert r.taken % r.size == 0 and r.taken <= 2 * r.size if r.size else r.taken == 0
        groups.setdefault((r.source_size, r.target), []).append(r)
    assert len(groups) == 4
    total = sum(r.size for r in got)
    assert abs(sum(target for _, target in groups) - 1.5 * total) < 1e-6 * total
    for (source_size, target), own in groups.items():
        assert target <= 2 * source_size + 1e-9
        assert abs(sum(r.taken for r in own) - target) <= 2 * max(r.size for r in own)
    assert in_order(map(tuple, got)) == in_order(map(tuple, mixing.mix_sources(docs).collect()))
    taken = mixing.mixed(docs)
    assert taken.columns == docs.columns
    assert sum(len(words_of(r.text)) for r in taken.collect()) == sum(r.taken for r in got)


def test_targets_by_repeated_resharing(spark):
    sizes = [("a", 100), ("b", 1000), ("c", 50), ("d", 5000), ("e", 0), (None, 300)]
    df = spark.createDataFrame([(s is None, s or "", n) for s, n in sizes], "no_source boolean, source string, source_size long")
    got = {r.source if not r.no_source else None: r.target for r in mixing.source_targets(df).collect()}
    weights = {s: (3, 1, 2)[k % 3] for k, (s, _) in enumerate(sizes)}
    caps, left, full = {s: 2 * n for s, n in sizes}, 1.5 * sum(n for _, n in sizes), {}
    while True:
        rest = [s for s, _ in sizes if s not in full]
        share = {s: left * weights[s] / sum(weights[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] > caps[s]]
        if not over:
            break
        for s in over:
            full[s] = caps[s]
            left -= caps[s]
    assert got == pytest.approx({**share, **full})


# --- 6 ---------------------------------------------------------------------------------

def test_fingerprints_of_edited_and_next_texts(spark):
    rows, docs = table(spark, ODD + corpus(8, 60))
    order = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).orderBy(
        F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).collect()
    prints = {r.doc_id: r for r in spotsigs.fingerprints(docs).collect()}
    want = []
    for k, r in enumerate(order):
        after, n = order[(k + 1) % len(order)].text, len(r.text)
        edited = r.text[: n - n // 4] + after[: n // 4]
        a, e, b = (s for t in (r.text, edited, after) for s in spotsigs.signature_sets(spotsigs._word_hashes([t.encode()])))
        want.append((r.doc_id, n, hashlib.sha256(edited.encode()).hexdigest(), spotsigs.as_text(a), spotsigs.as_text(e),
                     jaccard(a, e), jaccard(a, b)))
        if r.doc_id is not None:
            assert prints[r.doc_id].fingerprint == spotsigs.as_text(a)
    got = spotsigs.edited_fingerprints(docs).collect()
    assert in_order(map(tuple, got)) == in_order(want)


def jaccard(a, b):
    a, b = set(a.tolist()), set(b.tolist())
    return len(a & b) / len(a | b) if a | b else 1.0


def test_signatures_follow_their_definition():
    words = "the quick of brown and fox jumps over the dog".split()
    sets = spotsigs.signature_sets(spotsigs._word_hashes([" ".join(words).encode(), b"", b"lone word"]))
    assert [len(s) for s in sets] == [3, 0, 2]  # the quick brown, of brown fox, and fox jumps; no chain after the last the


@pytest.mark.parametrize("least", [0.5, 0.8])
def test_alike_pairs_equal_brute_force(spark, least):
    rows, docs = table(spark, corpus(11, 80))
    prints = spotsigs.fingerprints(docs).cache()
    sets = {r.fingerprint: set(r.signatures) for r in prints.collect() if r.signatures}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]) - 1e-12}
    assert {(r.a, r.b) for r in spotsigs.alike_pairs(prints, least).collect()} == want


# --- 1 ---------------------------------------------------------------------------------

def test_toxic_words_are_learned_and_held_out_labels_are_not(spark):
    rnd = random.Random(4)
    plain, bad = [f"{a}{b}{c}" for a in "bdfgl" for b in "aeiou" for c in "mnrst"], ["zorkish", "quaxter", "vyxomat"]
    rows, labels = [], []
    for k in range(900):
        toxic = k % 5 == 0
        own = [rnd.choice(plain) for _ in range(rnd.randint(30, 120))]
        for _ in range(len(own) // 25 if toxic else 0):
            own[rnd.randrange(len(own))] = rnd.choice(bad)
        rows.append((k, " ".join(own), k))
        held = zlib.crc32(str(k).encode()) % 3 == 1
        labels.append((k, int(toxic) if not held else 1 - int(toxic)))  # wrong where they must not be read
    rows += [(None, None, 0), (5_000, "", 0), (5_001, "x" * 100_000, 0), rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = toxicity.toxicity_scores(docs, spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, toxic int")).collect()
    assert len(got) == len(rows)
    right = 0
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        if r.doc_id is not None and r.doc_id < 900:
            right += r.predicted == int(r.doc_id % 5 == 0)
    assert right >= 0.97 * 900


def test_toxicity_without_rows_or_labels(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.toxicity_scores(spark.createDataFrame([], "doc_id long, text string"), none).collect() == []
    got = toxicity.toxicity_scores(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), none).collect()
    assert [(r.score, r.predicted) for r in got] == [(0.5, 0)]


def test_shared_backoff_is_a_distribution(spark):
    words = spark.createDataFrame([("abc", 3, 1), ("abd", 0, 5), ("b", 1, 0), ("acabac", 2, 2)], "word string, t long, o long")
    p = toxicity.shared_backoff(toxicity.count_grams(words))
    for r in p.groupBy(F.col("gram").substr(1, 3).alias("h")).agg(F.sum("p").alias("p")).collect():
        assert r.p <= 1 + 1e-9


def test_curve_is_finite_on_any_rows():
    for rows in ([], [(0.1, 5, 0)], [(0.1, 0, 5)], [(-1, 9, 0), (1, 0, 9)], [(-1, 0, 9), (1, 9, 0)], [(0.0, 1000, 1)]):
        slope, intercept = toxicity.fit_curve(rows)
        assert np.isfinite([slope, intercept]).all() and slope >= 1


def plain_ratios(words):
    """{n-gram: log ratio} and {context: log ratio of an unseen n-gram in it}, from {word: (toxic, ordinary)}."""
    n, d = toxicity.ORDER, toxicity.DISCOUNT
    counts = {}
    for w, (t, o) in words.items():
        padded = "\x02" * (n - 1) + w + "\x03"
        for i in range(len(w) + 1):
            a, b = counts.get(padded[i:i + n], (0, 0))
            counts[padded[i:i + n]] = a + t, b + o
    below, levels = set(counts), []
    for _ in range(n - 1):
        level = {}
        for g in below:
            level[g[1:]] = level.get(g[1:], 0) + 1
        levels.append(level)
        below = set(level)
    p = {g: c / sum(levels[-1].values()) for g, c in levels[-1].items()}
    for level in reversed(levels[:-1]):
        of = {}
        for g, c in level.items():
            of.setdefault(g[:-1], []).append(c)
        p = {g: (c - d + d * len(of[g[:-1]]) * p[g[1:]]) / sum(of[g[:-1]]) for g, c in level.items()}
    of = {}
    for g, both in counts.items():
        of.setdefault(g[:-1], []).append(both)

    def weight(h, k):
        own = [both[k] for both in of[h] if both[k]]
        return (d * len(own) / sum(own), sum(own)) if own else (1.0, 0)

    def prob(g, k):
        w, total = weight(g[:-1], k)
        return w * p[g[1:]] + (max(counts[g][k] - d, 0) / total if total else 0)

    return ({g: np.log(prob(g, 0)) - np.log(prob(g, 1)) for g in counts},
            {h: np.log(weight(h, 0)[0]) - np.log(weight(h, 1)[0]) for h in of})


def scored_words(spark, counted, others):
    words = spark.createDataFrame([(w, *counted.get(w, (0, 0))) for w in (*counted, *others)], "word string, t long, o long")
    ratios = toxicity.word_ratios(words, toxicity.log_ratios(toxicity.count_grams(words)))
    return {r.key: r.llr / 1e8 for r in ratios.collect()}


def test_every_counted_gram_of_a_word_has_its_ratio(spark):
    rnd = random.Random(12)
    counted = {"".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 9))): (rnd.choice([0, 0, 3, 40]), rnd.choice([0, 1, 30])) for _ in range(300)}
    counted = {w: c for w, c in counted.items() if any(c)}
    seen, _ = plain_ratios(counted)
    got = scored_words(spark, counted, [])
    want = {}
    for w in counted:
        padded = "\x02" * 4 + w + "\x03"
        want[w] = sum(seen[padded[i:i + 5]] for i in range(len(w) + 1))
    assert {toxicity._key(w.encode()) for w in want if abs(want[w]) >= toxicity.NEUTRAL} == set(got)
    for w in want:
        assert got.get(toxicity._key(w.encode()), want[w]) == pytest.approx(want[w], abs=1e-6)


def test_unseen_grams_back_off_to_their_context(spark):
    counted = {"zorkish": (60, 1), "zorkbar": (50, 0), "plainly": (1, 90), "plainest": (0, 70), "zebra": (0, 80)}
    others = ["zorky", "zorkzork", "plainzz", "qqq", "zorkishness", ""]
    seen, backoff = plain_ratios(counted)
    got = scored_words(spark, counted, others)
    for w in (*counted, *others):
        padded = "\x02" * 4 + w + "\x03"
        grams = [padded[i:i + 5] for i in range(len(w) + 1)]
        want = sum(seen[g] if g in seen else backoff.get(g[:4], 0.0) for g in grams)
        assert got.get(toxicity._key(w.encode()), 0.0) == pytest.approx(want if abs(want) >= toxicity.NEUTRAL else 0.0, abs=1e-6)
    padded = "\x02" * 4 + "zorky" + "\x03"
    assert any(padded[i:i + 5] not in seen and backoff.get(padded[i:i + 4]) for i in range(6))


def test_words_of_the_curve_rows_alone_are_learned(spark):
    ids = [k for k in range(4000) if zlib.crc32(str(k).encode()) % 3 != 1]
    held = [k for k in ids if zlib.crc32(str(k).encode()) // 3 % toxicity.CURVE_ROWS == 0]
    rows = [(k, "calm plain text " * 5 + ("zorkish " * 5 if k % 2 else "")) for k in ids if k not in held]
    rows += [(k, "calm plain text " * 5 + ("quaxter " * 5 if k % 2 else "")) for k in held]
    labels = spark.createDataFrame([(k, k % 2) for k, _ in rows], "doc_id long, toxic int")
    rows += [(90_000, "quaxter quaxter calm plain"), (90_001, "calm plain")]
    got = {r.doc_id: r.llr for r in toxicity.toxicity_scores(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()}
    assert got[90_000] > 1 and got[90_001] <= 0


def test_the_model_has_no_bound(spark):
    words = spark.createDataFrame([(f"w{k}x{k * k}", k % 3, 2) for k in range(50)], "word string, t long, o long")
    grams = toxicity.count_grams(words)
    model = toxicity.log_ratios(grams)
    assert model.count() == grams.count() and "Limit" not in model._jdf.queryExecution().toString()


def test_shared_bounds_lose_no_word(spark, monkeypatch):
    counted = {"zorkish": (60, 1), "zorkbar": (50, 0), "plainly": (1, 90), "plainest": (0, 70), "zebra": (0, 80)}
    texts = ["zorkish plainly zorky", "Zebra zebra zorkzork x", "plainest", "", None]
    words = {w: counted.get(w, (0, 0)) for t in [*texts, *counted] for w in (t or "").lower().split()}
    model = toxicity.log_ratios(toxicity.count_grams(spark.createDataFrame([(w, *c) for w, c in words.items()], "word string, t long, o long")))
    ratio = scored_words(spark, counted, [w for w in words if w not in counted])
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, texts[0])], "doc_id long, text string")
    for buckets in (1 << 16, 4):  # with 4 nearly every word must be joined
        monkeypatch.setattr(toxicity, "BUCKETS", buckets)
        got = {(r.doc_id, r.n_words): r.llr for r in toxicity.evidence(docs, model).collect()}
        assert len(got) == len(texts) + 1
        for doc_id, text in [*enumerate(texts), (None, texts[0])]:
            own = (text or "").lower().split()
            want = sum(ratio.get(toxicity._key(w.encode()), 0.0) for w in own) / max(len(own), 1)
            assert got[doc_id, len(own)] == pytest.approx(want, abs=1e-6)


# --- 8 ---------------------------------------------------------------------------------

def brute_pair(c, r):
    n = 0
    while n < min(len(c), len(r)) and c[n] == r[n]:
        n += 1

    def render(turns):
        text, mask = "", []
        for role, body in turns:
            text += f"<|{role or ''}|>\n"
            if role == "assistant":
                mask.append(f"{len(text)}:{len(text) + len(body or '') + 8}")
            text += f"{body or ''}<|end|>\n"
        return text, ",".join(mask)

    return (n, render(c[:n])[0], *(render(x[n:])[0] for x in (c, r)), *(render(x[n:])[1] for x in (c, r)))


def test_preference_pairs_equal_brute_force(spark):
    rnd = random.Random(2)
    chosen, rejected = [], []
    for pair in range(60):
        common = [(rnd.choice(["user", "assistant", "system", None]), rnd.choice(["hi", "é😀", "", None, "long " * 20])) for _ in range(rnd.randint(0, 4))]
        for side in (chosen, rejected):
            own = common + [(rnd.choice(["user", "assistant"]), rnd.choice(["x", "y", None])) for _ in range(rnd.randint(0, 3))]
            side += [(pair if pair else None, k, role, text, 0) for k, (role, text) in enumerate(own)]
    schema = "pair_id long, turn long, role string, text string, side int"
    got = chat.preference_pairs(spark.createDataFrame(chosen, schema), spark.createDataFrame(rejected, schema)).collect()
    pairs = {r[0] for r in chosen + rejected} - {None}
    assert {r.pair_id for r in got} == pairs and len(got) == len(pairs)
    for r in got:
        c, j = ([(role, text) for p, _, role, text, _ in side if p == r.pair_id] for side in (chosen, rejected))
        assert tuple(r)[1:] == brute_pair(c, j)
    none = spark.createDataFrame([], schema)
    assert chat.preference_pairs(none, none).collect() == []


@pytest.mark.parametrize("run", [
    jaccard_join.jaccard_components, substring_dedup.remove_repeats, repetition.repetition_quality, repetition.keep_good,
    mixing.mix_sources, mixing.mixed, spotsigs.edited_fingerprints, spotsigs.fingerprints])
def test_empty_table(spark, run):
    assert run(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []


def test_words_are_listed_by_no_more_tasks_than_the_documents_have(spark, monkeypatch):
    tasks, count_words = [], toxicity.count_words

    def seen(rows):
        tasks.append(rows.rdd.getNumPartitions())
        return count_words(rows)

    monkeypatch.setattr(toxicity, "count_words", seen)
    docs = spark.createDataFrame([(k, f"calm word{k % 7}") for k in range(60)], "doc_id long, text string").repartition(2)
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "evidence", lambda *a: (_ for _ in ()).throw(InterruptedError))  # the words are all that is looked at
    with pytest.raises(InterruptedError):
        toxicity.toxicity_scores(docs, labels)
    assert tasks and max(tasks) <= 2


def test_components_hand_python_small_batches(spark, monkeypatch):
    key, seen, linked = "spark.sql.execution.arrow.maxRecordsPerBatch", [], jaccard_join._linked

    def watched(*a):
        seen.append(int(spark.conf.get(key)))
        return linked(*a)

    monkeypatch.setattr(jaccard_join, "_linked", watched)
    before = spark.conf.get(key)
    docs = spark.createDataFrame([(k, f"a b c d e {k // 2}") for k in range(6)], "doc_id long, text string")
    assert jaccard_join.jaccard_components(docs).count() == 6
    assert seen and max(seen) <= 1000 and spark.conf.get(key) == before


def test_grams_are_counted_over_several_flushes(spark, monkeypatch):
    rnd = random.Random(5)
    own = [("".join(rnd.choice("ab\x02é\u4e2d😀") for _ in range(rnd.randint(0, 12))), rnd.randint(0, 3), rnd.randint(0, 9)) for _ in range(400)]
    own.append(("x😀" * 9000, 2, 1))
    want = {}
    for word, *n in own:
        padded = "\x02" * 4 + word + "\x03"
        for i in range(len(word) + 1):
            want[padded[i:i + 5]] = tuple(a + b for a, b in zip(want.get(padded[i:i + 5], (0, 0)), n))
    words = spark.createDataFrame(own, "word string, t long, o long")
    for flush in (toxicity._FLUSH, 50):
        monkeypatch.setattr(toxicity, "_FLUSH", flush)
        assert {r.gram: (r.t, r.o) for r in toxicity.count_grams(words).collect()} == want


def test_both_models_share_their_joins(spark):
    rnd = random.Random(6)
    words = spark.createDataFrame([("".join(rnd.choice("abcdé") for _ in range(rnd.randint(1, 7))), *(rnd.choice([0, 0, 1, 9]) for _ in range(4)))
                                   for _ in range(300)], "word string, t long, o long, t_held long, o_held long")
    grams = toxicity.count_grams(words).cache()

    def ratios(rows, name="llr"):
        return {r.gram: r[name] for r in rows.collect()}

    both = toxicity.log_ratios(grams, {"llr": ("t + t_held", "o + o_held"), "rest": ("t", "o")})
    alone = toxicity.log_ratios(grams.selectExpr("gram", "t + t_held AS t", "o + o_held AS o"))
    assert ratios(both) == pytest.approx(ratios(alone))
    rest = ratios(toxicity.log_ratios(grams.select("gram", "t", "o")))
    assert ratios(both, "rest") == pytest.approx({g: rest.get(g, 0.0) for g in ratios(both)})
    exchanges = [rows._jdf.queryExecution().sparkPlan().toString().count("Join") +
                 rows._jdf.queryExecution().executedPlan().toString().count("Exchange") for rows in (both, alone)]
    assert exchanges[0] == exchanges[1]


def test_every_word_weighs(spark, monkeypatch):
    counted = {"zorkish": (60, 1), "zorkbar": (50, 0), "plainly": (9, 11), "plainest": (4, 5), "zebra": (7, 9)}
    texts = ["plainly zebra plainest plainly", "zorkish Zebra zorky", "zorkzork x", "", None]
    words = {w: counted.get(w, (0, 0)) for t in [*texts, *counted] for w in (t or "").lower().split()}
    rows = spark.createDataFrame([(w, *c) for w, c in words.items()], "word string, t long, o long")
    model = toxicity.log_ratios(toxicity.count_grams(rows))
    seen, backoff = plain_ratios(counted)

    def ratio(w):
        padded = "\x02" * 4 + w + "\x03"
        return sum(seen[g] if g in seen else backoff.get(g[:4], 0.0) for g in (padded[i:i + 5] for i in range(len(w) + 1)))

    assert any(0 < abs(ratio(w)) < toxicity.NEUTRAL for w in counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for buckets in (1 << 16, 4):  # with 4 every word must be joined
        monkeypatch.setattr(toxicity, "BUCKETS", buckets)
        got = {r.doc_id: r for r in toxicity.evidence(docs, model).collect()}
        for k, text in enumerate(texts):
            own = [ratio(w) for w in (text or "").lower().split()]
            assert got[k].llr_all == pytest.approx(sum(own) / max(len(own), 1), abs=1e-6)
            assert got[k].llr == pytest.approx(sum(x for x in own if abs(x) >= toxicity.NEUTRAL) / max(len(own), 1), abs=1e-6)


def test_curve_weighs_further_evidence():
    rnd = random.Random(8)
    rows = []
    for _ in range(3000):
        x, y = rnd.gauss(0, 1), rnd.gauss(0, 1)
        toxic = rnd.random() < 1 / (1 + np.exp(-(3 * x - 2 * y - 1)))
        rows.append((x, y, 1 - toxic, int(toxic)))
    assert toxicity.fit_curve(rows) == pytest.approx((3, -2, -1), abs=0.4)
    assert toxicity.fit_curve([(0.0, 0.0, 0, 0)]) == pytest.approx((20, 0, 0))
