"""Operator 3: exact round trip through the tokenizer, and packing against bounds."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from anchorage.llm.packing import TOKENIZER, _Ids, best_fit, pack_documents, plan, reduce, sequences


@pytest.mark.parametrize("capacity, n, seed", [(2048, 20_000, 1), (100, 500, 2), (50, 60, 3), (10, 300, 4), (7, 40, 5)])
def test_plan_uses_every_piece_once_and_fits(capacity, n, seed):
    rnd = random.Random(seed)
    counts = {}
    for _ in range(n):
        x = min(capacity, max(1, int(rnd.lognormvariate(np.log(capacity / 4), 0.9))))
        counts[x] = counts.get(x, 0) + 1
    used, bins = {}, 0
    for m, items in plan(dict(counts), capacity):
        assert m > 0 and sum(x * k for x, k in items) <= capacity
        bins += m
        for x, k in items:
            used[x] = used.get(x, 0) + m * k
    assert used == counts
    assert bins <= max(1.02 * sum(x * k for x, k in counts.items()) / capacity, sum(m for m, _ in best_fit(dict(counts), capacity)) - 1) + 1


def fewest(lengths, capacity):
    """The least number of bins, by trying everything."""
    best = len(lengths)

    def place(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(lengths):
            best = len(rooms)
            return
        for i in {r: i for i, r in enumerate(rooms)}.values():
            if rooms[i] >= lengths[k]:
                place(k + 1, [r - lengths[k] * (j == i) for j, r in enumerate(rooms)])
        place(k + 1, [*rooms, capacity - lengths[k]])

    place(0, [])
    return best


@pytest.mark.parametrize("seed", range(400))
def test_reduction_never_costs_a_bin(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice([10, 13, 20])
    lengths = sorted((rnd.randint(1, capacity) for _ in range(rnd.randint(1, 9))), reverse=True)
    counts = {x: lengths.count(x) for x in lengths}
    fixed = sum(m for m, _ in reduce(counts, capacity))
    rest = sorted((x for x, k in counts.items() for _ in range(k)), reverse=True)
    assert fixed + (fewest(rest, capacity) if rest else 0) == fewest(lengths, capacity)


ODD = ["", None, "İstanbul J̌ H̱ Ａ  x", "a,b. c.d, e,, f.»", "don't we'll <|endoftext|>x <|ENDOFTEXT|>", "ſ K ΑΣ, ΣΑΣ.", "x" * 9000,
       "12,5. 3.", "é, ü. ñ,", "tab\tnew\r\nline\x0bv\x0c.", "😀, 漢字. 漢,"]


def test_pieces_round_trip(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(TOKENIZER))
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    rows = [(r.doc_id, r.text, 1) for r in real] + [(10_000 + k, t, 2) for k, t in enumerate(ODD)]
    rows += [(10_000, "", 2), (None, "no id", 3), (None, None, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int")
    got = pack_documents(docs, with_ids=True).cache()
    ids = {}
    for doc_id, text, _ in rows:
        own = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        ids.setdefault(doc_id, []).append(own)
    whole = {}
    for r in sorted(got.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.start)):
        assert r.length == len(r.ids) <= 2048 and r.start == 2048 * r.piece
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        whole.setdefault(r.doc_id, []).extend(r.ids)
    for k, lists in ids.items():
        assert sorted(whole[k]) == sorted(x for own in lists for x in own)
        if len(lists) == 1:
            assert whole[k] == lists[0]
    # gapless from 0 in each sequence
    at = {}
    for r in got.collect():
        at.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in at.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(at) <= 1.02 * sum(map(len, whole.values())) / 2048 + 2
    total = sequences(got).selectExpr("sum(size(ids)) AS n").first().n
    assert total == sum(map(len, whole.values()))


def test_words_have_the_ids_of_the_plain_tokenizer():
    tokenizer = Tokenizer.from_file(public_tokenizers.path(TOKENIZER))
    rnd = random.Random(8)
    tails = ["", "", ",", ".", "!!", "***", "&&&", "'s", "'", "-x", ").", "»", "9", "é", "×", "_"]
    letters = "etaoinshrdlucmfwypvbgkjqxz" * 3 + "éèüößÉÜçñÑ'"
    words = ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 14))) + rnd.choice(tails) for _ in range(60_000)]
    words += ["x" * 5000, "...", "<|", "|>", "a\u0301.", "\u0130,", "\0", "a\0b", "don't,", "'ll.", "1,000.", "ABC,", "ÉCOLE."]
    table = _Ids.of(TOKENIZER)
    texts = [" ".join(words[k: k + 40]) for k in range(0, len(words), 40)]
    data = [t.encode() for t in texts]
    ids, at = table.encode(np.frombuffer(b"".join(data), np.uint8), np.append(0, np.cumsum([len(d) for d in data])))
    for k, e in enumerate(tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert ids[at[k]: at[k + 1]].tolist() == e.ids


def test_no_documents(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
