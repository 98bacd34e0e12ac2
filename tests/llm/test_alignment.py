"""Operator 11 against a token-by-token version with the plain encoders."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from anchorage.llm import alignment
from test_operators import ODD, corpus, table

TEXTS = ODD + corpus(11, 40) + [
    "<|endoftext|> <s> </s> <unk> <0x41>", "a\x00b", "▁x", "ﬁ ½ é   　x", "don't we'll  I'm\t\n 12345",
    " " * 9000 + "x", "\n" * 5000, "z" * 5000, "漢字" * 2000, " lead", "trail ", "😀👩‍👩‍👧"]


@pytest.fixture(scope="module")
def encoders():
    a = Tokenizer.from_file(public_tokenizers.path(alignment.A_VOCABULARY))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(alignment.B_VOCABULARY))


def brute_links(text, encoders):
    """(A ids, B ids, links as positions), or nothing where a side does not spell the text."""
    a, b = encoders
    byte = alignment.byte_alphabet()
    a_ids = a.encode(" " + text, add_special_tokens=False).ids if text else []
    b_ids = b.encode(text) if text else []
    a_bytes = [bytes(byte[c] for c in a.id_to_token(i)) for i in a_ids]
    b_bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()
               for p in map(b.id_to_piece, b_ids)]
    if not text or not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
        return [], [], []
    ends = {}
    at = 0
    for k, part in enumerate(a_bytes):
        at += len(part)
        ends[at] = k
    at, links = 0, []
    for k, part in enumerate(b_bytes):
        at += len(part)
        if at in ends:
            links.append((ends[at], k))
    return a_ids, b_ids, links


def brute(texts, encoders):
    found = [brute_links(t or "", encoders) for t in texts]
    count = Counter((a[i], b[j]) for a, b, links in found for i, j in links)
    most = defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    for a, b, links in found:
        groups, p, q = [], 0, 0
        for i, j in links:
            groups.append(",".join(map(str, a[p:i + 1])) + "|" + ",".join(map(str, b[q:j + 1])))
            p, q = i + 1, j + 1
        counts = [count[a[i], b[j]] for i, j in links]
        yield (len(a), len(b), len(groups), len(links), sum(n == most[b[j]] for n, (_, j) in zip(counts, links)), sum(counts),
               hashlib.sha256(";".join(groups).encode()).hexdigest() if a else "")


def rows_of(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)
                  for r in df.collect())


@pytest.mark.parametrize("held, lane", [(alignment.HELD, 2048), (50, 7), (1, 100)])
def test_alignment_equals_brute_force(spark, encoders, held, lane):
    rows, docs = table(spark, TEXTS)
    want = sorted((r[0] is None, r[0] or 0, *w) for r, w in zip(rows, brute([r[1] for r in rows], encoders)))
    n_b = len(alignment.Tokenizers.of(alignment.A_VOCABULARY, alignment.B_VOCABULARY).b.length)
    got = rows_of(alignment.with_pair_counts(alignment.align_documents(docs, lane=lane), n_b, held))
    assert got == want


def test_query_equals_brute_force_on_the_small_table(spark, encoders):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want = sorted((False, d.doc_id, *w) for d, w in zip(docs, brute([d.text for d in docs], encoders)))
    assert rows_of(alignment.op11_token_alignment(spark, "/root/testdata/sf0.001")) == want


def test_tokens_cuts_and_links(spark, encoders):
    _, docs = table(spark, TEXTS)
    texts = {r.doc_id: r.text for r in docs.where("doc_id is not null").collect()}
    for r in alignment.align_documents(docs, tokens=True, lane=13).where("doc_id is not null").collect():
        a, b, links = brute_links(texts[r.doc_id] or "", encoders)
        assert (r.a_ids, r.b_ids, [*zip(r.a_linked, r.b_linked)]) == (a, b, links)
        assert not r.cuts or r.cuts[-1] == len((" " + texts[r.doc_id]).encode())


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, pairs int")
    assert alignment.with_pair_counts(alignment.align_documents(empty), 32000).collect() == []


def test_links_of_random_offsets():
    rnd = random.Random(5)
    for lane in (1, 3, 64):
        bounds, a, b = [0], [], []
        for _ in range(30):
            n = rnd.choice([1, 2, 9, 200])
            for side in (a, b):
                side += [bounds[-1] + x for x in sorted({*(rnd.randint(1, n) for _ in range(n // 2)), n})]
            bounds.append(bounds[-1] + n)
        i, j = alignment.links_of(np.array(a), np.array(b), np.array(bounds), lane)
        assert [(a[x], b[y]) for x, y in zip(i, j)] == [(x, x) for x in sorted(set(a) & set(b))]


def test_text_with_a_piece_mark_or_special_strings(encoders):
    tools = alignment.Tokenizers.of(alignment.A_VOCABULARY, alignment.B_VOCABULARY)
    for text in TEXTS:
        if text:
            assert tools.encode_a(text) == encoders[0].encode(" " + text, add_special_tokens=False).ids
