"""Operator 13 against a plain tree."""

import hashlib
import random
import zlib

import duckdb
import pytest

from anchorage.llm import merkle
from test_operators import ODD, table

COLUMNS = "doc_id long, source string, lang string, n_chars int, text string, root string, pos string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def reduced(nodes, fan=3):
    """The root, and each leaf's siblings by level: (left, right)."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            first = i // fan * fan
            proofs[k].append((nodes[first:i], nodes[i + 1:first + fan]))
            at[k] = i // fan
        nodes = [h(*nodes[i:i + fan]) for i in range(0, len(nodes), fan)]
    return nodes[0], proofs


def brute(rows):
    by_source = {}
    for r in rows:
        by_source.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(r[:5]), r))
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    found = {s: reduced([x[2] for x in sorted(by_source[s], key=lambda x: x[:3])]) for s in names}
    root, top = reduced([found[s][0] for s in names])
    out = []
    for s, up in zip(names, top):
        for (*_, own, r), proof in zip(sorted(by_source[s], key=lambda x: x[:3]), found[s][1]):
            proof = proof + up
            claimed = own
            if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                claimed = leaf((*r[:4], r[4].replace("\n", "")))
            for left, right in proof:
                claimed = h(*left, claimed, *right)
            siblings = "".join("".join(left + right) for left, right in proof)
            out.append((r[0] is None, r[0] or 0, own, found[s][0], root, h(siblings), claimed, claimed == root))
    return sorted(out)


def rows_for(seed, sources, ids_null=True):
    rnd = random.Random(seed)
    rows, k = [], 0
    for s, n in sources:
        for _ in range(n):
            k += rnd.choice([1, 1, 2])
            rows.append((k, s, rnd.choice(["en", None, "ü"]), rnd.choice([None, k]), rnd.choice([*ODD[:9], f"a\nb{k}", f"c{k}"]), "x", "y"))
    rows += [rows[0], (rows[1][0], *rows[1][1:4], "other", "x", "y")]
    if ids_null:
        rows += [(None, None, None, None, None, None, None), (None, rows[0][1], None, None, "t\n", "x", "y")]
    rnd.shuffle(rows)
    return rows


def got(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in df.collect())


@pytest.mark.parametrize("levels, sources", [
    (6, [("a", 1), (None, 4), ("Ü", 28), ("é", 730)]),
    (1, [("a", 1), ("b", 2), ("c", 3), ("", 4), (None, 9), ("z", 10), ("😀", 28), ("￮", 82)]),
    (2, [("hot", 250), *((f"s{k}", 1 + k % 5) for k in range(40))])])
def test_manifest_equals_plain_trees(spark, levels, sources):
    rows = rows_for(levels, sources)
    docs = spark.createDataFrame(rows, COLUMNS)
    result = merkle.merkle_manifest(docs, claimed=merkle.without_line_feeds(), levels=levels)
    assert got(result) == brute(rows)


def test_proofs_fold_and_tampering_is_seen(spark):
    rows = rows_for(3, [("a", 40), ("b", 5)], ids_null=False)
    docs = spark.createDataFrame(rows, COLUMNS)
    for r in merkle.merkle_manifest(docs, with_proof=True, levels=1).collect():
        assert r.verified and merkle.folded(r.leaf, r.proof) == r.root
        assert merkle.folded(h("other"), r.proof) != r.root


def test_empty_table_and_one_row(spark):
    one = spark.createDataFrame([(None, None, None, None, None, "", "")], COLUMNS)
    assert merkle.merkle_manifest(one.limit(0)).collect() == []
    row = merkle.merkle_manifest(one).first()
    assert row.leaf == row.subroot == row.root == row.folded_root and row.verified and row.proof_sha256 == h("")


def test_sql_agrees_with_plain_trees(spark, tmp_path):
    rows = rows_for(5, [("a", 30), (None, 4), ("é", 7), ("B", 1)], ids_null=False)
    spark.createDataFrame(rows, COLUMNS).write.parquet(str(tmp_path / "documents"))
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents/*.parquet')")
    assert sorted((False, *r) for r in db.sql(merkle.OP13_SQL).fetchall()) == brute(rows)


def test_odd_texts(spark):
    rows, docs = table(spark, ODD)
    docs = docs.selectExpr("doc_id", "source", "cast(null as string) lang", "size n_chars", "text", "key")
    want = [(r[0], r[2], None, r[4], r[1], None, None) for r in rows]
    assert got(merkle.merkle_manifest(docs, claimed=merkle.without_line_feeds(), levels=1)) == brute(want)
