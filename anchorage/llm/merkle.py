"""Operator 13, Merkle dataset manifest: cogrouped subtree exchange.

Every document is a leaf.  The leaves of a source, in order of their ids, are hashed up in runs
of ``FAN`` to the source's subroot, the subroots likewise to the root.  A tree is cut into superblocks of
``FAN ** LEVELS`` neighbours, so one task holds one superblock and no more, however large a source is.

Up: the nodes of each superblock are reduced to one, these are the nodes of the next tier, until every
source has one node; then the same over the sources.  Down: the nodes of each
superblock and the outer nodes above it (the siblings of all its ancestors) are cogrouped by
superblock; ``applyInPandas`` does the local reduction again, joins local and outer siblings to the proofs of its
nodes, and on the last tier folds them.  Every tier is 729 times smaller than the one below; each is a written table.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorage.operators.ranking import with_rank
from anchorage.session import materialize

FAN = 3
LEVELS = 6
KEY = ["has_source", "source"]
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
_NODE = "has_source boolean, source string, pos long, node string"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def levels_of(nodes: list[str], block: int, fan: int, levels: int) -> list[list[str]]:
    """The nodes of a superblock and of all levels above them inside it.

    The first superblock of a tree is reduced until one node is left, which takes ``levels`` steps if it
    is full; if it isn't, the tree has no other.  Any later one is reduced ``levels`` times, even if it has one node.
    """
    all_levels = [nodes]
    while len(nodes) > 1 or (block and len(all_levels) <= levels):
        nodes = [digest("".join(nodes[k: k + fan])) for k in range(0, len(nodes), fan)]
        all_levels.append(nodes)
    return all_levels


def proofs_of(all_levels: list[list[str]], outer: str, fan: int) -> list[str]:
    """The proof of each node of the lowest level: ``left|right`` siblings, level by level joined by ``;``.

    ``outer`` is the proof of the superblock's own node.
    """
    proofs = [outer]
    for nodes in reversed(all_levels[:-1]):
        below = []
        for k in range(len(nodes)):
            first = k - k % fan
            above = proofs[k // fan]
            below.append("".join(nodes[first:k]) + "|" + "".join(nodes[k + 1: first + fan]) + (";" + above if above else ""))
        proofs = below
    return proofs


def siblings_of(proof: str) -> str:
    """The digests of a proof, left to right, level by level."""
    return proof.replace("|", "").replace(";", "")


def folded(leaf: str, proof: str) -> str:
    """The root that a leaf and the siblings of a proof give."""
    for level in proof.split(";") if proof else ():
        left, right = level.split("|")
        leaf = digest(left + leaf + right)
    return leaf


def leaf_of(values: list[Column]) -> Column:
    """Digest of the values as text: ``-`` for a null, else count of UTF-8 bytes, ``:``, value."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def _blocks(nodes: DataFrame, fan: int, levels: int) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"pos div {fan ** levels}L"))


def _tiers(nodes: DataFrame, fan: int, levels: int) -> list[DataFrame]:
    """``nodes(has_source, source, pos, node)`` and the tiers above, up to one node for each tree."""
    def up(rows: pd.DataFrame) -> pd.DataFrame:
        block = int(rows["block"].iloc[0])
        top = levels_of(rows.sort_values("pos")["node"].tolist(), block, fan, levels)[-1]
        return rows[KEY].iloc[:1].assign(pos=block, node=top)

    tiers = [nodes]
    while (tiers[-1].agg(F.max("pos")).first()[0] or 0) > 0:  # one number
        tiers.append(materialize(_blocks(tiers[-1].select(*KEY, "pos", "node"), fan, levels)
                                 .groupBy(*KEY, "block").applyInPandas(up, _NODE), "llm", "tier"))
    return tiers


def _down(nodes: DataFrame, outer: DataFrame, fan: int, levels: int, out: str, finish) -> DataFrame:
    """Superblocks of ``nodes`` cogrouped with their rows of ``outer(has_source, source, block, proof, ...)``.

    ``finish`` makes the result of the rows of a superblock, their proofs and the outer row.
    """
    def exchange(rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        rows, above = rows.sort_values("pos", ignore_index=True), above.iloc[0]
        local = levels_of(rows["node"].tolist(), int(rows["block"].iloc[0]), fan, levels)
        return finish(rows, proofs_of(local, above["proof"], fan), above)

    by = [*KEY, "block"]
    return _blocks(nodes, fan, levels).groupBy(*by).cogroup(outer.groupBy(*by)).applyInPandas(exchange, out)


def _outer(tiers: list[DataFrame], above: DataFrame, fan: int, levels: int, extra: list[str]) -> DataFrame:
    """``above``, one row for the top node of each tree, brought down to the nodes of the tier ``tiers[1]``."""
    schema = ("has_source boolean, source string, block long, proof string, " + ", ".join(f"{c} string" for c in extra))

    def finish(rows: pd.DataFrame, proofs: list[str], row: pd.Series) -> pd.DataFrame:
        return rows[KEY].assign(block=rows["pos"], proof=proofs, **{c: row[c] for c in extra})

    for tier in reversed(tiers[1:-1]):
        above = materialize(_down(tier, above, fan, levels, schema, finish), "llm", "outer")
    return above


def merkle_manifest(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", fields: list[str] | None = None,
                    claimed: dict[str, Column] | None = None, with_proof: bool = False, fan: int = FAN,
                    levels: int = LEVELS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified[, proof]), one row per row of ``docs``.

    ``leaf`` is the digest of ``fields``.  ``claimed`` gives other values for some fields, as a reader claims them: the proof is
    folded from the digest of these, and ``verified`` tells whether it ends at the root.  A null value is
    told apart from an empty one; rows without a source are a source of their own, the first one; a null id comes first
    within its source, rows of one id are ordered by their leaves, repeated rows are leaves each.  A very long text
    is hashed where it is read, only digests move.  Other columns are not read.  An empty table gives no rows.
    """
    fields = fields or FIELDS
    now = [F.col(f) for f in fields]
    then = [(claimed or {}).get(f, F.col(f)) for f in fields]
    leaves = materialize(docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).isNotNull().alias("has_source"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), leaf_of(now).alias("node"),
        leaf_of(then).alias("claimed")), "llm", "leaves")
    # a digest is moved once where nothing else is claimed
    leaves = leaves.withColumn("claimed", F.when(F.col("claimed") != F.col("node"), F.col("claimed")))
    ranked = materialize(with_rank(leaves, ["doc_id", "node"], by=KEY, out="pos")
                         .withColumn("pos", F.col("pos") - 1), "llm", "ranked")
    tiers = _tiers(ranked, fan, levels)

    # the tree of the sources: one tree, so its key is constant
    subroots = with_rank(tiers[-1].select(F.lit(True).alias("one"), F.col("has_source").alias("own_has"),
                                          F.col("source").alias("own_source"), "node"),
                         ["own_has", "own_source"], by=["one"], out="pos")
    subroots = materialize(subroots.select(F.lit(True).alias("has_source"), F.lit("").alias("source"), F.col("pos") - 1, "node",
                                           "own_has", "own_source").toDF(*KEY, "pos", "node", "own_has", "own_source"), "llm", "subroots")
    tops = _tiers(subroots, fan, levels)
    root = tops[-1].select(*KEY, F.lit(0).cast("long").alias("block"), F.lit("").alias("proof"), F.col("node").alias("root"))

    def to_source(rows: pd.DataFrame, proofs: list[str], row: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"has_source": rows["own_has"], "source": rows["own_source"], "block": 0, "proof": proofs,
                             "subroot": rows["node"], "root": row["root"]})

    above = materialize(_down(subroots, _outer(tops, root, fan, levels, ["root"]), fan, levels,
                              "has_source boolean, source string, block long, proof string, subroot string, root string",
                              to_source), "llm", "outer")

    def finish(rows: pd.DataFrame, proofs: list[str], row: pd.Series) -> pd.DataFrame:
        shown = rows["claimed"].where(rows["claimed"].notna(), rows["node"])
        out = pd.DataFrame({"doc_id": rows["doc_id"].astype("Int64"), "leaf": rows["node"], "subroot": row["subroot"], "root": row["root"],
                            "proof_sha256": [digest(siblings_of(p)) for p in proofs],
                            "folded_root": [folded(a, p) for a, p in zip(shown, proofs)]})
        out["verified"] = out["folded_root"] == out["root"]
        return out.assign(proof=proofs) if with_proof else out

    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return _down(ranked, _outer(tiers, above, fan, levels, ["subroot", "root"]), fan, levels,
                 schema + (", proof string" if with_proof else ""), finish)


def without_line_feeds(id_col: str = "doc_id", text_col: str = "text") -> dict[str, Column]:
    """Tampering of the rows whose id has an even CRC-32: their text without line feeds."""
    even = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 2 == 0, F.lit(False))
    return {text_col: F.when(even, F.replace(F.col(text_col), F.lit("\n"), F.lit(""))).otherwise(F.col(text_col))}


def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    return merkle_manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"), claimed=without_line_feeds())


def _leaf_sql(text: str) -> str:
    return "sha256(concat(" + ", ".join(
        f"coalesce(strlen({v}::VARCHAR)::VARCHAR || ':' || {v}::VARCHAR, '-')" for v in (*FIELDS[:-1], text)) + "))"


#: CRC-32, bit by bit: each byte, then seven steps that only shift.
_CRC_SQL = ("list_reduce(flatten([[ascii(c), 0, 0, 0, 0, 0, 0, 0] FOR c IN string_split(doc_id::VARCHAR, '')])::BIGINT[], "
            "lambda a, v: CASE WHEN xor(a, v) & 1 = 1 THEN xor(xor(a, v) >> 1, 3988292384) ELSE xor(a, v) >> 1 END, 4294967295::BIGINT)")


def _level_sql(tree: str, k: int) -> str:
    """Level ``k + 1`` of a tree: its nodes, and each document's folded digest and siblings up to there."""
    return f"""
{tree}r{k} AS MATERIALIZED (
  SELECT t, pos // {FAN} AS run, list(node ORDER BY pos) AS run_nodes, any_value(n) AS n FROM {tree}n{k} GROUP BY t, pos // {FAN}),
{tree}n{k + 1} AS MATERIALIZED (
  SELECT t, run AS pos, CASE WHEN n > 1 THEN sha256(array_to_string(run_nodes, '')) ELSE run_nodes[1] END AS node,
         count(*) OVER (PARTITION BY t) AS n FROM {tree}r{k}),
{tree}d{k + 1} AS MATERIALIZED (
  SELECT d.* REPLACE (d.pos // {FAN} AS pos,
                      CASE WHEN n > 1 THEN sha256(array_to_string(run_nodes[:d.pos % {FAN}], '') || folded
                                                  || array_to_string(run_nodes[d.pos % {FAN} + 2:], '')) ELSE folded END AS folded,
                      CASE WHEN n > 1 THEN proof || array_to_string(run_nodes[:d.pos % {FAN}], '')
                                                 || array_to_string(run_nodes[d.pos % {FAN} + 2:], '') ELSE proof END AS proof)
  FROM {tree}d{k} d JOIN {tree}r{k} r ON d.t = r.t AND d.pos // {FAN} = r.run)"""


#: Levels that the SQL has for a source and for the sources: enough for 3 ** 13 leaves a source and 3 ** 8 sources.
SQL_LEVELS = (13, 8)
OP13_SQL = f"""WITH
l AS MATERIALIZED (
  SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS t, {_leaf_sql('text')} AS leaf,
         CASE WHEN xor({_CRC_SQL}, 4294967295) % 2 = 0 THEN {_leaf_sql("replace(text, chr(10), '')")}
              ELSE {_leaf_sql('text')} END AS folded
  FROM documents),
sd0 AS MATERIALIZED (
  SELECT *, '' AS proof, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM l),
sn0 AS MATERIALIZED (SELECT t, pos, leaf AS node, count(*) OVER (PARTITION BY t) AS n FROM sd0),
{','.join(_level_sql('s', k) for k in range(SQL_LEVELS[0]))},
td0 AS MATERIALIZED (SELECT d.* REPLACE (0 AS t, d.t AS pos), n.node AS subroot FROM sd{SQL_LEVELS[0]} d JOIN sn{SQL_LEVELS[0]} n USING (t)),
tn0 AS MATERIALIZED (SELECT 0 AS t, t AS pos, node, count(*) OVER () AS n FROM sn{SQL_LEVELS[0]}),
{','.join(_level_sql('t', k) for k in range(SQL_LEVELS[1]))}
SELECT doc_id, leaf, subroot, n.node AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = n.node AS verified
FROM td{SQL_LEVELS[1]} d JOIN tn{SQL_LEVELS[1]} n USING (t)"""
