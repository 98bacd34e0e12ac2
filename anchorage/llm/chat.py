"""Operator 8, chat formatting: preference pairs.

A pair is a chosen and a rejected conversation.  Their longest common prefix of turns is rendered
once, as the prompt; each side's remaining turns are its completion.  Loss masks list the
characters of a completion to learn from: the contents and ends of its assistant turns.

All is DataFrame code: one shuffle collects the turns of a pair, the rest are expressions on a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

END = "<|end|>\n"
LEARN = "assistant"
_HEAD = "concat('<|', coalesce(t.role, ''), '|>\\n')"
_BODY = f"concat(coalesce(t.text, ''), '{END[:-1]}\\n')"


def _rendered(turns: str) -> str:
    return f"array_join(transform({turns}, t -> concat({_HEAD}, {_BODY})), '')"


def _mask(turns: str) -> str:
    """SQL: start:end of the learned contents in the rendering of ``turns``, comma-joined."""
    head, body = (f"cast(length({x}) AS bigint)" for x in (_HEAD, _BODY))
    ends = f"""aggregate({turns}, array(0L), (a, t) -> concat(a, array(element_at(a, -1) + {head} + {body})))"""
    placed = f"""zip_with({turns}, slice({ends}, 1, size({turns})), (t, at) -> named_struct('t', t, 'at', at))"""
    return (f"array_join(transform(filter({placed}, p -> p.t.role = '{LEARN}'), p -> concat("
            f"p.at + {head.replace('t.role', 'p.t.role')}, ':', "
            f"p.at + {head.replace('t.role', 'p.t.role')} + {body.replace('t.text', 'p.t.text')})), ',')")


def preference_pairs(chosen: DataFrame, rejected: DataFrame, pair: str = "pair_id") -> DataFrame:
    """(pair, n_common, prompt, chosen, rejected, chosen_mask, rejected_mask), one row per pair.

    Both inputs have ``pair``, turn, role and text, a row for each turn.  Turns go by number, then
    role, then text; nulls first.  A pair of which one side is missing has no common turns; equal sides have two empty
    completions.  A null role or text is rendered as empty and equals only another null.  Turns without a pair
    belong to none.  Repeated turns stay; other columns are not read.
    """
    sides = [turns.where(F.col(pair).isNotNull()).select(
        F.col(pair).alias("pair"), F.lit(k).alias("side"),
        F.struct("turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).alias("t"))
        for k, turns in enumerate((chosen, rejected))]
    both = sides[0].unionByName(sides[1]).groupBy("pair").agg(*(
        F.array_sort(F.collect_list(F.when(F.col("side") == k, F.col("t")))).alias(name) for k, name in enumerate("cr")))
    same = ("zip_with(slice(c, 1, least(size(c), size(r))), slice(r, 1, least(size(c), size(r))), "
            "(x, y) -> x.role <=> y.role AND x.text <=> y.text)")
    common = f"coalesce(nullif(array_position({same}, false), 0) - 1, cast(least(size(c), size(r)) AS bigint))"
    rest = {x: f"slice({x}, cast(n_common + 1 AS int), size({x}))" for x in "cr"}
    return (both.selectExpr("pair", "c", "r", f"cast({common} AS bigint) AS n_common")
            .selectExpr("pair", "n_common", "slice(c, 1, cast(n_common AS int)) AS p", f"{rest['c']} AS c", f"{rest['r']} AS r")
            .selectExpr(f"pair AS `{pair}`", "n_common", f"{_rendered('p')} AS prompt", f"{_rendered('c')} AS chosen",
                        f"{_rendered('r')} AS rejected", f"{_mask('c')} AS chosen_mask", f"{_mask('r')} AS rejected_mask"))


def swapped_answers(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected sides from plain conversations.

    Chosen: a conversation up to its last assistant turn.  Rejected: the same with that turn's text taken from the last
    assistant turn of the conversation with the next number, or without that turn if there is none.
    A conversation without assistant turns is both sides as it is.
    """
    turns = turns.select("conv_id", "turn", "role", "text")
    last = (turns.where(F.col("role") == LEARN).groupBy("conv_id")
            .agg(F.max(F.struct("turn", "text")).alias("last")).select("conv_id", "last.turn", "last.text"))
    other = last.select((F.col("conv_id") - 1).alias("conv_id"), F.col("text").alias("other"), F.lit(True).alias("found"))
    ends = last.select("conv_id", F.col("turn").alias("last")).join(other, "conv_id", "left")
    cut = turns.join(ends, "conv_id", "left").where("last IS NULL OR turn <= last")
    swapped = (F.col("role") == LEARN) & (F.col("turn") == F.col("last"))
    rejected = (cut.where(~F.coalesce(swapped, F.lit(False)) | F.col("found"))
                .withColumn("text", F.when(swapped, F.col("other")).otherwise(F.col("text"))))
    return cut, rejected


def op8_chat_formatting(spark, sf_dir: str) -> DataFrame:
    chosen, rejected = swapped_answers(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return preference_pairs(chosen, rejected, "conv_id")


_SIDE_SQL = """
{x}0 AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i, role, text FROM {x}),
{x}1 AS (
  SELECT *, '<|' || coalesce(role, '') || '|>' || chr(10) AS head, coalesce(text, '') || '<|end|>' || chr(10) AS body FROM {x}0),"""

_REST_SQL = """
{x}2 AS (
  SELECT conv_id, string_agg(head || body, '' ORDER BY i) FILTER (i <= n) AS prompt,
         string_agg(head || body, '' ORDER BY i) FILTER (i > n) AS rest,
         string_agg(pos || ':' || (pos + length(body)), ',' ORDER BY i) FILTER (i > n AND role = 'assistant') AS mask
  FROM (SELECT *, coalesce(sum(length(head) + length(body)) FILTER (i > n) OVER (
                    PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS pos
        FROM {x}1 JOIN common USING (conv_id))
  GROUP BY conv_id)"""

OP8_SQL = f"""
WITH l AS (
  SELECT conv_id, max(turn) AS last, max_by(text, turn) AS t FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
c AS (SELECT conv_id, turn, role, text FROM conversations LEFT JOIN l USING (conv_id) WHERE last IS NULL OR turn <= last),
r AS (
  SELECT c.conv_id, turn, role, CASE WHEN role = 'assistant' AND turn = l.last THEN o.t ELSE text END AS text
  FROM c LEFT JOIN l USING (conv_id) LEFT JOIN l o ON o.conv_id = c.conv_id + 1
  WHERE NOT coalesce(role = 'assistant' AND turn = l.last, false) OR o.conv_id IS NOT NULL),
{_SIDE_SQL.format(x='c')}
{_SIDE_SQL.format(x='r')}
common AS (
  SELECT conv_id, CAST(least(coalesce(min(i) FILTER (NOT same) - 1, max(i)), max(i)) AS BIGINT) AS n
  FROM (SELECT coalesce(c0.conv_id, r0.conv_id) AS conv_id, coalesce(c0.i, r0.i) AS i,
               c0.i IS NOT NULL AND r0.i IS NOT NULL AND c0.role IS NOT DISTINCT FROM r0.role
               AND c0.text IS NOT DISTINCT FROM r0.text AS same
        FROM c0 FULL JOIN r0 ON c0.conv_id = r0.conv_id AND c0.i = r0.i)
  GROUP BY 1),
{_REST_SQL.format(x='c')},
{_REST_SQL.format(x='r')}
SELECT conv_id, n AS n_common, coalesce(c2.prompt, '') AS prompt, coalesce(c2.rest, '') AS chosen, coalesce(r2.rest, '') AS rejected,
       coalesce(c2.mask, '') AS chosen_mask, coalesce(r2.mask, '') AS rejected_mask
FROM common LEFT JOIN c2 USING (conv_id) LEFT JOIN r2 USING (conv_id)"""
