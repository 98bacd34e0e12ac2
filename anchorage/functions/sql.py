"""Small helpers to write Spark SQL expression text from Python.

Large expressions (the URL parser, entity decoding) are assembled as SQL
text and handed to Spark once through ``F.expr``: building them as
``Column`` objects costs one JVM round trip per node, which for the URL
parser alone is about a second of driver time per use.
"""

from __future__ import annotations

import itertools
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_counter = itertools.count()
_SIMPLE = re.compile(r"(`[^`]+`|[A-Za-z_]\w*)(\.[A-Za-z_]\w*)*")


def lit(s) -> str:
    """SQL literal for a Python str / bool / int / None."""
    if s is None:
        return "NULL"
    if isinstance(s, bool):
        return "true" if s else "false"
    if isinstance(s, int):
        return f"CAST({s} AS BIGINT)"
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def var(prefix: str = "v") -> str:
    """A fresh lambda variable name."""
    return f"_{prefix}{next(_counter)}"


def let(value: str, body) -> str:
    """Evaluate ``value`` once and bind it for ``body(name)``.

    SQL has no let; a one-element ``transform`` plays that role so that
    a value used several times is neither recomputed nor copied into the
    expression tree.
    """
    if _SIMPLE.fullmatch(value.strip()):
        return body(value.strip())  # a column or variable: nothing to bind
    v = var()
    return f"element_at(transform(array({value}), {v} -> {body(v)}), 1)"


class Step:
    """A tail binding: ``value`` is bound and ``body(name)`` continues.

    Parser stages return steps instead of nested ``let`` text.  ``nest``
    turns a chain into one (nested) expression; ``run_steps`` evaluates it
    as successive DataFrame projections, which keeps the analyzer's work
    linear and lets whole-stage codegen handle each stage.
    """

    def __init__(self, value: str, body):
        self.value = value
        self.body = body


def step(value: str, body) -> Step:
    return Step(value, body)


def nest(x) -> str:
    """Expression text of a step chain (or plain text)."""
    if isinstance(x, Step):
        return let(x.value, lambda v: nest(x.body(v)))
    return x


def run_steps(df, x, out: str):
    """Evaluate a step chain on ``df`` as projections; adds column ``out``.

    The chain becomes one SQL statement of nested projections over
    ``df`` (analysed once).  A struct-valued stage is
    stored as one flat column per field (``stage.field`` references are
    rewritten to them): the optimizer then keeps expensive values that are
    read several times in their own projection instead of inlining copies.
    """
    pattern = re.compile(r"`(__" + re.escape(out) + r"_\d+)`\.(\w+)")

    def flat(text: str) -> str:
        return pattern.sub(lambda m: f"`{m.group(1)}__{m.group(2)}`", text)

    sql = "SELECT * FROM {src}"
    k = 0
    while isinstance(x, Step):
        name = f"__{out}_{k}"
        k += 1
        if isinstance(x.value, StructText):
            cols = [(f"{name}__{f}", e) for f, e in x.value.fields.items()]
        else:
            cols = [(name, x.value)]
        sql = "SELECT *, " + ", ".join(f"{flat(e)} AS {col(n)}" for n, e in cols) + f" FROM ({sql})"
        x = x.body(col(name))
    keep = ", ".join(col(c) for c in df.columns if c != out)
    sql = f"SELECT {keep}{', ' if keep else ''}{flat(x)} AS {col(out)} FROM ({sql})"
    # the frame is passed as an argument: no view stays behind
    return df.sparkSession.sql(sql.replace("{", "{{").replace("}", "}}").replace("{{src}}", "{src}"), src=df)


def lam(body, n: int = 1) -> str:
    """Lambda text ``x -> body(x)`` or ``(x, i) -> body(x, i)``."""
    names = [var() for _ in range(n)]
    head = names[0] if n == 1 else "(" + ", ".join(names) + ")"
    return f"{head} -> {body(*names)}"


def case(*branches, otherwise="NULL") -> str:
    """CASE WHEN c1 THEN v1 ... ELSE otherwise END."""
    parts = " ".join(f"WHEN {c} THEN {v}" for c, v in branches)
    return f"(CASE {parts} ELSE {otherwise} END)"


class StructText(str):
    """``named_struct`` text that remembers its fields (see ``run_steps``)."""

    fields: dict


def struct(**fields) -> str:
    t = StructText("named_struct(" + ", ".join(f"{lit(k)}, {v}" for k, v in fields.items()) + ")")
    t.fields = fields
    return t


def col(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def arg(c) -> str:
    """SQL text of an argument: a column name or already SQL text."""
    if isinstance(c, Sql):
        return c.text
    return col(c)


class Sql:
    """Marker for an SQL expression string passed where a name is expected."""

    def __init__(self, text: str):
        self.text = text

    def __str__(self):
        return self.text


def expr(text: str) -> Column:
    return F.expr(text)
