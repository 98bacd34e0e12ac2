"""Places of regular-expression matches in whole texts, as DataFrame expressions.

``split`` gives the texts between the matches, so a match begins after all earlier
texts and matches.  Offsets count code points; ends are exclusive.

Patterns must run in linear time on any text: they begin with a look-behind
where a run could else be tried from each of its characters, and use possessive groups, which
Java's matcher walks without recursion.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SP = r"\\x20\\x09-\\x0D"
#: The last and the first word of a gap; each word is tried once.
_LAST = f"(?<![^{_SP}])([^{_SP}]++)[{_SP}]*+\\\\z"
_NEXT = f"^[{_SP}]*+([^{_SP}]++)"
#: A gap's nearest characters, looked at before the whole gap.
_NEAR = 64


def _neighbour(gap: str, side: str, pattern: str) -> str:
    """SQL: the word of ``gap`` at its ``side``.  Most end within the nearest characters; else the whole gap is searched."""
    near = f"{side}({gap}, {_NEAR})"
    whole = f"[{_SP}][^{_SP}]+[{_SP}]*\\\\z" if side == "right" else f"^[{_SP}]*[^{_SP}]+[{_SP}]"
    return (f"regexp_extract(CASE WHEN length({gap}) <= {_NEAR} OR {near} rlike '{whole}' THEN {near} ELSE {gap} END, "
            f"'{pattern}', 1)")


@dataclass(frozen=True)
class Kind:
    """``name`` in results; ``pattern``; ``needs``: a cheap pattern that any text with a match has;
    ``valid``: SQL condition on a match ``{v}``, or None."""

    name: str
    pattern: str
    needs: str
    valid: str | None = None


def find_spans(docs: DataFrame, kinds: list[Kind], text_col: str = "text", context: bool = False) -> DataFrame:
    """``docs`` without the text, plus an array ``spans_<name>`` for each kind, in order of place.

    Elements have start, kind (place in ``kinds``), end and value; with ``context`` also
    before and after, the whole neighbouring words however far off ('' at an edge or another match).
    A null text has no spans.
    """
    kept = [c for c in docs.columns if c != text_col]
    text = F.col(text_col)
    none = F.array().cast("array<string>")
    hits = {k.name: F.coalesce(F.when(text.rlike(k.needs), F.regexp_extract_all(text, F.lit(k.pattern), F.lit(0))), none)
            for k in kinds}
    out = docs.select(*kept, text_col, *(c.alias(f"__h_{n}") for n, c in hits.items()))
    out = out.select(*kept, *(f"__h_{k.name}" for k in kinds), *(
        F.when(F.size(f"__h_{k.name}") > 0, F.split(text, k.pattern, -1)).otherwise(none).alias(f"__g_{k.name}") for k in kinds))
    out = out.selectExpr(*map(_quoted, kept), *(f"__h_{k.name}" for k in kinds), *(f"__g_{k.name}" for k in kinds), *(
        f"""aggregate(transform(__h_{k.name}, (h, i) -> cast(length(__g_{k.name}[i]) + if(i > 0, length(__h_{k.name}[i - 1]), 0) as bigint)),
            array(0L), (a, x) -> concat(a, array(element_at(a, -1) + x))) AS __s_{k.name}""" for k in kinds))
    around = ""
    spans = []
    for place, k in enumerate(kinds):
        if context:
            around = f""",
                'before', {_neighbour(f"__g_{k.name}[i]", "right", _LAST)},
                'after', {_neighbour(f"__g_{k.name}[i + 1]", "left", _NEXT)}"""
        made = f"""transform(__h_{k.name}, (v, i) -> named_struct('start', __s_{k.name}[i + 1], 'kind', {place},
                   'end', __s_{k.name}[i + 1] + length(v), 'value', v{around}))"""
        spans.append(f"filter({made}, s -> {k.valid.replace('{v}', 's.value')}) AS spans_{k.name}" if k.valid
                     else f"{made} AS spans_{k.name}")
    return out.selectExpr(*map(_quoted, kept), *spans)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def listed(spans: str, names: list[str]) -> str:
    """SQL: an array of spans as kind:start:end by start, then kind, comma-joined."""
    kinds = ", ".join(f"'{n}'" for n in names)
    return (f"array_join(transform(array_sort(transform({spans}, s -> struct(s.start AS start, s.kind AS kind, s.end AS end))), "
            f"s -> concat(element_at(array({kinds}), s.kind + 1), ':', s.start, ':', s.end)), ',')")


def free_of(spans: str, taken: str) -> str:
    """SQL: the elements of ``spans`` that overlap none of ``taken``."""
    return f"filter({spans}, s -> NOT exists({taken}, b -> b.start < s.end AND s.start < b.end))"


def replace_spans(text: str, spans: str, mask: str) -> str:
    """SQL: ``text`` with every span of the non-overlapping, sorted array ``spans`` replaced by SQL ``mask`` of ``s``."""
    return (f"concat(aggregate({spans}, struct(cast(0 as bigint) AS at, '' AS done), (a, s) -> struct(s.end AS at, "
            f"concat(a.done, substring({text}, cast(a.at + 1 as int), cast(s.start - a.at as int)), {mask}) AS done), a -> a.done), "
            f"substring({text}, cast(coalesce(try_element_at({spans}, -1).end, 0) + 1 as int)))")
