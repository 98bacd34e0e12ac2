"""Filters (F3-F11, rD1-rD6) and the error list for invalid patterns.

Settings are compiled on the driver into SQL predicates: blank patterns
add nothing, plain patterns become a disjunction of ``contains`` on the
lower-cased value, regex patterns one ``RLIKE`` (compiled once per
task) of the pattern rewritten for Java (``functions.jsregex``, no Spark job).  An
invalid regex disables its filter and adds
``"<label> regex is invalid."`` in the fixed label order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession

from anchorage.functions.jsregex import InvalidPattern, to_java
from anchorage.functions.sql import lit
from anchorage.settings import Settings

# JavaScript's white space, as in ``functions.jsregex.JSBLANKS``.
BLANKS = "\t\n\x0b\f\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def plain_terms(pattern: str) -> list[str]:
    """Split on ',', trim, lower-case, drop empties."""
    return [t for t in (part.strip(BLANKS).lower() for part in pattern.split(",")) if t]


def regex_is_valid(pattern: str) -> bool:
    """whether the reference's constructor takes the pattern."""
    try:
        to_java(pattern)
        return True
    except InvalidPattern:
        return False


def matcher_sql(value_sql: str, pattern: str, use_regex: bool, valid: bool) -> str | None:
    """createMatcher: SQL predicate on ``value_sql`` (null -> ''), or None."""
    if not pattern.strip(BLANKS):
        return None
    v = f"coalesce({value_sql}, '')"
    if not use_regex:
        terms = plain_terms(pattern)
        if not terms:
            return None
        return "(" + " OR ".join(f"contains(lower({v}), {lit(t)})" for t in terms) + ")"
    if not valid:
        return None
    return f"({v} RLIKE {lit(to_java(pattern))})"


@dataclass(frozen=True)
class CompiledFilter:
    url_include: str | None
    url_exclude: str | None
    text_include: str | None
    text_exclude: str | None
    errors: tuple[str, ...]
    invalid_labels: tuple[str, ...]

    def predicate(self, url_sql: str, text_sql: str) -> str:
        """F11 conjunction for one entry (SQL text)."""
        parts = []
        if self.url_include:
            parts.append(self.url_include.replace("\x00U", url_sql))
        if self.url_exclude:
            parts.append("NOT " + self.url_exclude.replace("\x00U", url_sql))
        if self.text_include:
            parts.append(self.text_include.replace("\x00T", text_sql))
        if self.text_exclude:
            parts.append("NOT " + self.text_exclude.replace("\x00T", text_sql))
        return "(" + " AND ".join(parts) + ")" if parts else "true"


def compile_filter(spark: SparkSession, s: Settings) -> CompiledFilter:
    errors, invalid = [], []
    compiled = []
    for (label, pattern), target in zip(s.patterns(), ("\x00U", "\x00U", "\x00T", "\x00T")):
        valid = True
        if s.use_regex and pattern.strip(BLANKS):
            valid = regex_is_valid(pattern)
            if not valid:
                errors.append(f"{label} regex is invalid.")
                invalid.append(label)
        compiled.append(matcher_sql(target, pattern, s.use_regex, valid))
    return CompiledFilter(*compiled, errors=tuple(errors), invalid_labels=tuple(invalid))


def active_labels(s: Settings, invalid=()) -> list[str]:
    return [label for label, p in s.patterns() if p.strip(BLANKS) and label not in invalid]


def format_label_list(labels: list[str]) -> str:
    """G6: 'a', 'a and b', 'a, b, and c'."""
    if len(labels) <= 1:
        return "".join(labels)
    if len(labels) == 2:
        return f"{labels[0]} and {labels[1]}"
    return ", ".join(labels[:-1]) + f", and {labels[-1]}"


def no_match_hint(s: Settings, invalid=()) -> str:
    summary = format_label_list(active_labels(s, invalid))
    return "No links matched the active filters" + (": " if summary else "") + summary + \
        ". Try Reset Filters."
