"""Text column functions: link-text cleaning, HTML entities, CSV, slugs."""

from __future__ import annotations

import html.entities
import json
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from anchorage.functions.sql import arg, case, lam, let, lit
from anchorage.functions.urls import JS_SPACE, js_trim_sql


def clean_text_sql(x: str) -> str:
    """U1 cleanLinkText: runs of JavaScript whitespace -> one space, trimmed."""
    collapsed = f"regexp_replace(coalesce({x}, ''), {lit(f'[{JS_SPACE}]+')}, ' ')"
    return f"regexp_replace({collapsed}, '^ | $', '')"


def collapse_ascii_ws_sql(x: str) -> str:
    """'strip and collapse ASCII whitespace' (document.title)."""
    return f"trim(regexp_replace({x}, {lit(r'[\t\n\f\r ]+')}, ' '))"


@lru_cache(maxsize=1)
def _named_entities_json() -> str:
    # Derived from the standard library's HTML5 entity table, not written out by hand.
    return json.dumps({"&" + k: v for k, v in html.entities.html5.items() if k.endswith(";")})


@lru_cache(maxsize=1)
def _bare_names() -> str:
    """Pattern of the names that are also read without a semicolon, longest first."""
    return "|".join(sorted((k for k in html.entities.html5 if not k.endswith(";")), key=lambda k: (-len(k), k)))


@lru_cache(maxsize=1)
def _c1_codes() -> str:
    """SQL: what the references 128..159 stand for: Windows-1252 where that has a character."""
    codes = [ord(bytes([n]).decode("cp1252", "replace")) for n in range(128, 160)]
    return "array(" + ", ".join(str(n if c == 0xFFFD else c) for n, c in zip(range(128, 160), codes)) + ")"


#: SQL of the table of named references.  ``scan_html`` holds it once, as a column.
ENTITY_TABLE = "from_json({json}, 'map<string,string>')"


def entity_table_sql() -> str:
    return ENTITY_TABLE.format(json=lit(_named_entities_json()))


_ENTITY_TOKEN = r"&#[0-9]+;?|&#[xX][0-9a-fA-F]+;?|&[A-Za-z][A-Za-z0-9]*[;=]?|[^&]+|&"


def _decode_token_sql(t: str, table: str, attribute: bool) -> str:
    digits = f"regexp_replace(regexp_extract({t}, '^&#[xX]?([0-9a-fA-F]+)', 1), '^0+(?=.)', '')"
    num = (f"CASE WHEN length({digits}) > 8 THEN NULL WHEN {t} RLIKE '^&#[xX]' "
           f"THEN CAST(conv({digits}, 16, 10) AS BIGINT) ELSE CAST({digits} AS BIGINT) END")

    def char(n):
        bad = f"{n} IS NULL OR {n} = 0 OR {n} > 1114111 OR ({n} BETWEEN 55296 AND 57343)"
        code = f"CASE WHEN {n} BETWEEN 128 AND 159 THEN {_c1_codes()}[CAST({n} - 128 AS INT)] ELSE {n} END"
        return f"CASE WHEN {bad} THEN '�' ELSE decode(unhex(lpad(hex({code}), 8, '0')), 'UTF-32') END"

    def named(bare):
        # in an attribute a name without semicolon counts only if no letter, digit or '=' follows it
        counts = f"{bare} = {t}" if attribute else f"{bare} <> ''"
        return (f"coalesce(try_element_at({table}, {t}), CASE WHEN {counts} THEN "
                f"concat(try_element_at({table}, concat({bare}, ';')), substring({t}, length({bare}) + 1)) END, {t})")

    return case(
        (f"{t} RLIKE '^&#([0-9]+|[xX][0-9a-fA-F]+);?$'", let(num, char)),
        (f"{t} RLIKE '^&[A-Za-z]'", let(f"regexp_extract({t}, {lit(f'^&({_bare_names()})')}, 0)", named)),
        otherwise=t,
    )


def decode_entities_sql(x: str, table: str | None = None, attribute: bool = False) -> str:
    """HTML character references in text and attribute values, as a browser reads them.

    Strings without ``&`` pass untouched; the others are cut into tokens
    (references and plain runs) and each token is decoded once, so
    ``&amp;lt;`` correctly becomes ``&lt;``.  ``table``: SQL of the named references.
    """
    table = table or entity_table_sql()

    def body(v):
        toks = f"regexp_extract_all({v}, {lit(_ENTITY_TOKEN)}, 0)"
        return (f"CASE WHEN contains({v}, '&') THEN array_join(transform({toks}, "
                f"{lam(lambda t: _decode_token_sql(t, table, attribute))}), '') ELSE {v} END")
    return let(x, body)


CSV_SPECIAL = '[",\n]'


def csv_escape_sql(x: str) -> str:
    """U9 escapeCsvValue: null -> ''; quoted if it holds '"', ',' or LF."""
    return let(f"coalesce({x}, '')",
               lambda v: f"CASE WHEN {v} RLIKE {lit(CSV_SPECIAL)} "
                         f"THEN concat('\"', replace({v}, '\"', '\"\"'), '\"') ELSE {v} END")


def slug_sql(x: str, max_len: str | None = None) -> str:
    """U10 sanitizeSegment: trim, lower, non [a-z0-9] runs -> '-', cut, strip '-'."""
    v = f"regexp_replace(lower({js_trim_sql(x)}), '[^a-z0-9]+', '-')"
    if max_len is not None:
        v = f"substring({v}, 1, {max_len})"
    return f"regexp_replace({v}, '^-+|-+$', '')"


# --- Column API ----------------------------------------------------------------

def clean_text(c) -> Column:
    return F.expr(clean_text_sql(arg(c)))


def decode_entities(c) -> Column:
    return F.expr(decode_entities_sql(arg(c)))


def csv_escape(c) -> Column:
    return F.expr(csv_escape_sql(arg(c)))


def slug(c, max_len: int | None = None) -> Column:
    return F.expr(slug_sql(arg(c), None if max_len is None else str(max_len)))
