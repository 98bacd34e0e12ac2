"""Redirect surfacing (rules rC1-rC6) as SQL expressions.

A link URL is parsed once; its query string and, if the fragment holds
``=``, its fragment are read as form-encoded parameter lists.  The values of
redirect keys are candidates; ``operators.entries`` resolves them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from anchorage.functions.sql import arg, lam, let, lit, nest, struct
from anchorage.functions.urls import (
    REDIRECT_KEYS, form_decode_sql, in_list, parse_url_sql,
)

PARAM_TYPE = "array<struct<key:string,value:string>>"
QMARK_PREFIX = r"^\?"


def form_params_sql(qs: str) -> str:
    """P4: 'a=1&b=&c' -> [{a,1},{b,''},{c,''}] in URLSearchParams order."""
    pieces = f"filter(split(coalesce({qs}, ''), '&'), {lam(lambda p: f"{p} <> ''")})"

    def pair(p):
        has_eq = f"contains({p}, '=')"
        key = f"CASE WHEN {has_eq} THEN regexp_extract({p}, '(?s)^([^=]*)', 1) ELSE {p} END"
        val = f"CASE WHEN {has_eq} THEN regexp_extract({p}, '(?s)^[^=]*=(.*)$', 1) ELSE '' END"
        return struct(key=form_decode_sql(key), value=form_decode_sql(val))
    return f"transform({pieces}, {lam(pair)})"


def url_params_sql(u: str) -> str:
    """Query parameters, then fragment parameters when the fragment has '='."""
    def body(x):
        frag = f"coalesce({x}.fragment, '')"
        from_frag = (f"CASE WHEN contains({frag}, '=') THEN {form_params_sql(f"regexp_replace({frag}, {lit(QMARK_PREFIX)}, '')")} "
                     f"ELSE CAST(array() AS {PARAM_TYPE}) END")
        return f"concat({form_params_sql(f'{x}.query')}, {from_frag})"
    return let(u, body)


def redirect_candidates_sql(u: str) -> str:
    """values of redirect keys (case-insensitive), empty ones dropped."""
    keep = lam(lambda p: f"lower({p}.key) IN {in_list(REDIRECT_KEYS)} AND {p}.value <> ''")
    return f"transform(filter({url_params_sql(u)}, {keep}), {lam(lambda p: f'{p}.value')})"


def redirect_params(c) -> Column:
    """All query + fragment parameters of a URL string column."""
    return F.expr(let(nest(parse_url_sql(arg(c))), lambda p: f"CASE WHEN {p} IS NULL THEN CAST(array() AS {PARAM_TYPE}) ELSE {url_params_sql(p)} END"))
