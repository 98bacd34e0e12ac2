"""Internationalised host names: the mapping of UTS #46 (non-transitional) and punycode, as SQL text.

The mapping is a sorted table of code points, built from Unicode's own data (full case folding, then compatibility
decomposition), and found by binary search; nothing of it is written out here but the few exceptions.  All is SQL on arrays,
and only hosts with a character beyond ASCII come here.

Not checked: the rules for right-to-left labels and for joiners between letters.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

from anchorage.functions.sql import case, lam, let, lit, struct

# Fixed values of UTS #46: characters kept although case folding would change them, and those left out.
_KEPT = "ßς‌‍"
_CAPITAL_SHARP_S = "ẞ"
_IGNORED = {0xAD, 0x34F, 0x200B, 0x2060, 0x2064, 0xFEFF, *range(0x180B, 0x180E), 0x180F, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}
_FULL_STOP = "。"
_NO_LETTER = {"Cc", "Cf", "Cs", "Co", "Cn", "Zs", "Zl", "Zp"}
_BAD = "�"  # what a disallowed character is mapped to


def mapped(c: str) -> str:
    """What a character beyond ASCII becomes; the replacement character if a host can't have it."""
    if c in _KEPT:
        return c
    if ord(c) in _IGNORED:
        return ""
    if c == _CAPITAL_SHARP_S:
        return "ß"
    out = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", c).casefold()).replace(_FULL_STOP, ".")
    if out == c:
        out = unicodedata.normalize("NFC", c)
    return _BAD if any(ord(x) > 0x7F and unicodedata.category(x) in _NO_LETTER and x not in _KEPT for x in out) else out


@lru_cache(maxsize=1)
def _table() -> tuple[str, str, int]:
    """JSON of the first code points of runs and of what these become, and the number of halvings of a search.

    A run of unchanged or of disallowed characters is one row: null, or the replacement character; any other has a row of its own.
    """
    starts, values, before = [], [], object()
    for n in range(0x80, 0x110000):
        c = chr(n)
        value = _BAD if 0xD800 <= n < 0xE000 else mapped(c)
        value = None if value == c else value
        if value != before or value not in (None, _BAD, ""):
            starts.append(n)
            values.append(value)
            before = value
    return json.dumps(starts), json.dumps(values, ensure_ascii=True), len(starts).bit_length()


def _map_sql(chars: str) -> str:
    """Text of an array of characters, each mapped."""
    starts, values, halvings = _table()

    def body(s, v):
        def found(c):
            def closer(at, k):
                return f"CASE WHEN get({s}, {at} + {k}) <= ascii({c}) THEN {at} + {k} ELSE {at} END"
            steps = f"array({', '.join(str(1 << k) for k in reversed(range(halvings)))})"
            row = f"aggregate({steps}, 0, {lam(closer, 2)})"
            return f"CASE WHEN ascii({c}) < 128 THEN lower({c}) ELSE coalesce(get({v}, {row}), {c}) END"
        return f"array_join(transform({chars}, {lam(found)}), '')"
    return let(f"from_json({lit(starts)}, 'array<int>')", lambda s: let(f"from_json({lit(values)}, 'array<string>')", lambda v: body(s, v)))


# a letter with its marks, or the parts of a Korean syllable: what may be one character when composed
_CLUSTER = r"(?s)[\x{1100}-\x{115F}][\x{1160}-\x{11A7}][\x{11A8}-\x{11FF}]?|.\p{M}*+"
_COMPOSES = r"(?s)^[^\x{DF}\x{3C2}\x{200C}\x{200D}]\p{M}|^[\x{1100}-\x{115F}]."


def _composed_sql(x: str) -> str:
    """Normal form C.  A cluster goes through the JVM's ASCII form and back, which composes it; the few kept characters don't compose."""
    def one(c):
        return (f"CASE WHEN {c} RLIKE {lit(_COMPOSES)} THEN coalesce(try_reflect('java.net.IDN', 'toUnicode', "
                f"try_reflect('java.net.IDN', 'toASCII', {c}, 1)), {lit(_BAD)}) ELSE {c} END")
    marks = lit(r"[\p{M}\x{1160}-\x{11FF}]")
    return let(x, lambda v: f"CASE WHEN {v} RLIKE {marks} THEN array_join(transform(regexp_extract_all({v}, {lit(_CLUSTER)}, 0), {lam(one)}), '') "
                            f"ELSE {v} END")


def _digit(d: str) -> str:
    return f"substring('abcdefghijklmnopqrstuvwxyz0123456789', CAST({d} AS INT) + 1, 1)"


def _threshold(k: str, bias: str) -> str:
    return f"greatest(1L, least(26L, {k} - {bias}))"


def _variable_length(delta: str, bias: str) -> str:
    """The digits of a number."""
    def more(a, k):
        t = _threshold(k, bias)
        return case((f"{a}.done", struct(q=f"{a}.q", out=f"{a}.out", done="true")),
                    (f"{a}.q < {t}", struct(q="0L", out=f"concat({a}.out, {_digit(f'{a}.q')})", done="true")),
                    otherwise=struct(q=f"({a}.q - {t}) div (36 - {t})", out=f"concat({a}.out, {_digit(f'{t} + ({a}.q - {t}) % (36 - {t})')})", done="false"))
    start = struct(q=delta, out="''", done="false")
    return f"aggregate(sequence(36L, 468L, 36L), {start}, {lam(more, 2)}, {lam(lambda a: f'{a}.out')})"


def _adapted(delta: str, points: str, first: str) -> str:
    """The bias after a number."""
    scaled = f"(CASE WHEN {first} THEN {delta} div 700 ELSE {delta} div 2 END)"

    def halve(a, _):
        return case((f"{a}.d > 455", struct(d=f"{a}.d div 35", k=f"{a}.k + 36")), otherwise=a)

    def whole(d):
        start = struct(d=f"{d} + {d} div {points}", k="0L")
        return f"aggregate(sequence(1, 12), {start}, {lam(halve, 2)}, {lam(lambda a: f'{a}.k + 36 * {a}.d div ({a}.d + 38)')})"
    return let(scaled, whole)


def _punycode_sql(label: str) -> str:
    """The ASCII form of a label that has other characters."""
    def body(cps):
        basic = f"filter({cps}, {lam(lambda c: f'{c} < 128')})"
        text = f"array_join(transform({basic}, {lam(lambda c: f'chr({c})')}), '')"

        def state(n, delta, bias, h, out, first):
            return struct(n=n, delta=delta, bias=bias, h=h, out=out, first=first)

        def each(a, c):  # one character of the label, in the round of a.n
            emit = let(_variable_length(f"{a}.delta", f"{a}.bias"), lambda digits: state(
                f"{a}.n", "0L", _adapted(f"{a}.delta", f"({a}.h + 1)", f"{a}.first"), f"{a}.h + 1", f"concat({a}.out, {digits})", "false"))
            return case((f"{c} < {a}.n", state(f"{a}.n", f"{a}.delta + 1", f"{a}.bias", f"{a}.h", f"{a}.out", f"{a}.first")),
                        (f"{c} = {a}.n", emit), otherwise=a)

        def around(a, m):  # the round of the code point m
            begin = state(m, f"{a}.delta + ({m} - {a}.n) * ({a}.h + 1)", f"{a}.bias", f"{a}.h", f"{a}.out", f"{a}.first")
            end = lam(lambda e: state(f"{e}.n + 1", f"{e}.delta + 1", f"{e}.bias", f"{e}.h", f"{e}.out", f"{e}.first"))
            return f"aggregate({cps}, {begin}, {lam(each, 2)}, {end})"

        start = state("128L", "0L", "72L", f"CAST(size({basic}) AS BIGINT)", "''", "true")
        rounds = f"array_sort(array_distinct(filter({cps}, {lam(lambda c: f'{c} >= 128')})))"
        return (f"concat('xn--', {text}, CASE WHEN size({basic}) > 0 THEN '-' ELSE '' END, "
                f"aggregate({rounds}, {start}, {lam(around, 2)}, {lam(lambda a: f'{a}.out')}))")
    return let(f"transform(regexp_extract_all({label}, '(?s).', 0), {lam(lambda c: f'CAST(ascii({c}) AS BIGINT)')})", body)


def domain_to_ascii_sql(domain: str) -> str:
    """The ASCII form of a host name with characters beyond ASCII; null if it has one that no host can have, a label
    that begins with a mark, or an empty label before the last."""
    mapped_text = _composed_sql(_map_sql(f"regexp_extract_all({domain}, '(?s).', 0)"))

    def labels(v):
        one = lam(lambda x: f"CASE WHEN {x} RLIKE {lit(r'[^\x00-\x7F]')} THEN {_punycode_sql(x)} ELSE {x} END")
        bad = lit(rf"{_BAD}|(?:^|\.)\p{{M}}|^\.|\.\.")
        return f"CASE WHEN {v} RLIKE {bad} THEN NULL ELSE array_join(transform(split({v}, '[.]', -1), {one}), '.') END"
    return let(mapped_text, labels)
