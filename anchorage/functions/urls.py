"""URL column functions: skip test, resolution, decoding.

The builders (``*_sql``) return Spark SQL expression text, so the parser
below reaches the JVM as one expression (see ``functions.sql``) and can
be used inside higher-order-function lambdas over a page's anchors.
``Column`` wrappers without the suffix are the public API.

Resolution follows the WHATWG URL parser for the shapes links take:
absolute URLs of special schemes (http, https, ws, wss, ftp, file),
scheme-relative, path-absolute, path-relative, query-only, fragment-only
and empty references, opaque schemes (mailto:, tel:, magnet:, ...),
dot segments (also ``%2e``), backslashes in special URLs, default
ports, credentials, ASCII host lower-casing, IPv4 number forms and
percent-encoding per URL part, Windows drive letters of file URLs.  IPv6
hosts are serialised with plain string functions; internationalised host
names become punycode after UTS #46 (``functions.idna``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from anchorage.functions.idna import domain_to_ascii_sql
from anchorage.functions.sql import Sql, arg, case, lam, let, lit, nest, run_steps, step, struct

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's: schemes a link is skipped
# for, and the redirect parameter keys.
SKIPPED_PREFIXES = ("about:", "blob:", "data:", "javascript:", "moz-extension:")
REDIRECT_KEYS = (
    "dest", "destination", "next", "out", "r", "redir", "redirect",
    "redirect_uri", "redirect_url", "target", "to", "u", "url",
)
# ---------------------------------------------------------------------------

SPECIAL_SCHEMES = ("http", "https", "ws", "wss", "ftp", "file")
DEFAULT_PORTS = (("http", 80), ("https", 443), ("ws", 80), ("wss", 443), ("ftp", 21))

# Percent-encode sets of the URL standard, as Java regex class bodies.
C0_SET = r"\x{0}-\x{1F}\x{7F}-\x{10FFFF}"
FRAGMENT_SET = C0_SET + r' "<>`'
QUERY_SET = C0_SET + r' "#<>'
SPECIAL_QUERY_SET = QUERY_SET + "'"
PATH_SET = QUERY_SET + r"?`{}"
USERINFO_SET = PATH_SET + r"/:;=@\[\\\]^|"

# JavaScript's \s: ASCII whitespace plus the Unicode space separators,
# line/paragraph separators, NBSP and BOM (Java's \s is ASCII-only).
JS_SPACE = r"\t\n\x{0B}\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"

_SKIP_RE = "^(" + "|".join(p[:-1] for p in SKIPPED_PREFIXES) + "):"
_FORBIDDEN_HOST = r"[\x{0}\t\n\r #/:<>?@\[\\\]^|]"
_FORBIDDEN_DOMAIN = r"[\x{0}-\x{20}#%/:<>?@\[\\\]^|\x{7F}]"
_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_DOTTED_QUAD = rf"^{_OCTET}(\.{_OCTET}){{3}}$"
BIG = "1073741824"

URL_TYPE = (
    "struct<scheme:string,special:boolean,has_auth:boolean,userinfo:string,"
    "host:string,port:string,path:string,query:string,fragment:string,opaque:boolean>"
)
NULL_URL = f"CAST(NULL AS {URL_TYPE})"
_SPECIAL_IN = "(" + ", ".join(lit(s) for s in SPECIAL_SCHEMES) + ")"


def in_list(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


# --- small builders -----------------------------------------------------------

def js_trim_sql(x: str) -> str:
    """String.prototype.trim: strips JS whitespace at both ends."""
    return f"regexp_replace({x}, {lit(f'^[{JS_SPACE}]+|[{JS_SPACE}]+$')}, '')"


def is_skipped_sql(x: str) -> str:
    """rB1: trimmed, lower-cased value starts with a skipped scheme."""
    return f"(lower({js_trim_sql(x)}) RLIKE {lit(_SKIP_RE)})"


def pct_encode_sql(x: str, charset: str) -> str:
    """Percent-encode (UTF-8, upper-case hex) the code points of ``charset``.

    The string is cut into runs of safe and unsafe code points; only the
    unsafe runs go through ``url_encode`` (which writes a space as ``+``,
    turned into ``%20``).  Strings without unsafe code points pass as is.
    """
    def body(v):
        runs = f"regexp_extract_all({v}, {lit(f'[{charset}]+|[^{charset}]+')}, 0)"
        enc = lam(lambda r: f"CASE WHEN {r} RLIKE {lit(f'^[{charset}]')} "
                            f"THEN replace(url_encode({r}), '+', '%20') ELSE {r} END")
        return f"CASE WHEN {v} RLIKE {lit(f'[{charset}]')} THEN array_join(transform({runs}, {enc}), '') ELSE {v} END"
    return let(x, body)


_DRIVE = "'^[A-Za-z][:|]$'"


def _remove_dot_segments_sql(x: str, is_file: str) -> str:
    """Path state of the URL parser for a path starting with '/'.  In file URLs a leading drive letter is never removed."""
    def body(p):
        def fold(segs):
            def step(acc, e):
                seg = f"lower({e}.s)"
                drive = f"({is_file} AND size({acc}) = 1 AND {acc}[0] RLIKE {_DRIVE})"
                popped = f"CASE WHEN size({acc}) > 0 AND NOT {drive} THEN slice({acc}, 1, size({acc}) - 1) ELSE {acc} END"
                return case(
                    (f"{seg} IN ('..', '.%2e', '%2e.', '%2e%2e')",
                     f"CASE WHEN {e}.last THEN concat({popped}, array('')) ELSE {popped} END"),
                    (f"{seg} IN ('.', '%2e')",
                     f"CASE WHEN {e}.last THEN concat({acc}, array('')) ELSE {acc} END"),
                    otherwise=f"concat({acc}, array({e}.s))",
                )
            tagged = f"transform({segs}, " + lam(
                lambda s, i: struct(s=s, last=f"({i} = size({segs}) - 1)"), 2) + ")"
            acc_lambda = lam(step, 2)
            return f"concat('/', array_join(aggregate({tagged}, CAST(array() AS array<string>), {acc_lambda}), '/'))"
        has_dots = f"{p} RLIKE {lit(r'(?i)(^|/)(\.|%2e){1,2}(/|$)')}"
        segs = f"split(substring({p}, 2, {BIG}), '/')"
        return f"CASE WHEN {has_dots} THEN {let(segs, fold)} ELSE {p} END"
    return let(x, body)


def _ipv4_number_sql(h: str) -> str:
    """Host ending in a number: the IPv4 forms; null if invalid."""
    def part_value(p):
        digits = f"substring({p}, 3, {BIG})"
        return "try_cast(" + case(
            # more than 8 hex or 11 octal digits exceed 32 bits: null, an invalid host
            (f"{p} RLIKE '^0[xX]0*[0-9a-fA-F]{{0,8}}$'",
             f"CASE WHEN {digits} = '' THEN '0' ELSE conv(regexp_replace({digits}, '^0+(?=.)', ''), 16, 10) END"),
            (f"{p} RLIKE '^0+[0-7]{{0,11}}$'", f"conv(regexp_replace({p}, '^0+(?=.)', ''), 8, 10)"),
            (f"{p} RLIKE '^(0|[1-9][0-9]*)$'", p),
        ) + " AS DECIMAL(38,0))"

    def body(vals):
        n = f"size({vals})"
        head = f"slice({vals}, 1, greatest({n} - 1, 0))"
        ok = (f"({n} BETWEEN 1 AND 4) AND forall({vals}, {lam(lambda v: f'{v} IS NOT NULL')}) "
              f"AND forall({head}, {lam(lambda v: f'{v} <= 255')})")
        last = f"element_at({vals}, -1)"
        scale = f"CAST(pow(256, 5 - {n}) AS DECIMAL(38,0))"
        prefix = (f"aggregate({head}, CAST(0 AS DECIMAL(38,0)), "
                  + lam(lambda a, v: f"CAST({a} * 256 + {v} AS DECIMAL(38,0))", 2) + ")")

        def dotted(num):
            parts = [f"CAST(shiftright(CAST({num} AS BIGINT), {k}) & 255 AS STRING)" for k in (24, 16, 8, 0)]
            return "concat_ws('.', " + ", ".join(parts) + ")"
        return (f"CASE WHEN {ok} AND {last} < {scale} THEN "
                f"{let(f'CAST({prefix} * {scale} + {last} AS DECIMAL(38,0))', dotted)} END")

    parts = f"split(regexp_replace({h}, {lit(r'\.$')}, ''), {lit(r'\.')})"
    return let(f"transform({parts}, {lam(part_value)})", body)


def _ipv6_groups_sql(h: str) -> str:
    """'[...]' host -> its eight groups as ':0:...:1:', lower-case hex without leading zeros; null if invalid.

    Groups of 1-4 hex digits, at most one '::' (for one group or more), an optional dotted IPv4 tail.
    """
    inner = f"lower(substring({h}, 2, length({h}) - 2))"
    tail = lit(rf"^(.*:){_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$")

    def pair(v, k):
        octets = [f"CAST(regexp_extract({v}, {tail}, {n}) AS INT)" for n in (k, k + 1)]
        return f"hex({octets[0]} * 256 + {octets[1]})"

    def plain(v):
        quad = f"concat(regexp_extract({v}, {tail}, 1), {pair(v, 2)}, ':', {pair(v, 4)})"
        return f"CASE WHEN {v} RLIKE {tail} THEN lower({quad}) ELSE {v} END"

    def expand(v):
        groups = f"size(filter(split({v}, ':', -1), x -> x <> ''))"
        left, right = (f"regexp_extract({v}, '^(.*)::(.*)$', {k})" for k in (1, 2))
        full = (f"concat_ws(':', nullif({left}, ''), array_join(array_repeat('0', 8 - {groups}), ':'), nullif({right}, ''))")
        shape = f"{v} RLIKE '^(([0-9a-f]{{1,4}}(:[0-9a-f]{{1,4}})*)?::([0-9a-f]{{1,4}}(:[0-9a-f]{{1,4}})*)?|[0-9a-f]{{1,4}}(:[0-9a-f]{{1,4}}){{7}})$'"
        return (f"CASE WHEN {shape} AND (NOT contains({v}, '::') OR {groups} <= 7) THEN "
                f"concat(':', regexp_replace(CASE WHEN contains({v}, '::') THEN {full} ELSE {v} END, '(?<![0-9a-f])0+(?=[0-9a-f])', ''), ':') END")
    bracketed = lit(r"^\[[0-9A-Fa-f:.]{2,45}\]$")
    return f"CASE WHEN {h} RLIKE {bracketed} THEN {let(plain(inner), expand)} END"


def _ipv6_host_sql(groups: str) -> str:
    """Serialised IPv6 host of ``_ipv6_groups_sql``: the first longest run of two or more zeros as '::'."""
    runs = [(f"{groups} RLIKE ':0(:0){{{k - 1}}}:'", f"regexp_replace({groups}, '^(.*?):0(?::0){{{k - 1}}}:', '$1::')")
            for k in range(8, 1, -1)]
    short = case(*runs, otherwise=groups)
    return f"concat('[', regexp_replace({short}, '^:(?!:)|(?<!:):$', ''), ']')"


def _domain_sql(h: str) -> str:
    """Percent-decoded, lower-cased ASCII form of a special URL's host; null on failure."""
    decoded = f"CASE WHEN contains({h}, '%') THEN try_url_decode(replace({h}, '+', '%2B')) ELSE {h} END"
    return let(f"lower({decoded})", lambda d: (
        f"CASE WHEN {d} RLIKE {lit(r'[^\x00-\x7F]')} THEN {domain_to_ascii_sql(d)} ELSE {d} END"))


def _canon_host_sql(h: str, v6: str, dom: str, scheme: str, special: str) -> str:
    """Host parser: the serialised host, or null on failure.  ``v6`` and ``dom`` are the host as
    ``_ipv6_groups_sql`` and ``_domain_sql`` have it."""
    bracket = f"startswith({h}, '[')"
    ipv6 = _ipv6_host_sql(v6)
    last_label = f"regexp_extract({dom}, {lit(r'([^.]*)\.?$')}, 1)"
    ends_num = f"({last_label} RLIKE '^(0[xX][0-9a-fA-F]*|[0-9]+)$')"
    ascii_host = case(
        (bracket, ipv6),
        (f"{dom} IS NULL", "NULL"),
        (f"{dom} RLIKE {lit(_FORBIDDEN_DOMAIN)}", "NULL"),
        (f"{scheme} = 'file' AND {dom} = 'localhost'", "''"),
        (f"{dom} = '' AND {scheme} <> 'file'", "NULL"),
        (f"{ends_num} AND {dom} RLIKE {lit(_DOTTED_QUAD)}", dom),
        (ends_num, _ipv4_number_sql(dom)),
        otherwise=dom,
    )
    opaque_host = case(
        (bracket, ipv6),
        (f"{h} RLIKE {lit(_FORBIDDEN_HOST)}", "NULL"),
        otherwise=pct_encode_sql(h, C0_SET),
    )
    return f"CASE WHEN {special} THEN {ascii_host} ELSE {opaque_host} END"


# --- the parser ------------------------------------------------------------------

def parse_url_sql(href: str, base: str | None = None) -> str:
    """Parse ``href`` against the parsed ``base`` struct (or none).

    Returns a step chain (``functions.sql.Step``) yielding a ``URL_TYPE``
    struct with canonical parts, or null when the URL standard fails.
    Every intermediate value is bound once; ``nest`` gives one expression,
    ``run_steps`` one projection per stage.
    """
    base = base or NULL_URL

    def stripped(h):
        return (f"regexp_replace(regexp_replace({h}, {lit(r'^[\x{0}-\x{20}]+|[\x{0}-\x{20}]+$')}, ''), "
                f"{lit(r'[\t\n\r]')}, '')")
    scheme_re = lit(r'^([A-Za-z][A-Za-z0-9+.\-]*):')
    return step(struct(s=stripped(href), b=base,
                       sr=f"regexp_extract({stripped(href)}, {scheme_re}, 1)"), _stage1)


def _stage1(v):
    s, b, sr = f"{v}.s", f"{v}.b", f"{v}.sr"
    return _stage2_from(b, f"CASE WHEN {sr} <> '' THEN substring({s}, length({sr}) + 2, {BIG}) ELSE {s} END",
                        f"({sr} <> '')", f"lower({sr})")


def _stage2_from(b, rest_expr, has_scheme_expr, scheme_in_expr):
    return step(struct(b=b, rest=rest_expr, has_scheme=has_scheme_expr, scheme_in=scheme_in_expr), _stage2)


def _stage2(v):
    b, rest, has_scheme, scheme_in = f"{v}.b", f"{v}.rest", f"{v}.has_scheme", f"{v}.scheme_in"
    special_in = f"({scheme_in} IN {_SPECIAL_IN})"
    base_ok = f"({b} IS NOT NULL)"
    two = f"({rest} RLIKE {lit(r'^[/\\]{2}')})"
    one = f"({rest} RLIKE {lit(r'^[/\\]')})"
    relative = (f"(NOT {has_scheme} OR ({special_in} AND {scheme_in} <> 'file' AND {base_ok} "
                f"AND {b}.scheme = {scheme_in} AND NOT {two}))")
    usable = f"({base_ok} AND NOT {b}.opaque)"
    rel_auth = f"({usable} AND CASE WHEN {b}.special THEN {two} ELSE startswith({rest}, '//') END)"
    rel_abs = f"({usable} AND CASE WHEN {b}.special THEN {one} ELSE startswith({rest}, '/') END)"
    absolute_mode = case(
        (f"{special_in} AND {scheme_in} <> 'file'", "'auth'"),
        (f"{scheme_in} = 'file' AND {two}", "'auth'"),
        (f"{scheme_in} = 'file'", "'fileabs'"),
        (f"startswith({rest}, '//')", "'auth'"),
        (f"startswith({rest}, '/')", "'nabs'"),
        otherwise="'opaque'",
    )
    relative_mode = case(
        (f"NOT {base_ok}", "'fail'"),
        (f"{b}.opaque AND startswith({rest}, '#')", "'frag'"),
        (f"{b}.opaque", "'fail'"),
        (rel_auth, "'auth'"),
        (rel_abs, "'abs'"),
        (f"{rest} = ''", "'empty'"),
        (f"startswith({rest}, '?')", "'query'"),
        (f"startswith({rest}, '#')", "'frag'"),
        otherwise="'rel'",
    )
    return step(struct(
        b=b, rest=rest, one_slash=one,
        mode=f"CASE WHEN {relative} THEN {relative_mode} ELSE {absolute_mode} END",
        scheme=f"CASE WHEN {relative} THEN {b}.scheme ELSE {scheme_in} END",
    ), _stage3)


def _stage3(v):
    scheme, rest, mode = f"{v}.scheme", f"{v}.rest", f"{v}.mode"
    special = f"({scheme} IN {_SPECIAL_IN})"
    after_slashes = (f"CASE WHEN {special} AND {scheme} <> 'file' "
                     f"THEN regexp_replace({rest}, {lit(r'^[/\\]*')}, '') "
                     f"ELSE substring({rest}, 3, {BIG}) END")
    pq = case(
        (f"{mode} = 'auth'", after_slashes),
        (f"{mode} = 'fileabs'", f"CASE WHEN {v}.one_slash THEN {rest} ELSE concat('/', {rest}) END"),
        otherwise=rest,
    )

    def inner(w):
        p = f"{w}.pq"
        authority = case(
            (f"{mode} <> 'auth'", "''"),
            (special, f"regexp_extract({p}, {lit(r'(?s)^([^/\\?#]*)')}, 1)"),
            otherwise=f"regexp_extract({p}, {lit(r'(?s)^([^/?#]*)')}, 1)",
        )

        def inner2(a):
            has_at = f"contains({a}, '@')"
            return step(struct(
                b=f"{v}.b", rest=rest, mode=mode, scheme=scheme, special=special,
                tail=f"substring({p}, length({a}) + 1, {BIG})",
                userinfo_raw=f"CASE WHEN {has_at} THEN regexp_extract({a}, {lit('(?s)^(.*)@')}, 1) ELSE '' END",
                hostport=f"CASE WHEN {has_at} THEN regexp_extract({a}, {lit('(?s)@([^@]*)$')}, 1) ELSE {a} END",
            ), _stage4)
        return step(authority, inner2)
    return step(struct(pq=pq), inner)


def _stage4(v):
    """Authority parts: credentials, host, port."""
    scheme, special, mode, hp = f"{v}.scheme", f"{v}.special", f"{v}.mode", f"{v}.hostport"
    host_raw = f"regexp_extract({hp}, {lit(r'(?s)^(\[[^\]]*\]?|[^:]*)')}, 1)"

    def hosts(hr):
        return step(struct(hr=hr, v6=_ipv6_groups_sql(hr), dom=f"CASE WHEN NOT startswith({hr}, '[') THEN {_domain_sql(hr)} END"), inner2)

    def inner2(w):
        hr = f"{w}.hr"
        hp_tail = f"substring({hp}, length({hr}) + 1, {BIG})"
        tail = f"{v}.tail"
        return step(struct(
            b=f"{v}.b", rest=f"{v}.rest", mode=mode, scheme=scheme, special=special,
            tail=tail, userinfo_raw=f"{v}.userinfo_raw",
            host=f"CASE WHEN {mode} = 'auth' THEN {_canon_host_sql(hr, f'{w}.v6', f'{w}.dom', scheme, special)} END",
            hp_bad=f"({hp_tail} <> '' AND NOT startswith({hp_tail}, ':'))",
            port_raw=f"CASE WHEN startswith({hp_tail}, ':') THEN substring({hp_tail}, 2, {BIG}) ELSE '' END",
            p_part0=f"regexp_extract({tail}, '(?s)^([^?#]*)', 1)",
            q_part=(f"CASE WHEN {tail} RLIKE {lit(r'(?s)^[^?#]*\?')} "
                    f"THEN regexp_extract({tail}, {lit(r'(?s)^[^?#]*\?([^#]*)')}, 1) END"),
        ), _stage5)
    return step(host_raw, hosts)


def _stage5(v):
    """Port, credentials, path / query / fragment and the final struct."""
    b, rest, mode, scheme, special = f"{v}.b", f"{v}.rest", f"{v}.mode", f"{v}.scheme", f"{v}.special"
    host, port_raw, ui = f"{v}.host", f"{v}.port_raw", f"{v}.userinfo_raw"
    port_num = f"(CASE WHEN {port_raw} RLIKE '^[0-9]+$' THEN try_cast({port_raw} AS DECIMAL(38,0)) END)"
    default_port = case(*[(f"{scheme} = {lit(s)}", str(p)) for s, p in DEFAULT_PORTS])
    port_bad = f"({port_raw} <> '' AND ({port_num} IS NULL OR {port_num} > 65535 OR {scheme} = 'file'))"
    port = (f"CASE WHEN {port_raw} = '' OR {port_num} = {default_port} THEN '' "
            f"ELSE CAST(CAST({port_num} AS BIGINT) AS STRING) END")
    user = f"regexp_extract({ui}, '(?s)^([^:]*)', 1)"
    password = f"CASE WHEN contains({ui}, ':') THEN regexp_extract({ui}, '(?s)^[^:]*:(.*)$', 1) ELSE '' END"
    userinfo = (f"CASE WHEN {user} = '' AND {password} = '' THEN '' ELSE concat("
                f"{pct_encode_sql(user, USERINFO_SET)}, "
                f"CASE WHEN {password} <> '' THEN concat(':', {pct_encode_sql(password, USERINFO_SET)}) ELSE '' END, "
                f"'@') END")
    auth_bad = (f"({v}.hp_bad OR {port_bad} OR {host} IS NULL "
                f"OR ({ui} <> '' AND ({host} = '' OR {scheme} = 'file')) "
                f"OR ({port_raw} <> '' AND {host} = ''))")
    tail = f"{v}.tail"
    p_part0 = f"{v}.p_part0"
    p_part = f"CASE WHEN {special} THEN replace({p_part0}, {lit(chr(92))}, '/') ELSE {p_part0} END"
    q_part = f"{v}.q_part"
    f_part = f"CASE WHEN contains({tail}, '#') THEN regexp_extract({tail}, '(?s)^[^#]*#(.*)$', 1) END"
    base_dir = f"CASE WHEN {b}.has_auth AND {b}.path = '' THEN '/' ELSE regexp_replace({b}.path, '[^/]*$', '') END"
    keep_base = f"({mode} IN ('abs', 'rel', 'empty', 'query', 'frag'))"

    def with_parts(pp):
        q = q_part
        is_file = f"({scheme} = 'file')"
        base_drive = f"regexp_extract({b}.path, '^(/[A-Za-z]:)(/|$)', 1)"
        raw_path = case(
            (f"{is_file} AND {pp} RLIKE '^/?[A-Za-z][:|](/|$)'", f"regexp_replace({pp}, '^/?([A-Za-z])[:|]', '/$1:')"),
            (f"{mode} = 'abs' AND {is_file} AND NOT startswith({pp}, '//')", f"concat({base_drive}, {pp})"),
            (f"{mode} = 'rel'", f"concat({base_dir}, {pp})"),
            (f"{mode} = 'auth' AND {special} AND {pp} = ''", "'/'"),
            otherwise=pp,
        )
        path = case(
            (f"{mode} IN ('empty', 'query', 'frag')", f"{b}.path"),
            (f"{mode} = 'opaque'", pct_encode_sql(pp, C0_SET)),
            otherwise=pct_encode_sql(_remove_dot_segments_sql(raw_path, is_file), PATH_SET),
        )

        query = case(
            (f"{mode} IN ('empty', 'frag')", f"{b}.query"),
            (f"{q} IS NULL", "NULL"),
            (special, pct_encode_sql(q, SPECIAL_QUERY_SET)),
            otherwise=pct_encode_sql(q, QUERY_SET),
        )
        fragment = case(
            (f"{mode} = 'empty'", "NULL"),
            (f"{mode} = 'frag'", pct_encode_sql(f"substring({rest}, 2, {BIG})", FRAGMENT_SET)),
            (f"{f_part} IS NULL", "NULL"),
            otherwise=pct_encode_sql(f_part, FRAGMENT_SET),
        )
        out = struct(
            scheme=scheme,
            special=special,
            has_auth=case((f"{mode} IN ('auth', 'fileabs')", "true"), (keep_base, f"{b}.has_auth"),
                          otherwise="false"),
            userinfo=case((f"{mode} = 'auth'", userinfo), (keep_base, f"{b}.userinfo"), otherwise="''"),
            host=case((f"{mode} = 'auth'", host), (f"{mode} = 'fileabs'", "''"),
                      (keep_base, f"{b}.host")),
            port=case((f"{mode} = 'auth'", port), (keep_base, f"{b}.port"), otherwise="''"),
            path=path,
            query=query,
            fragment=fragment,
            opaque=case((f"{mode} = 'opaque'", "true"), (f"{mode} = 'frag'", f"{b}.opaque"),
                        otherwise="false"),
        )
        failed = f"({mode} = 'fail' OR ({mode} = 'auth' AND {auth_bad}))"
        return f"CASE WHEN {failed} THEN {NULL_URL} ELSE {out} END"
    return step(p_part, with_parts)


def serialize_url_sql(u: str) -> str:
    """URL serializer for a ``URL_TYPE`` struct (null stays null)."""
    def body(x):
        auth = (f"CASE WHEN {x}.has_auth THEN concat('//', {x}.userinfo, {x}.host, "
                f"CASE WHEN {x}.port <> '' THEN concat(':', {x}.port) ELSE '' END) ELSE '' END")
        path = (f"CASE WHEN NOT {x}.has_auth AND startswith({x}.path, '//') "
                f"THEN concat('/.', {x}.path) ELSE {x}.path END")
        return (f"CASE WHEN {x} IS NOT NULL THEN concat({x}.scheme, ':', {auth}, {path}, "
                f"CASE WHEN {x}.query IS NOT NULL THEN concat('?', {x}.query) ELSE '' END, "
                f"CASE WHEN {x}.fragment IS NOT NULL THEN concat('#', {x}.fragment) ELSE '' END) END")
    return let(u, body)


def resolve_href_sql(raw: str, base_parsed: str) -> str:
    """U3 resolveHref: null for empty or skipped hrefs, else the URL or null."""
    return let(raw, lambda r: let(base_parsed, lambda b: (
        f"CASE WHEN {r} IS NULL OR {r} = '' OR {b} IS NULL OR {is_skipped_sql(r)} THEN NULL "
        f"ELSE {serialize_url_sql(nest(parse_url_sql(r, b)))} END")))


def with_url(df, href, out: str, base: str | None = None, string_out: str | None = None):
    """Parse column ``href`` (against the parsed struct column ``base``)
    into struct column ``out`` with one projection per parser stage;
    ``string_out`` also adds the serialised URL."""
    df = run_steps(df, parse_url_sql(arg(href), arg(base) if base else None), out)
    if string_out:
        df = df.withColumn(string_out, F.expr(serialize_url_sql(arg(out))))
    return df


# --- decoding --------------------------------------------------------------------

_RESERVED_ESCAPES = r"%(2[346BCFbcf]|3[ABDFabdf]|40)"


def _fffd(x: str) -> str:
    return f"(length({x}) - length(replace({x}, '�', '')))"


def _strict_decode_sql(x: str, protected: str) -> str:
    """Percent-decode ``protected``; null where JavaScript would throw
    (bad escape, or bytes that are not UTF-8)."""
    valid_fffd = f"((length({x}) - length(regexp_replace({x}, '(?i)%EF%BF%BD', ''))) / 9)"
    return let(f"try_url_decode({protected})",
               lambda d: f"CASE WHEN {d} IS NULL OR {_fffd(d)} > {_fffd(x)} + {valid_fffd} "
                         f"THEN NULL ELSE {d} END")


def decode_component_sql(x: str) -> str:
    """U4 decodeURIComponent, the value unchanged if it is malformed."""
    return let(x, lambda v: f"coalesce({_strict_decode_sql(v, f'replace({v}, {lit(chr(43))}, {lit(chr(37) + '2B')})')}, {v})")


def decode_uri_sql(x: str) -> str:
    """U8 / rG1 decodeURI: reserved escapes stay; malformed -> unchanged."""
    def body(v):
        protected = f"replace(regexp_replace({v}, {lit(_RESERVED_ESCAPES)}, '%25$1'), '+', '%2B')"
        return f"coalesce({_strict_decode_sql(v, protected)}, {v})"
    return let(x, body)


def form_decode_sql(x: str) -> str:
    """Form value decoding: '+' is a space, bad UTF-8 -> U+FFFD, a '%'
    that starts no escape stays literal."""
    return f"try_url_decode(regexp_replace({x}, {lit(r'%(?![0-9A-Fa-f]{2})')}, '%25'))"


# --- Column API ----------------------------------------------------------------

def _c(text: str) -> Column:
    return F.expr(text)


def is_skipped(c) -> Column:
    return _c(is_skipped_sql(arg(c)))


def js_trim(c) -> Column:
    return _c(js_trim_sql(arg(c)))


def pct_encode(c, charset: str) -> Column:
    return _c(pct_encode_sql(arg(c), charset))


def parse_url(href, base=None) -> Column:
    """Parsed URL struct of ``href`` (column name or ``Sql``), optionally
    against the parsed form of ``base`` (a URL string column).  One nested
    expression: for large tables prefer ``with_url``."""
    b = nest(parse_url_sql(arg(base))) if base is not None else None
    return _c(nest(parse_url_sql(arg(href), b)))


def resolve(href, base=None) -> Column:
    """``new URL(href, base).href`` or null."""
    if base is None:
        return _c(serialize_url_sql(nest(parse_url_sql(arg(href)))))
    return _c(let(nest(parse_url_sql(arg(base))), lambda b: (
        f"CASE WHEN {b} IS NOT NULL THEN {serialize_url_sql(nest(parse_url_sql(arg(href), b)))} END")))


def resolve_href(raw, base) -> Column:
    """resolveHref(raw, base) for two string columns."""
    return _c(resolve_href_sql(arg(raw), nest(parse_url_sql(arg(base)))))


def decode_component(c) -> Column:
    return _c(decode_component_sql(arg(c)))


def decode_uri(c) -> Column:
    return _c(decode_uri_sql(arg(c)))


def format_url(c, decode: bool) -> Column:
    """formatUrl(url, decodeUrls)."""
    return decode_uri(c) if decode else _c(arg(c))


def form_decode(c) -> Column:
    return _c(form_decode_sql(arg(c)))


__all__ = [
    "SKIPPED_PREFIXES", "REDIRECT_KEYS", "Sql", "parse_url", "resolve", "resolve_href",
    "decode_uri", "decode_component", "form_decode", "format_url", "is_skipped", "js_trim",
]
