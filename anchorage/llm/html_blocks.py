"""Block texts of one HTML page with the tree nodes that hold them.

A small helper of ``site_tree``: one left-to-right pass over the markup with a stack of open
block elements.  Time and memory are linear in the page.
"""

from __future__ import annotations

import re
from html import unescape
from typing import NamedTuple

import xxhash

#: One token: text, comment, declaration, tag (slash, name, attributes), unfinished tag, or a lone "<".
_TOKEN = re.compile(
    r"""[^<]++|<!--(?:-?>|(?s:.*?)(?:--!?>|\Z))|<(?:[!?]|/(?![a-zA-Z]))[^>]*+(?:>|\Z)"""
    r"""|<(/?)([a-zA-Z][^\s/>]*+)((?:[^=>]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))?+)*+)(?:>|\Z)|<""")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=][^\s>/=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?""")
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_DIGITS = re.compile(r"[0-9]+")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg".split())
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 "
                      "h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
_BLOCK = _CLOSES_P | frozenset("html body li dt dd tr td th thead tbody tfoot caption colgroup button select option optgroup legend object audio "
                               "video canvas".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_SCOPE = frozenset("table td th caption button object body".split())
#: What a start tag ends besides a paragraph: (open elements ended, elements at which the search stops).
_ENDS = {
    "li": (frozenset(["li"]), frozenset("ul ol menu table td th section article main body".split())),
    **dict.fromkeys(("dt", "dd"), (frozenset(["dt", "dd"]), frozenset("dl table td th section article main body".split()))),
    **dict.fromkeys(("td", "th"), (frozenset(["td", "th"]), frozenset("tr table body".split()))),
    "tr": (frozenset(["tr"]), frozenset("table body".split())),
    **dict.fromkeys(("thead", "tbody", "tfoot"), (frozenset("thead tbody tfoot".split()), frozenset("table body".split()))),
    **dict.fromkeys(("option", "optgroup"), (frozenset(["option"]), frozenset("select body".split()))),
}
#: Elements that are never main text, unless they hold the page's main part.
_NOISE_TAGS = frozenset("nav aside footer form button select dialog menu object audio video canvas fieldset".split())
#: Parts of class, id and role names of branches that are not main text.
_NOISE_NAMES = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs masthead banner footer sidebar widget widgets cookie cookies consent notice "
    "notices gdpr popup modal overlay ad ads advert adverts advertisement advertising sponsor sponsored promo promotion newsletter subscribe "
    "subscription signup login share sharing social related recommended recommendations comment comments reply replies respond disqus search "
    "searchbox pagination pager toolbar skip complementary contentinfo dialog alert".split())
#: An article with one of these names is a comment, an advert or a teaser.
_NOT_AN_ARTICLE = frozenset("comment comments reply replies ad ads advert adverts advertisement sponsored promo related recommended teaser widget".split())
_keys: dict[tuple[int, str], int] = {}


class Block(NamedTuple):
    """``path``: key of the tree node, ``style``: key of the tags inside the element, ``text``: its white space turned into single spaces."""

    path: int
    style: int
    text: str


class _Element:
    __slots__ = ("tag", "parent", "key", "names", "main", "noise", "holds_main", "inline", "children")

    def __init__(self, tag: str, parent: "_Element | None", key: int, names: frozenset[str], inline: bool, hidden: bool):
        self.tag, self.parent, self.key, self.names, self.inline = tag, parent, key, names, inline
        self.children: list[str] = []
        self.main = (tag == "main" or "main" in names and tag != "body" and "role" in names
                     or tag == "article" and not names & _NOT_AN_ARTICLE)
        self.holds_main = False
        self.noise = hidden or tag not in ("html", "body") and not self.main and (
            tag in _NOISE_TAGS or tag == "article" or bool(names & _NOISE_NAMES))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _key(parent: int, label: str) -> int:
    """Key of a node below ``parent``; equal in every task."""
    known = _keys.get((parent, label))
    if known is None:
        if len(_keys) > 50_000:
            _keys.clear()
        known = _keys[parent, label] = _signed(xxhash.xxh64_intdigest(label, seed=parent & (1 << 64) - 1))
    return known


def _attributes(text: str) -> tuple[str, frozenset[str], bool]:
    """Label (classes and id without their digits), parts of names in lower case, whether it is hidden."""
    if not any(name in text for name in ("class", "id", "role", "hidden", "CLASS", "ID", "ROLE")):
        return "", frozenset(), False
    found: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), next(filter(None, values), ""))
    classes = unescape(found.get("class", "")).split()
    own, role = unescape(found.get("id", "")), found.get("role", "").lower()
    label = "".join("." + _DIGITS.sub("0", c) for c in sorted(set(classes))) + ("#" + _DIGITS.sub("0", own) if own else "")
    names = {part.lower() for name in (*classes, own, role) for part in _NAME_PART.findall(name)}
    if role == "main":
        names.add("role")
    return label, frozenset(names), "hidden" in found


def blocks_of(html: str | None) -> list[Block]:
    """The texts of a page's main part, in page order, with their tree nodes.

    The main part is what ``main`` and ``article`` elements hold, the whole page if there is none.  Branches whose tag, class, id or role
    names say that they are menus, footers, adverts and the like have no importance and are left out here, unless
    they hold the main part; a page header is, the header of an article isn't.  Scripts, styles and comments hold no text.
    Elements may be left open or be cut off anywhere.
    """
    html = html or ""
    root = _Element("html", None, 0, frozenset(), False, False)
    stack, opened = [root], {"html": 1}
    found: list[tuple[_Element, str]] = []
    parts: list[str] = []
    at, size = 0, len(html)

    def flush() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                found.append((stack[-1], text))

    def close(n: int) -> None:
        """Close all elements from position ``n`` of the stack on."""
        flush()
        for e in stack[n:]:
            opened[e.tag] -= 1
        del stack[n:]

    def close_nearest(tags, stop) -> None:
        for n in range(len(stack) - 1, 0, -1):
            if stack[n].tag in tags:
                return close(n)
            if stack[n].tag in stop:
                return None

    while at < size:
        token = _TOKEN.match(html, at)
        at = token.end()
        name = token[2]
        if name is None:
            text = token[0]
            if text[0] != "<" or text == "<":
                parts.append(unescape(text) if "&" in text else text)
            continue
        if html[at - 1] != ">":
            break  # a tag that never ends
        tag, slash = name.lower(), token[1]
        if slash:
            if tag == "br":
                parts.append(" ")
            elif opened.get(tag) and (tag in _BLOCK or stack[-1].inline):
                for n in range(len(stack) - 1, 0, -1):
                    if stack[n].tag == tag:
                        close(n)
                        break
                    if tag not in _BLOCK and not stack[n].inline:
                        break
            continue
        if tag in ("html", "body", "head"):
            continue
        parent = stack[-1]
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*+>?", re.I).search(html, at)
            at = end.end() if end else size
            continue
        if not parent.children or parent.children[-1] != tag:
            parent.children.append(tag)
        if tag in _VOID:
            if tag == "br":
                parts.append(" ")
            elif tag == "hr":
                if opened.get("p"):
                    close_nearest(("p",), _SCOPE)
                flush()
            continue
        label, names, hidden = _attributes(token[3]) if token[3] else ("", frozenset(), False)
        if tag not in _BLOCK:
            if hidden or names & _NOISE_NAMES:  # an inline advert or the like is a branch of its own
                flush()
                stack.append(_Element(tag, parent, parent.key, names, True, hidden))
                opened[tag] = opened.get(tag, 0) + 1
            continue
        flush()
        if tag in _CLOSES_P and opened.get("p"):
            close_nearest(("p",), _SCOPE)
        if tag in _ENDS and any(opened.get(t) for t in _ENDS[tag][0]):
            close_nearest(*_ENDS[tag])
        elif tag in _HEADING and stack[-1].tag in _HEADING:
            close(len(stack) - 1)
        parent = stack[-1]
        stack.append(_Element(tag, parent, _key(parent.key, tag + label), names, False, hidden))
        opened[tag] = opened.get(tag, 0) + 1
        if stack[-1].main:
            above = parent
            while above and not above.holds_main:
                above.holds_main, above = True, above.parent
    flush()
    return _main_part(found)


def _main_part(found: list[tuple[_Element, str]]) -> list[Block]:
    state: dict[int, tuple[bool, bool]] = {}

    def judged(element: _Element) -> tuple[bool, bool]:
        """Whether an element is in the main part, and whether in a branch without importance."""
        chain = []
        while element and id(element) not in state:
            chain.append(element)
            element = element.parent
        main, noise = state[id(element)] if element else (False, False)
        for e in reversed(chain):
            # a header of the page is left out, the header of an article stays
            head = not main and not e.main and (e.tag == "header" or "header" in e.names) and e.tag not in ("html", "body")
            noise = noise or (e.noise or head) and not e.holds_main
            main = main or e.main and not noise
            state[id(e)] = main, noise
        return main, noise

    seen = [(e, text, *judged(e)) for e, text in found]
    only_main = any(main and not noise for _, _, main, noise in seen)
    return [Block(e.key, _key(1, " ".join(e.children)), text) for e, text, main, noise in seen
            if not noise and (main or not only_main)]
