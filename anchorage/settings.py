"""Filter / display settings of one view (a "profile").

``Settings.merge`` is the driver-side form of the settings rules (rI4):
defaults overlaid by stored values, unknown enum values replaced by the
default, booleans by truthiness.  The table form of the same rules, for
many stored profiles at once, is ``anchorage.operators.store.merge_settings``.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's.
SORT_MODES = ("original", "alphabetical")
THEME_MODES = ("system", "light", "dark")
DEFAULTS = {
    "sortMode": "original",
    "themeMode": "system",
    "urlIncludePattern": "",
    "urlExcludePattern": "",
    "textIncludePattern": "",
    "textExcludePattern": "",
    "useRegex": False,
    "decodeUrls": False,
}
FILTER_LABELS = (
    ("urlIncludePattern", "URL include"),
    ("urlExcludePattern", "URL exclude"),
    ("textIncludePattern", "Text include"),
    ("textExcludePattern", "Text exclude"),
)
# ---------------------------------------------------------------------------


def _truthy(v) -> bool:
    """JavaScript Boolean(v) for the JSON-ish values settings hold."""
    if isinstance(v, str):
        return v != ""
    if isinstance(v, float) and v != v:
        return False
    return bool(v)


@dataclass(frozen=True)
class Settings:
    sort_mode: str = "original"
    url_include: str = ""
    url_exclude: str = ""
    text_include: str = ""
    text_exclude: str = ""
    use_regex: bool = False
    decode_urls: bool = False
    theme_mode: str = "system"

    @classmethod
    def merge(cls, stored: dict | None = None, **kw) -> "Settings":
        """mergeSettings: camelCase keys as stored, snake_case as keywords."""
        m = dict(DEFAULTS)
        m.update(stored or {})
        s = cls(
            sort_mode=m["sortMode"] if m["sortMode"] in SORT_MODES else "original",
            theme_mode=m["themeMode"] if m["themeMode"] in THEME_MODES else "system",
            url_include=str(m["urlIncludePattern"] or ""),
            url_exclude=str(m["urlExcludePattern"] or ""),
            text_include=str(m["textIncludePattern"] or ""),
            text_exclude=str(m["textExcludePattern"] or ""),
            use_regex=_truthy(m["useRegex"]),
            decode_urls=_truthy(m["decodeUrls"]),
        )
        return replace(s, **kw) if kw else s

    def reset_filters(self) -> "Settings":
        """rI5: clear patterns, regex and decode; keep sort and theme."""
        return replace(self, url_include="", url_exclude="", text_include="",
                       text_exclude="", use_regex=False, decode_urls=False)

    def patterns(self):
        """(label, pattern) in the fixed error / hint order."""
        return (
            ("URL include", self.url_include),
            ("URL exclude", self.url_exclude),
            ("Text include", self.text_include),
            ("Text exclude", self.text_exclude),
        )
