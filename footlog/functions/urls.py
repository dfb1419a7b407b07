"""URL parts, query parameters and hosts (B11 to B13), without failing on malformed input."""

from __future__ import annotations

_ABSOLUTE = r"r'^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#\\]*)([^?#]*)(\?[^#]*)?(#.*)?$'"
_BAD_AUTHORITY = r"rlike r'[\s<>^|%]|:(?!\d*$)(?![0-9a-fA-F:.]*\]$)'"


def _part(url: str, group: int) -> str:
    return f"regexp_extract({url}, {_ABSOLUTE}, {group})"


def bare_host(authority: str) -> str:
    """Lower-case host of an authority: no user, no port, no leading ``www.``."""
    return rf"regexp_replace(lower(regexp_replace(regexp_replace({authority}, '^.*@', ''), r':\d*$', '')), r'^www\.', '')"


def _encoded(text: str) -> str:
    """Percent-encode what a URL parser would: spaces, quotes, brackets and anything beyond ASCII."""
    each = rf"""transform(split({text}, ''), c -> CASE WHEN c = ' ' THEN '%20' WHEN c rlike r'[^\x00-\x7F]|["<>`{{}}]' THEN url_encode(c) ELSE c END)"""
    return rf"""CASE WHEN {text} rlike r'[^\x00-\x7F]|[ "<>`{{}}]' THEN array_join({each}, '') ELSE {text} END"""


# The parts of ``url``, completed with ``_fallback`` where it has no host: ``path``, ``query`` and ``_url_host``.
# The fragment is kept only as a client-side route; a trailing slash goes, except at the root.
SPLIT_URL = (
    {
        "_abs": """CASE WHEN contains(url, '://') THEN url WHEN startswith(url, '//') THEN concat('https:', url)
          WHEN startswith(url, '/') THEN concat('https://', _fallback, url) ELSE concat('https://', _fallback, '/', url) END"""
    },
    {"_auth": _part("_abs", 2), "_p": _part("_abs", 3), "_q": _part("_abs", 4), "_frag": _part("_abs", 5)},
    {
        "_usable": f"_auth <> '' AND NOT _auth {_BAD_AUTHORITY}",
        "_spelled": _encoded(r"translate(CASE WHEN _p = '' THEN '/' ELSE _p END, '\\', '/')"),
    },
    {
        "_folded": r"""CASE WHEN _spelled rlike r'/\.{1,2}(/|$)' THEN concat(array_join(aggregate(slice(split(_spelled, '/'), 2, 100000), array(''),
            (done, s) -> CASE WHEN s = '..' THEN slice(done, 1, greatest(size(done) - 1, 1)) WHEN s = '.' THEN done ELSE concat(done, array(s)) END), '/'),
            CASE WHEN _spelled rlike r'/\.{1,2}$' THEN '/' ELSE '' END) ELSE _spelled END"""
    },
    {"_trimmed": "CASE WHEN length(_folded) > 1 THEN regexp_replace(_folded, '/$', '') ELSE _folded END"},
    {
        "path": """CASE WHEN NOT _usable OR _trimmed = '' THEN '/' WHEN startswith(_frag, '#/') THEN concat(_trimmed, _frag) ELSE _trimmed END""",
        "query": f"CASE WHEN NOT _usable OR _q = '?' THEN '' ELSE {_encoded('_q')} END",
        "_url_host": f"CASE WHEN _usable THEN {bare_host('_auth')} ELSE _fallback END",
    },
)

# The referrer's host, '' when there is none.
REFERRER_HOST = (
    {"_ref": "CASE WHEN contains(referrer, '://') THEN referrer ELSE concat('https://', referrer) END"},
    {"_ref_auth": _part("_ref", 2)},
    {"referrer_host": f"CASE WHEN referrer = '' OR _ref_auth {_BAD_AUTHORITY} THEN '' ELSE {bare_host('_ref_auth')} END"},
)


def without_query(url: str) -> str:
    """Origin and path of a URL; text that is no URL is cut at its question mark."""
    path = f"CASE WHEN {_part(url, 3)} = '' THEN '/' ELSE {_part(url, 3)} END"
    rebuilt = f"concat(lower({_part(url, 1)}), '://', lower(regexp_replace({_part(url, 2)}, '^.*@', '')), {path})"
    return f"CASE WHEN {_part(url, 2)} <> '' THEN {rebuilt} ELSE substring_index({url}, '?', 1) END"


# Click ids that prove a paid visit.
CLICK_IDS = ["gclid", "fbclid", "msclkid", "ttclid"]


def _decoded(text: str) -> str:
    return f"coalesce(try_url_decode({text}), replace({text}, '+', ' '))"


def _first_value(key: str) -> str:
    """The first value of a key, trimmed and lower-cased; null when missing or blank."""
    return f"nullif(lower(trim(get(filter(_pairs, p -> p.k = '{key}'), 0).v)), '')"


# Campaign parameters of ``query``; a missing one is ''.
UTM = (
    {
        "_pairs": rf"""transform(split(regexp_replace(query, r'^\?', ''), '&'), t -> named_struct(
          'k', {_decoded("substring_index(t, '=', 1)")},
          'v', CASE WHEN contains(t, '=') THEN {_decoded("substring(t, length(substring_index(t, '=', 1)) + 2)")} ELSE '' END))"""
    },
    {
        "utm_source": f"coalesce({', '.join(_first_value(k) for k in ('utm_source', 'ref', 'source'))}, '')",
        "utm_medium": f"""coalesce({_first_value("utm_medium")},
          CASE WHEN exists(_pairs, p -> p.k IN ({", ".join(f"'{c}'" for c in CLICK_IDS)})) THEN 'cpc' END, '')""",
        **{f"utm_{part}": f"coalesce({_first_value(f'utm_{part}')}, '')" for part in ("campaign", "term", "content")},
    },
)
