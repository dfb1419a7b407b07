"""Reading and checking a request body (B1, B3), and the property list it carries.

Properties travel as ``entries``, an array of (k, v) in the order they were sent, each value a VARIANT: its
JSON type decides what is allowed, and strict sites keep the first few only.
"""

from __future__ import annotations

from footlog.functions.stages import strip
from footlog.model import DAY_MS

# Limits of a body.
LIMITS = {
    "site": 64, "name": 80, "url": 2048, "referrer": 2048, "title": 300, "screen": 16, "lang": 35, "tag": 40,
    "identity": 200, "nonce": 64, "hostname": 253,
}
AGO_MAX = DAY_MS
KEY_MAX, VALUE_MAX, PROPS_MAX = 40, 500, 24
REVENUE_MAX = 1_000_000_000
NUMERIC = "rlike r'^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL|FLOAT|DOUBLE)'"
INFINITE = "cast('Infinity' as double)"


def kind(value: str) -> str:
    return f"schema_of_variant({value})"


def text(value: str) -> str:
    return f"try_variant_get({value}, '$', 'string')"


def field(name: str) -> str:
    return f"try_variant_get(_v, '$.{name}', 'variant')"


def text_field(name: str) -> str:
    """A string field cut to its limit and trimmed; '' when missing or not a string."""
    raw = f"CASE WHEN {kind(field(name))} = 'STRING' THEN try_variant_get(_v, '$.{name}', 'string') END"
    return f"coalesce({strip(f'substring({raw}, 1, {LIMITS[name]})')}, '')"


def entry(key: str, value: str) -> str:
    return f"named_struct('k', '{key}', 'v', cast({value} as variant))"


def added(entries: str, key: str, value: str) -> str:
    """The list with one key set, at its end."""
    return f"concat({without(entries, key)}, array({entry(key, value)}))"


def without(entries: str, key: str) -> str:
    return f"filter({entries}, e -> e.k <> '{key}')"


def find(entries: str, key: str) -> str:
    return f"get(filter({entries}, e -> e.k = '{key}'), 0).v"


def replaced(entries: str, key: str, value: str) -> str:
    """The list with one key's value changed in place."""
    return (
        f"transform({entries}, e -> named_struct('k', e.k, 'v', CASE WHEN e.k = '{key}' THEN cast({value} as variant) ELSE e.v END))"
    )


_KEY = strip(f"substring(e.k, 1, {KEY_MAX})")
_ENTRY_REASON = f"""CASE WHEN {_KEY} = '' THEN cast(null as string)
  WHEN {kind("e.v")} = 'DOUBLE' AND abs(try_variant_get(e.v, '$', 'double')) = {INFINITE} THEN 'prop_number_not_finite'
  WHEN {kind("e.v")} LIKE 'OBJECT%' OR {kind("e.v")} LIKE 'ARRAY%' THEN 'prop_type_unsupported' END"""
_SHORTENED = f"""CASE WHEN {kind("e.v")} = 'STRING' AND length({text("e.v")}) > {VALUE_MAX}
  THEN cast(substring({text("e.v")}, 1, {VALUE_MAX}) as variant) ELSE e.v END"""

# From ``body`` to the checked fields ``f_*``, the kept properties ``_clean`` and ``reject_reason``.
PARSE = (
    {"_v": "try_parse_json(body)", "_keys": "json_object_keys(get_json_object(body, '$.props'))"},
    {
        "_root": kind("_v"),
        "_props_kind": kind(field("props")),
        "_props": "try_variant_get(_v, '$.props', 'map<string,variant>')",
        "_type": f"CASE WHEN {kind(field('type'))} = 'STRING' THEN try_variant_get(_v, '$.type', 'string') END",
        "_ago_kind": kind(field("ago")),
        "_ago": "try_variant_get(_v, '$.ago', 'double')",
        **{f"f_{name}": text_field(name) for name in LIMITS},
    },
    {"_sent": "transform(_keys, k -> named_struct('k', k, 'v', try_element_at(_props, k)))"},
    {
        "_bad_prop": f"get(filter(transform(_sent, e -> {_ENTRY_REASON}), r -> r IS NOT NULL), 0)",
        "_cut": f"filter(transform(_sent, e -> named_struct('k', {_KEY}, 'v', {_SHORTENED})), e -> e.k <> '')",
    },
    {
        "reject_reason": rf"""CASE
          WHEN NOT coalesce(_root LIKE 'OBJECT%', false) THEN 'body_not_object'
          WHEN f_site = '' THEN 'site_missing'
          WHEN NOT f_site rlike r'^[A-Za-z0-9_-]{{1,64}}$' THEN 'site_invalid'
          WHEN NOT coalesce(_type IN ('event', 'pageview'), false) THEN 'type_invalid'
          WHEN f_url = '' THEN 'url_missing'
          WHEN _type = 'event' AND f_name = '' THEN 'name_missing'
          WHEN f_name <> '' AND NOT f_name rlike r'^[A-Za-z0-9_.:-]{{1,80}}$' THEN 'name_invalid'
          WHEN _props_kind IS NOT NULL AND _props_kind NOT LIKE 'OBJECT%' THEN 'props_not_object'
          WHEN size(_sent) > {PROPS_MAX} THEN 'props_too_many'
          WHEN _bad_prop IS NOT NULL THEN _bad_prop
          WHEN _ago_kind IS NOT NULL AND (NOT _ago_kind {NUMERIC} OR _ago IS NULL OR _ago = {INFINITE} OR _ago < 0) THEN 'ago_invalid'
          WHEN _ago > {AGO_MAX} THEN 'ago_too_old' END""",
        "_names": "array_distinct(transform(_cut, e -> e.k))",
    },
    # Of equal keys the last value stays, in the first one's place.
    {
        "_clean": """CASE WHEN size(_names) = size(_cut) THEN _cut
          ELSE transform(_names, n -> try_element_at(filter(_cut, e -> e.k = n), -1)) END""",
        "type": "_type",
        "name": "f_name",
        "url": "f_url",
        "title": "f_title",
        "tag": "f_tag",
        "site_id": "f_site",
        "identity": "f_identity",
        "referrer": "f_referrer",
        "screen": r"CASE WHEN f_screen rlike r'^\d{1,5}x\d{1,5}$' THEN f_screen ELSE '' END",
        "lang": "CASE WHEN f_lang rlike r'^[A-Za-z-]{2,35}$' THEN lower(f_lang) ELSE '' END",
        "nonce": "CASE WHEN f_nonce rlike r'^[A-Za-z0-9_-]{16,64}$' THEN f_nonce ELSE '' END",
        "hostname": r"""CASE WHEN lower(f_hostname) rlike r'^[a-z0-9.-]{1,253}$'
          THEN regexp_replace(lower(f_hostname), r'^www\.', '') ELSE '' END""",
        "ago": "cast(floor(coalesce(_ago, 0) + 0.5) as bigint)",
    },
)

# A usable amount rounded to 4 decimals with its currency, else the reason it was removed.
REVENUE = (
    {
        "_money": find("_clean", "revenue"),
        "_currency": f"upper({strip(f'coalesce({text(find("_clean", "currency"))}, {chr(39) * 2})')})",
    },
    {
        "_amount": rf"""CASE WHEN {kind("_money")} {NUMERIC} THEN try_variant_get(_money, '$', 'double')
          WHEN {kind("_money")} = 'STRING' AND {text("_money")} rlike r'^\s*\d+(\.\d+)?\s*$' THEN try_cast({strip(text("_money"))} as double) END"""
    },
    {
        "_rounded": "floor(_amount * 10000 + 0.5D) / 10000D",
        "_refused": f"""CASE WHEN _amount IS NULL OR abs(_amount) = {INFINITE} THEN 'amount_not_a_number'
          WHEN _amount < 0 THEN 'amount_negative' WHEN _amount > {REVENUE_MAX} THEN 'amount_too_large'
          WHEN _currency = '' THEN 'currency_missing' WHEN NOT _currency rlike '^[A-Z]{{3}}$' THEN 'currency_invalid' END""",
    },
    # Whole amounts are written without a fraction, as JSON numbers are.
    {"_price": "CASE WHEN _rounded = cast(_rounded as bigint) THEN cast(cast(_rounded as bigint) as variant) ELSE cast(_rounded as variant) END"},
    {
        "entries": f"""coalesce(CASE WHEN _money IS NULL THEN _clean
          WHEN _refused IS NULL THEN {replaced(replaced("_clean", "revenue", "_price"), "currency", "_currency")}
          ELSE {added(without("_clean", "revenue"), "_revenue_rejected", "_refused")} END,
          cast(array() as array<struct<k:string,v:variant>>))"""
    },
)

# The property list as the stored JSON text.
PROPS = """CASE WHEN size(entries) > 0
  THEN to_json(map_from_entries(transform(entries, e -> named_struct('key', e.k, 'value', e.v)))) ELSE '{}' END"""
