"""Country and location from proxy headers."""

from __future__ import annotations

from footlog.functions.stages import listed

# Header names, tried in order, and codes that mean "unknown".
COUNTRY_HEADERS = [
    "cf-ipcountry", "x-vercel-ip-country", "fly-client-ip-country", "cloudfront-viewer-country",
    "x-nf-client-connection-country", "x-country-code", "x-geo-country",
]
NOT_COUNTRIES = ["XX", "T1", "ZZ", "A1", "A2", "O1", "EU", "AP"]
# Per provider its country, region code, region name, city, latitude and longitude headers.
PROVIDERS = [
    ("cf-ipcountry", "cf-region-code", "cf-region", "cf-ipcity", "cf-iplatitude", "cf-iplongitude"),
    (
        "x-vercel-ip-country", "x-vercel-ip-country-region", None, "x-vercel-ip-city", "x-vercel-ip-latitude",
        "x-vercel-ip-longitude",
    ),
    (
        "cloudfront-viewer-country", "cloudfront-viewer-country-region", "cloudfront-viewer-country-region-name",
        "cloudfront-viewer-city", "cloudfront-viewer-latitude", "cloudfront-viewer-longitude",
    ),
    ("fly-client-ip-country", None, None, None, None, None),
    ("x-nf-client-connection-country", None, None, None, None, None),
    ("x-country-code", None, None, None, None, None),
    ("x-geo-country", None, None, None, None, None),
]
URL_ENCODED = {"x-vercel-ip-city"}


def _code(header: str) -> str:
    """The checked two-letter country code of a header, or null."""
    return f"_c{COUNTRY_HEADERS.index(header)}"


def _pick(column: int) -> str:
    """The header of the chosen provider for one column, as sent; null when it has none."""
    choices = [(i, p[column]) for i, p in enumerate(PROVIDERS) if p[column]]
    return "CASE _provider " + " ".join(f"WHEN {i} THEN try_element_at(headers, '{h}')" for i, h in choices) + " END"


def _clean(text: str) -> str:
    return rf"substring(regexp_replace({text}, r'[\x00-\x1f\x7f<>]', ''), 1, 80)"


def _degrees(text: str, limit: int) -> str:
    """A number within the limit rounded to 0.1 degree, halves upwards; null otherwise."""
    value = rf"CASE WHEN {text} rlike r'^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$' THEN try_cast({text} as double) END"
    return f"CASE WHEN abs({value}) <= {limit} THEN floor({value} * 10 + 0.5D) / 10D END"


def _repaired(text: str) -> str:
    """UTF-8 that arrived as Latin-1 text is put right; anything else stays as sent."""
    latin = rf"{text} rlike r'[\x{{80}}-\x{{ff}}]' AND NOT {text} rlike r'[^\x{{00}}-\x{{ff}}]'"
    return f"coalesce(try_validate_utf8(cast(encode(CASE WHEN {latin} THEN {text} END, 'ISO-8859-1') as string)), {text})"


# ``_country`` is the first valid country header; the location comes from the first provider with a
# valid country, and coordinates come as a pair or not at all.
LOCATE = (
    # Most requests carry few of these headers; each is read and checked once.
    {f"_h{i}": f"substring(upper(trim(try_element_at(headers, '{h}'))), 1, 2)" for i, h in enumerate(COUNTRY_HEADERS)},
    {f"_c{i}": f"CASE WHEN _h{i} rlike '^[A-Z]{{2}}$' AND _h{i} NOT IN {listed(NOT_COUNTRIES)} THEN _h{i} END" for i in range(len(COUNTRY_HEADERS))},
    {
        "_country": f"coalesce({', '.join(f'_c{i}' for i in range(len(COUNTRY_HEADERS)))}, '')",
        "_provider": "CASE " + " ".join(f"WHEN {_code(p[0])} IS NOT NULL THEN {i}" for i, p in enumerate(PROVIDERS)) + " END",
    },
    {
        "_suffix": f"trim({_pick(1)})",
        "_region_text": f"trim({_pick(2)})",
        "_city_sent": f"trim({_pick(3)})",
        "_lat_text": f"trim({_pick(4)})",
        "_lon_text": f"trim({_pick(5)})",
    },
    # One provider sends its city URL-encoded.
    {
        "_city_text": """CASE WHEN _provider = 1 THEN coalesce(try_url_decode(replace(_city_sent, '+', '%2B')), _city_sent)
          ELSE _city_sent END""",
        "_lat": _degrees("_lat_text", 90),
        "_lon": _degrees("_lon_text", 180),
        "_code": "CASE _provider " + " ".join(f"WHEN {i} THEN {_code(p[0])}" for i, p in enumerate(PROVIDERS)) + " END",
    },
    {
        "_paired": "_lat IS NOT NULL AND _lon IS NOT NULL AND NOT (_lat = 0 AND _lon = 0)",
        "_region": "CASE WHEN upper(_suffix) rlike '^[A-Z0-9]{1,3}$' THEN concat(_code, '-', upper(_suffix)) ELSE '' END",
        "_region_name": f"coalesce({_clean(_repaired('_region_text'))}, '')",
        "_city": f"coalesce({_clean(_repaired('_city_text'))}, '')",
    },
)
