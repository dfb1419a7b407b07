"""Pseudonyms (B17 to B20): address prefixes, daily visitor ids and persistent identities."""

from __future__ import annotations

from footlog.functions.stages import quoted, strip

PRE_HASHED = "rlike '^[0-9a-f]{64}$'"
_QUAD = r"r'^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$'"


def _groups(half: str) -> str:
    return f"filter(split({half}, ':'), g -> g <> '')"


def _with_tail(groups: str) -> str:
    """A trailing dotted quad counts as two groups; an invalid one stays and fails the check."""
    octet = [f"try_cast(regexp_extract(try_element_at({groups}, -1), {_QUAD}, {i}) as int)" for i in range(1, 5)]
    small = f"try_element_at({groups}, -1) rlike {_QUAD} AND " + " AND ".join(f"coalesce({o} <= 255, false)" for o in octet)
    pairs = ", ".join(f"lower(hex({a} * 256 + {b}))" for a, b in ((octet[0], octet[1]), (octet[2], octet[3])))
    return (
        f"CASE WHEN coalesce(contains(try_element_at({groups}, -1), '.'), false) AND {small} "
        f"THEN concat(slice({groups}, 1, size({groups}) - 1), array({pairs})) ELSE {groups} END"
    )


# ``_ip``: IPv4 as it is, mapped IPv4 unwrapped, IPv6 cut to its canonical first 64 bits, else as sent.
# Only addresses with a colon are taken apart.
NORMAL_IP = (
    {"_addr": "trim(coalesce(ip, ''))"},
    {
        "_mapped": r"CASE WHEN contains(_addr, ':') THEN regexp_extract(_addr, r'(?i)^::ffff:(\d{1,3}(?:\.\d{1,3}){3})$', 1) END",
        "_halves": r"CASE WHEN contains(_addr, ':') THEN split(split(regexp_replace(regexp_replace(_addr, r'^\[', ''), r'\]$', ''), '%')[0], '::') END",
    },
    {"_h": _groups("_halves[0]"), "_t": f"CASE WHEN size(_halves) = 2 THEN {_groups('get(_halves, 1)')} WHEN size(_halves) = 1 THEN cast(array() as array<string>) END"},
    {"_head": _with_tail("_h"), "_tail": _with_tail("_t")},
    {"_missing": "8 - size(_head) - size(_tail)"},
    {"_whole": "CASE WHEN _h IS NOT NULL AND _t IS NOT NULL THEN concat(_head, array_repeat('0', greatest(_missing, 0)), _tail) END"},
    {
        "_ip": """CASE WHEN _mapped <> '' THEN _mapped
          WHEN _whole IS NOT NULL AND CASE WHEN size(_halves) = 2 THEN _missing >= 0 ELSE _missing = 0 END
            AND forall(_whole, g -> g rlike '^[0-9a-fA-F]{1,4}$')
          THEN concat(array_join(transform(slice(_whole, 1, 4), g -> lower(regexp_replace(g, '^0+(?=.)', ''))), ':'), '::/64')
          ELSE _addr END"""
    },
)

UTC_DAY = "date_format(date_from_unix_date(cast(floor(ts / 86400000) as int)), 'yyyy-MM-dd')"


def short_hash(text: str) -> str:
    return f"substring(sha2({text}, 256), 1, 32)"


def visitor_id(secret: str) -> str:
    """Changes with the UTC day, so it cannot follow a person across days; a native app sends a nonce."""
    anonymous = short_hash(f"concat_ws('|', {quoted(secret)}, {UTC_DAY}, site_id, _ip, coalesce(user_agent, ''))")
    native = short_hash(f"concat_ws('|', {quoted(secret)}, 'device', {UTC_DAY}, site_id, nonce)")
    return f"CASE WHEN nonce <> '' THEN {native} ELSE {anonymous} END"


def identity_hash(secret: str) -> str:
    """The stored form of a user id; a value hashed by the browser is not hashed by us first."""
    told = strip("identity")
    first = f"CASE WHEN {told} {PRE_HASHED} THEN {told} ELSE sha2(concat_ws('|', site_id, {told}), 256) END"
    return f"CASE WHEN {told} = '' THEN '' ELSE {short_hash(f'concat_ws({quoted("|")}, {quoted(secret)}, {quoted("identity")}, site_id, {first})')} END"


# Whether a user id arrived unhashed.
SENT_RAW = f"{strip('identity')} <> '' AND NOT {strip('identity')} {PRE_HASHED}"
