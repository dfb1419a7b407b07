"""Privacy (B4 to B7): opt-outs, strict sites, personal properties and plan labels."""

from __future__ import annotations

from footlog.functions.bodies import added, find, kind, replaced, text, without
from footlog.functions.identity import SENT_RAW
from footlog.functions.stages import listed, strip
from footlog.functions.urls import without_query

STRICT_PROPS = 8
PLAN_MAX = 32
# Property names that hold personal data, without case and separators.
PERSONAL_KEYS = [
    "email", "mail", "emailaddress", "useremail", "customeremail", "phone", "phonenumber", "mobile", "mobilephone",
    "tel", "telephone", "gsm", "firstname", "lastname", "fullname", "surname", "givenname", "familyname",
    "displayname", "realname", "address", "streetaddress", "street", "homeaddress", "billingaddress",
    "shippingaddress", "password", "passwd", "pass", "pwd", "token", "accesstoken", "refreshtoken", "idtoken",
    "authtoken", "sessiontoken", "secret", "apikey", "apisecret", "ip", "ipaddress", "userip", "clientip", "dob",
    "dateofbirth", "birthdate", "birthday", "card", "cardnumber", "creditcard", "ccnumber", "cvv", "cvc", "iban",
    "ssn", "tckn", "tckimlik", "tckimlikno", "nationalid", "passport", "passportnumber", "taxid",
]

# Do Not Track, or Global Privacy Control where the former was not sent.
OPTED_OUT = "coalesce(coalesce(try_element_at(headers, 'dnt'), try_element_at(headers, 'sec-gpc')) = '1', false)"


def personal_value(value: str) -> str:
    """Text that is an e-mail address or an international phone number."""
    trimmed = strip(value)
    return (
        rf"({trimmed} rlike r'^[^\s@]{{1,64}}@[^\s@]{{1,255}}\.[A-Za-z]{{2,}}$' OR "
        rf"({trimmed} rlike r'^\+[\d\s().-]{{8,22}}$' AND length(regexp_replace({trimmed}, r'\D', '')) BETWEEN 8 AND 15))"
    )


def personal_key(key: str) -> str:
    return rf"regexp_replace(lower({key}), r'[\s_.-]', '') IN {listed(PERSONAL_KEYS)}"


_PERSONAL = (
    f"NOT startswith(e.k, '_') AND ({personal_key('e.k')} OR "
    f"({kind('e.v')} = 'STRING' AND coalesce({personal_value(text('e.v'))}, false)))"
)

# B5 to B7 and B20, over ``entries``, ``identity``, ``referrer``, ``screen`` and ``strict``.
PROTECT = (
    {
        "entries": f"CASE WHEN strict THEN slice(entries, 1, {STRICT_PROPS}) ELSE entries END",
        "screen": "CASE WHEN strict THEN '' ELSE screen END",
        "identity": "CASE WHEN strict THEN '' ELSE identity END",
        "referrer": f"CASE WHEN strict THEN {without_query('referrer')} ELSE referrer END",
    },
    {"_kept": f"filter(entries, e -> NOT ({_PERSONAL}))"},
    {
        "entries": f"""CASE WHEN size(_kept) < size(entries)
          THEN {added("_kept", "_pii_dropped", "size(entries) - size(_kept)")} ELSE entries END"""
    },
    {"_plan": find("entries", "plan")},
    {"_plan_kind": kind("_plan"), "_plan_label": f"lower({strip(text('_plan'))})"},
    {
        "_plan_refused": rf"""CASE WHEN _plan_kind <> 'STRING' THEN 'plan_not_a_string' WHEN _plan_label = '' THEN 'plan_empty'
          WHEN NOT _plan_label rlike r'^(?=.{{1,{PLAN_MAX}}}$)[a-z0-9][a-z0-9_-]*$' THEN 'plan_not_a_label' END"""
    },
    {
        "entries": f"""CASE WHEN _plan IS NULL THEN entries WHEN _plan_refused IS NULL THEN {replaced("entries", "plan", "_plan_label")}
          ELSE {added(without("entries", "plan"), "_plan_rejected", "_plan_refused")} END"""
    },
    {"entries": f"CASE WHEN {SENT_RAW} THEN {added('entries', '_id_raw', 'true')} ELSE entries END"},
)
