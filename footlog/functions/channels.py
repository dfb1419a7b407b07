"""Traffic channel of a visit (B14): a fixed, versioned table and an order of precedence."""

from __future__ import annotations

from footlog.functions.stages import listed, quoted

# Fixed value: the version of the tables below.
TABLE_VERSION = "2026-09-13"

# Hosts by channel and the source each stands for.
HOSTS = {
    "ai": {
        "chatgpt.com": "chatgpt", "chat.openai.com": "chatgpt", "openai.com": "chatgpt", "perplexity.ai": "perplexity",
        "www.perplexity.ai": "perplexity", "claude.ai": "claude", "gemini.google.com": "gemini", "bard.google.com": "gemini",
        "aistudio.google.com": "gemini", "copilot.microsoft.com": "copilot", "m365.cloud.microsoft": "copilot",
        "you.com": "you", "phind.com": "phind", "poe.com": "poe", "grok.com": "grok", "x.ai": "grok",
        "mistral.ai": "mistral", "chat.mistral.ai": "mistral", "deepseek.com": "deepseek", "chat.deepseek.com": "deepseek",
        "kagi.com": "kagi", "andisearch.com": "andi", "iask.ai": "iask", "komo.ai": "komo",
    },
    "search": {
        "google.com": "google", "google.com.tr": "google", "bing.com": "bing", "duckduckgo.com": "duckduckgo",
        "yandex.com": "yandex", "yandex.ru": "yandex", "search.brave.com": "brave", "ecosia.org": "ecosia",
        "startpage.com": "startpage", "baidu.com": "baidu", "yahoo.com": "yahoo", "search.marginalia.nu": "marginalia",
    },
    "social": {
        "x.com": "x", "twitter.com": "x", "t.co": "x", "linkedin.com": "linkedin", "lnkd.in": "linkedin",
        "facebook.com": "facebook", "l.facebook.com": "facebook", "instagram.com": "instagram", "reddit.com": "reddit",
        "out.reddit.com": "reddit", "news.ycombinator.com": "hackernews", "producthunt.com": "producthunt",
        "youtube.com": "youtube", "youtu.be": "youtube", "tiktok.com": "tiktok", "threads.net": "threads",
        "bsky.app": "bluesky", "mastodon.social": "mastodon", "medium.com": "medium", "dev.to": "devto",
        "discord.com": "discord", "t.me": "telegram", "github.com": "github", "stackoverflow.com": "stackoverflow",
    },
    "email": {
        "mail.google.com": "gmail", "outlook.live.com": "outlook", "outlook.office.com": "outlook",
        "mail.yahoo.com": "yahoo-mail", "mail.proton.me": "proton", "substack.com": "substack",
    },
}
# The channel a campaign medium stands for.
MEDIUMS = {
    "cpc": "paid", "ppc": "paid", "paid": "paid", "paidsearch": "paid", "paid_search": "paid", "paid_social": "paid",
    "display": "paid", "banner": "paid", "retargeting": "paid", "email": "email", "newsletter": "email", "mail": "email",
    "social": "social", "organic": "search", "referral": "referral", "affiliate": "referral",
}


def _lookup(table: dict[str, str], key: str) -> str:
    pairs = ", ".join(f"{quoted(k)}, {quoted(v)}" for k, v in table.items())
    return f"try_element_at(map({pairs}), {key})"


def _by_suffix(table: dict[str, str], host: str) -> str:
    """What the table says of the longest of its hosts that is the host or a dot-delimited end of it; null when none is.

    The host's own ends are looked up, longest first: as many as the table's hosts have different numbers of labels.
    """
    labels = sorted({h.count(".") + 1 for h in table}, reverse=True)
    return "coalesce(" + ", ".join(_lookup(table, f"substring_index({host}, '.', -{n})") for n in labels) + ")"


_AI_NAMES = sorted(set(HOSTS["ai"].values()))
_BY_HOST = {h: f"{channel}:{source}" for channel, hosts in HOSTS.items() for h, source in hosts.items()}
_TAGGED = "CASE WHEN utm_source <> '' THEN utm_source ELSE referrer_host END"


def _verdict(channel: str, source: str, signal: str) -> str:
    return f"named_struct('channel', {channel}, 'source', {source}, 'signal', '{signal}')"


# The AI assistant a campaign source names, as a host or a bare name; null when it names none.
AI_SOURCE = (
    {"_said": r"regexp_replace(lower(trim(utm_source)), r'^www\.', '')"},
    {
        "_assistant": f"""coalesce({_by_suffix(HOSTS["ai"], "_said")},
          CASE WHEN lower(trim(utm_source)) IN {listed(_AI_NAMES)} THEN lower(trim(utm_source)) END)"""
    },
)

# From ``referrer_host``, ``utm_*`` and ``_own_host`` to ``_verdict``: own host, then an AI campaign source, then the
# referrer's host, then the campaign medium, then an unknown referrer, then an unknown campaign source, else direct.
CLASSIFY = (
    *AI_SOURCE,
    {
        "_own": r"regexp_replace(lower(_own_host), r'^www\.', '')",
        "_found": f"split({_by_suffix(_BY_HOST, 'referrer_host')}, ':')",
        "_medium": _lookup(MEDIUMS, "utm_medium"),
    },
    {
        "_verdict": f"""CASE
          WHEN referrer_host <> '' AND _own <> '' AND (referrer_host = _own OR endswith(referrer_host, concat('.', _own)))
            THEN {_verdict("'internal'", "''", "internal")}
          WHEN _assistant IS NOT NULL THEN {_verdict("'ai'", "_assistant", "utm_source")}
          WHEN _found[0] IN ('search', 'social') AND _medium = 'paid' THEN {_verdict("'paid'", "_found[1]", "utm_medium")}
          WHEN _found IS NOT NULL THEN {_verdict("_found[0]", "_found[1]", "referrer")}
          WHEN _medium IS NOT NULL THEN {_verdict("_medium", _TAGGED, "utm_medium")}
          WHEN referrer_host <> '' THEN {_verdict("'referral'", "referrer_host", "referrer")}
          WHEN utm_source <> '' THEN {_verdict("'referral'", "utm_source", "utm_source")}
          ELSE {_verdict("'direct'", "''", "none")} END"""
    },
)
