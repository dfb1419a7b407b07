"""What sent a request: bots, devices, automation signals and agent trust."""

from __future__ import annotations

import re

from footlog.functions.stages import quoted

BOT_TABLE_VERSION = "2026-09-19"
SIGNAL_TABLE_VERSION = "2026-09-19"

# What a bot's user agent contains, its name and kind; the first match wins.
BOTS = [
    ("gptbot", "GPTBot", "ai-crawler"), ("oai-searchbot", "OAI-SearchBot", "ai-crawler"),
    ("chatgpt-user", "ChatGPT-User", "ai-agent"), ("claudebot", "ClaudeBot", "ai-crawler"),
    ("claude-web", "Claude-Web", "ai-crawler"), ("claude-user", "Claude-User", "ai-agent"),
    ("anthropic-ai", "anthropic-ai", "ai-crawler"), ("perplexitybot", "PerplexityBot", "ai-crawler"),
    ("perplexity-user", "Perplexity-User", "ai-agent"), ("google-extended", "Google-Extended", "ai-crawler"),
    ("googleother", "GoogleOther", "ai-crawler"), ("bytespider", "Bytespider", "ai-crawler"),
    ("ccbot", "CCBot", "ai-crawler"), ("meta-externalagent", "Meta-ExternalAgent", "ai-crawler"),
    ("applebot-extended", "Applebot-Extended", "ai-crawler"), ("amazonbot", "Amazonbot", "ai-crawler"),
    ("cohere-ai", "cohere-ai", "ai-crawler"), ("diffbot", "Diffbot", "ai-crawler"),
    ("youbot", "YouBot", "ai-crawler"), ("timpibot", "Timpibot", "ai-crawler"),
    ("img2dataset", "img2dataset", "ai-crawler"),
    ("googlebot", "Googlebot", "search-crawler"), ("bingbot", "bingbot", "search-crawler"),
    ("duckduckbot", "DuckDuckBot", "search-crawler"), ("yandexbot", "YandexBot", "search-crawler"),
    ("baiduspider", "Baiduspider", "search-crawler"), ("applebot", "Applebot", "search-crawler"),
    ("slurp", "Yahoo! Slurp", "search-crawler"),
    ("ahrefsbot", "AhrefsBot", "seo"), ("semrushbot", "SemrushBot", "seo"), ("mj12bot", "MJ12bot", "seo"),
    ("dotbot", "DotBot", "seo"), ("petalbot", "PetalBot", "seo"), ("screaming frog", "Screaming Frog", "seo"),
    ("dataforseobot", "DataForSeoBot", "seo"),
    ("facebookexternalhit", "facebookexternalhit", "preview"), ("twitterbot", "Twitterbot", "preview"),
    ("slackbot", "Slackbot", "preview"), ("discordbot", "Discordbot", "preview"),
    ("telegrambot", "TelegramBot", "preview"), ("whatsapp", "WhatsApp", "preview"),
    ("linkedinbot", "LinkedInBot", "preview"), ("embedly", "Embedly", "preview"),
    ("uptimerobot", "UptimeRobot", "monitor"), ("pingdom", "Pingdom", "monitor"),
    ("betteruptime", "Better Uptime", "monitor"), ("statuscake", "StatusCake", "monitor"),
    ("lighthouse", "Lighthouse", "monitor"), ("chrome-lighthouse", "Lighthouse", "monitor"),
    ("gtmetrix", "GTmetrix", "monitor"),
    ("headlesschrome", "HeadlessChrome", "generic"), ("phantomjs", "PhantomJS", "generic"),
    ("puppeteer", "Puppeteer", "generic"), ("playwright", "Playwright", "generic"),
    ("python-requests", "python-requests", "generic"), ("axios/", "axios", "generic"),
    ("node-fetch", "node-fetch", "generic"), ("curl/", "curl", "generic"), ("wget", "Wget", "generic"),
    ("go-http-client", "Go-http-client", "generic"), ("java/", "Java", "generic"),
    (r"\bbot\b", "generic bot", "generic"), ("crawler", "generic crawler", "generic"),
    ("spider", "generic spider", "generic"),
]


# Signal names and weights.
SIGNAL_WEIGHTS = {
    "no-accept-language": 3, "no-fetch-metadata": 3, "chromium-without-client-hints": 3, "platform-mismatch": 5,
    "no-accept": 2,
}


def _holds(match: str) -> str:
    return f"_ua rlike r'{match}'" if match.startswith("\\") else f"contains(_ua, {quoted(match)})"


def _any_of(*needles: str) -> str:
    return "(" + " OR ".join(_holds(n) for n in needles) + ")"


def _chain(rules: list[tuple[str, str]], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {quoted(v)}" for c, v in rules) + f" ELSE {quoted(otherwise)} END"


# ``_bot`` is [kind, name], both '' for what is not a bot; no user agent at all is a bot.
BOT = (
    {"_ua": "lower(coalesce(user_agent, ''))"},
    {
        "_bot": f"""split(CASE WHEN trim(_ua) = '' THEN 'generic|empty user-agent' ELSE
          {_chain([(_holds(m), f"{kind}|{name}") for m, name, kind in BOTS], "|")} END, r'\\|')"""
    },
)

_OS = [
    (_any_of("windows"), "Windows"), (_any_of("android"), "Android"), (_any_of("iphone", "ipad", "ipod"), "iOS"),
    (_any_of("mac os x", "macintosh"), "macOS"), (_any_of("cros"), "ChromeOS"), (_any_of("linux"), "Linux"),
]
_BROWSER = [
    (_any_of("edg/"), "Edge"), (_any_of("opr/", "opera"), "Opera"), (_any_of("samsungbrowser"), "Samsung Internet"),
    (_any_of("firefox", "fxios"), "Firefox"), (_any_of("crios", "chrome"), "Chrome"), (_any_of("safari"), "Safari"),
]
_APP_OS = [
    ("_word IN ('ios', 'ipados')", "iOS"), ("_word = 'android'", "Android"), ("_word = 'macos'", "macOS"),
    ("_word = 'windows'", "Windows"), ("_word = 'linux'", "Linux"),
]


def client(sdk: str = "footlog") -> tuple[dict[str, str], ...]:
    """``device``, ``os`` and ``browser``. A native app sends ``<sdk>-<platform>/<version> (<model>; <os> ...)``."""
    form = rf"r'^{re.escape(sdk)}-[a-z]+/[\d.]+ \(([^;)]*);\s*([a-z]+)'"
    return (
        {"_native": f"_ua rlike {form}", "_model": f"regexp_extract(_ua, {form}, 1)", "_word": f"regexp_extract(_ua, {form}, 2)"},
        {"os": f"CASE WHEN _native THEN {_chain(_APP_OS, 'unknown')} ELSE {_chain(_OS, 'unknown')} END"},
        {
            "browser": f"""CASE WHEN NOT _native THEN {_chain(_BROWSER, "unknown")} WHEN os = 'unknown' THEN 'App' ELSE concat(os, ' app') END""",
            "_device": rf"""CASE
              WHEN _native AND _model rlike r'ipad|tablet|tab\b' THEN 'tablet'
              WHEN _native AND os IN ('iOS', 'Android') THEN 'mobile'
              WHEN NOT _native AND ({_any_of("ipad")} OR ({_any_of("android")} AND NOT {_any_of("mobile")})) THEN 'tablet'
              WHEN NOT _native AND {_any_of("iphone", "ipod", "mobile", "android")} THEN 'mobile'
              WHEN os = 'unknown' THEN 'unknown' ELSE 'desktop' END""",
        },
    )


def _sent(header: str) -> str:
    return f"coalesce(try_element_at(headers, '{header}'), '')"


_PLATFORM = [
    (_any_of("windows"), "windows"), (_any_of("mac os x", "macintosh"), "macos"), (_any_of("android"), "android"),
    (_any_of("linux"), "linux"), (_any_of("iphone", "ipad"), "ios"),
]
_FIRES = {
    "no-accept-language": f"{_sent('accept-language')} = ''",
    "no-fetch-metadata": " AND ".join(f"{_sent(f'sec-fetch-{part}')} = ''" for part in ("mode", "site", "dest")),
    "chromium-without-client-hints": f"{_any_of('chrome/')} AND NOT {_any_of('firefox/')} AND {_sent('sec-ch-ua')} = ''",
    "platform-mismatch": "_claimed <> '' AND _hinted IN ('macos', 'windows', 'android', 'linux', 'ios') AND _claimed <> _hinted",
    "no-accept": f"{_sent('accept')} = ''",
}
# ``bot_signals`` and ``bot_score``: reasons to doubt that a client claiming to be a browser is one.
SIGNALS = (
    {
        "_claims": f"{_any_of('mozilla/')} AND {_any_of('chrome/', 'safari/', 'firefox/')}",
        "_claimed": _chain(_PLATFORM, ""),
        "_hinted": f"lower(replace({_sent('sec-ch-ua-platform')}, '\"', ''))",
    },
    {"_fired": "array_compact(array(" + ", ".join(f"CASE WHEN _claims AND {c} THEN '{rule}' END" for rule, c in _FIRES.items()) + "))"},
    {
        "bot_signals": "array_join(_fired, ',')",
        "bot_score": "cast("
        + " + ".join(f"CASE WHEN array_contains(_fired, '{rule}') THEN {w} ELSE 0 END" for rule, w in SIGNAL_WEIGHTS.items())
        + " as int)",
    },
)

# A verified signature is an agent; any other attempt to sign is not a person.
TRUST = """CASE WHEN signature = 'verified' THEN 'verified'
  WHEN signature IS NOT NULL AND signature <> 'no_signature' THEN 'claimed' WHEN bot_kind <> '' THEN 'claimed' ELSE 'human' END"""
