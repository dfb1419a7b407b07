import json

import pytest
from pyspark.sql import functions as F

from footlog.functions import channels, clients, identity, urls
from footlog.functions.stages import staged
from footlog.plans.enrich import classification_quality, enrich, ingest, rejection_report
from tests.raw import CHROME, GPTBOT, IPHONE, NOW, raw_frame, sites_frame

VIEW = {"site": "demo", "type": "pageview", "url": "/"}


def run(spark, *requests):
    events, refused = enrich(raw_frame(spark, [r if isinstance(r, tuple) else (r, {}) for r in requests]), sites_frame(spark), "s")
    return {r["id"]: r for r in events.collect()}, {r["request_id"]: r["reject_reason"] for r in refused.collect()}


BAD_BODIES = [
    ("[]", "body_not_object"),
    ("nonsense", "body_not_object"),
    ("null", "body_not_object"),
    ({"type": "pageview", "url": "/"}, "site_missing"),
    (VIEW | {"site": 5}, "site_missing"),
    (VIEW | {"site": "a b"}, "site_invalid"),
    (VIEW | {"type": "click"}, "type_invalid"),
    (VIEW | {"type": 1}, "type_invalid"),
    (VIEW | {"url": "  "}, "url_missing"),
    (VIEW | {"type": "event"}, "name_missing"),
    (VIEW | {"type": "event", "name": "a b"}, "name_invalid"),
    (VIEW | {"props": [1]}, "props_not_object"),
    (VIEW | {"props": None}, "props_not_object"),
    (VIEW | {"props": {f"k{i}": i for i in range(25)}}, "props_too_many"),
    ('{"site":"demo","type":"pageview","url":"/","props":{"a":1e999}}', "prop_number_not_finite"),
    (VIEW | {"props": {"a": {"b": 1}}}, "prop_type_unsupported"),
    (VIEW | {"ago": -1}, "ago_invalid"),
    (VIEW | {"ago": "5"}, "ago_invalid"),
    (VIEW | {"ago": None}, "ago_invalid"),
    (VIEW | {"ago": 86_400_001}, "ago_too_old"),
    (VIEW | {"site": "other"}, "site_unknown"),
    (VIEW | {"site": "quiet"}, None),
]


def test_every_refusal_has_its_reason(spark):
    kept, refused = run(spark, *[b for b, _ in BAD_BODIES])
    want = {f"r{i}": reason for i, (_, reason) in enumerate(BAD_BODIES) if reason}
    assert refused == want
    assert len(kept) == 1


def test_rejection_report_counts_by_reason(spark):
    _, refused = enrich(raw_frame(spark, [("[]", {}), ("1", {}), (VIEW | {"url": ""}, {})]), sites_frame(spark), "s")
    assert {tuple(r) for r in rejection_report(refused).collect()} == {("body_not_object", 2), ("url_missing", 1)}


def test_fields_are_cut_folded_or_dropped(spark):
    body = VIEW | {
        "title": "x" * 400, "screen": "1440x900", "lang": "EN-us", "hostname": "WWW.Example.com", "tag": " v2 ",
        "props": {" key ": "v", "": 1, "long": "y" * 600, "n": 1.5, "b": True, "z": None},
    }
    kept, _ = run(spark, body, VIEW | {"screen": "big", "lang": "e", "hostname": "a b"})
    row = kept["r0"]
    assert (len(row.title), row.screen, row.lang, row.hostname, row.tag) == (300, "1440x900", "en-us", "example.com", "v2")
    props = json.loads(row.props)
    assert props == {"key": "v", "long": "y" * 500, "n": 1.5, "b": True, "z": None, "_signal": "none"}
    assert (kept["r1"].screen, kept["r1"].lang, kept["r1"].hostname) == ("", "", "")


def event(props, **more):
    return VIEW | {"type": "event", "name": "purchase", "props": props} | more


@pytest.mark.parametrize(
    "props, want",
    [
        ({"revenue": 12.34567, "currency": "usd"}, {"revenue": 12.3457, "currency": "USD"}),
        ({"revenue": " 12 ", "currency": "EUR"}, {"revenue": 12, "currency": "EUR"}),
        ({"revenue": "12,5", "currency": "EUR"}, {"currency": "EUR", "_revenue_rejected": "amount_not_a_number"}),
        ({"revenue": True, "currency": "EUR"}, {"currency": "EUR", "_revenue_rejected": "amount_not_a_number"}),
        ({"revenue": -1, "currency": "EUR"}, {"currency": "EUR", "_revenue_rejected": "amount_negative"}),
        ({"revenue": 2e9, "currency": "EUR"}, {"currency": "EUR", "_revenue_rejected": "amount_too_large"}),
        ({"revenue": 1}, {"_revenue_rejected": "currency_missing"}),
        ({"revenue": 1, "currency": "euro"}, {"currency": "euro", "_revenue_rejected": "currency_invalid"}),
        ({"plan": "  Pro "}, {"plan": "pro"}),
        ({"plan": "the pro plan, monthly"}, {"_plan_rejected": "plan_not_a_label"}),
        ({"plan": " "}, {"_plan_rejected": "plan_empty"}),
        ({"plan": 3}, {"_plan_rejected": "plan_not_a_string"}),
        ({"User-Email": "x", "a": "ayse@example.com", "b": "+90 532 123 45 67", "c": "1234567890"}, {"c": "1234567890", "_pii_dropped": 3}),
    ],
)
def test_properties_are_normalised(spark, props, want):
    kept, _ = run(spark, event(props))
    assert json.loads(kept["r0"].props) == want | {"_signal": "none"}


def test_strict_sites_keep_little(spark):
    props = {f"p{i}": i for i in range(9, -1, -1)}
    strict = event(props, site="quiet", identity="u1", screen="10x10", referrer="https://Blog.Example/p/x?email=a#f")
    headers = {"cf-ipcountry": "DE", "cf-region-code": "BE", "cf-iplatitude": "52.52", "cf-iplongitude": "13.4"}
    kept, refused = run(
        spark, (strict, {"headers": headers}), (strict, {"headers": {"dnt": "1"}}), (strict, {"headers": {"dnt": "0", "sec-gpc": "1"}}),
        (strict, {"headers": {"sec-gpc": "1"}}), (VIEW, {"headers": {"dnt": "1"}}),
    )
    row = kept["r0"]
    assert (row.identity, row.screen, row.country, row.region, row.lat) == ("", "", "", "", None)
    assert row.referrer == "https://blog.example/p/x"
    assert [k for k in json.loads(row.props) if k != "_signal"] == [f"p{i}" for i in range(9, 1, -1)]
    assert refused == {"r1": "do_not_track", "r3": "do_not_track"}
    assert "r2" in kept and "r4" in kept


def test_place_headers(spark):
    at = {"cf-ipcountry": "de", "cf-region-code": "be", "cf-region": "Berlin", "cf-ipcity": "MÃ¼nchen", "cf-iplatitude": "52.55"}
    vercel = {"x-vercel-ip-country": "BR", "x-vercel-ip-city": "S%C3%A3o%20Paulo", "x-vercel-ip-latitude": "-23.55", "x-vercel-ip-longitude": "-46.65"}
    kept, _ = run(
        spark, (VIEW, {"headers": at | {"cf-iplongitude": "13.449"}}), (VIEW, {"headers": at}), (VIEW, {"headers": vercel}),
        (VIEW, {"headers": {"cf-ipcountry": "XX", "x-country-code": "FR"}}),
        (VIEW, {"headers": {"cf-ipcountry": "US", "cf-iplatitude": "0", "cf-iplongitude": "0"}}),
    )
    a = kept["r0"]
    assert (a.country, a.region, a.region_name, a.city, a.lat, a.lon) == ("DE", "DE-BE", "Berlin", "München", 52.6, 13.4)
    assert kept["r1"].lat is None
    assert (kept["r2"].city, kept["r2"].lat, kept["r2"].lon) == ("São Paulo", -23.5, -46.6)
    assert (kept["r3"].country, kept["r3"].region) == ("FR", "")
    assert (kept["r4"].country, kept["r4"].lat) == ("US", None)


def one(spark, columns, stages, *wanted):
    """The wanted columns of one row of literals after some stages."""
    row = spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, dict) else as_map(v).alias(k) for k, v in columns.items()])
    return tuple(staged(row, *stages).select(*wanted).first())


def as_map(values):
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.create_map(*pairs).cast("map<string,string>")


@pytest.mark.parametrize(
    "ip, want",
    [
        ("176.234.224.62", "176.234.224.62"),
        ("::ffff:176.234.224.62", "176.234.224.62"),
        ("::FFFF:10.0.0.1", "10.0.0.1"),
        ("2a02:e0:73f3:1300:6448:5021:112:af95", "2a02:e0:73f3:1300::/64"),
        ("2a02:e0::1", "2a02:e0:0:0::/64"),
        ("::1", "0:0:0:0::/64"),
        ("2a02:00e0:73f3:1300::1", "2a02:e0:73f3:1300::/64"),
        ("[2a02:e0:73f3:1300::1]", "2a02:e0:73f3:1300::/64"),
        ("fe80::1%eth0", "fe80:0:0:0::/64"),
        ("1:2:3:4:5:6:1.2.3.4", "1:2:3:4::/64"),
        ("1:2:3:4:5:6:7:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4"),
        ("bu:bir:ip:degil:::", "bu:bir:ip:degil:::"),
        ("", ""),
    ],
)
def test_ip_prefix(spark, ip, want):
    assert one(spark, {"ip": ip}, identity.NORMAL_IP, "_ip") == (want,)


@pytest.mark.parametrize(
    "url, want",
    [
        ("https://www.Example.com:8080/a/b/?x=1#frag", ("/a/b", "?x=1", "example.com")),
        ("//cdn.example.com/p", ("/p", "", "cdn.example.com")),
        ("pricing?ref=x", ("/pricing", "?ref=x", "site.test")),
        ("/app#/route/1", ("/app#/route/1", "", "site.test")),
        ("/", ("/", "", "site.test")),
        ("https://a.test/x y/ü", ("/x%20y/%C3%BC", "", "a.test")),
        ("https://a.test/a/./b/../c/", ("/a/c", "", "a.test")),
        ("https://", ("/", "", "site.test")),
        ("http://a b/c", ("/", "", "site.test")),
        ("https://a.test?", ("/", "", "a.test")),
    ],
)
def test_split_url(spark, url, want):
    assert one(spark, {"url": url, "_fallback": "site.test"}, urls.SPLIT_URL, "path", "query", "_url_host") == want


def test_campaign_parameters(spark):
    def utm(query):
        return one(spark, {"query": query}, urls.UTM, *[f"utm_{p}" for p in ("source", "medium", "campaign", "term", "content")])

    assert utm("?utm_source=A+B&utm_medium=%43PC&utm_campaign=x&utm_campaign=y") == ("a b", "cpc", "x", "", "")
    assert utm("?utm_source=%20&ref=hn") == ("hn", "", "", "", "")
    assert utm("?gclid=1") == ("", "cpc", "", "", "")
    assert utm("?gclid=1&utm_medium=email") == ("", "email", "", "", "")
    assert utm("?utm_source=100%") == ("100%", "", "", "", "")


# (referrer, url, user agent, channel, source, bot kind): the golden classification set
# Labelled cases of the classification, all of which must come out as stated.
GOLDEN = [
    ("https://chatgpt.com/", "/", CHROME, "ai", "chatgpt", ""),
    ("", "/?utm_source=chatgpt.com", CHROME, "ai", "chatgpt", ""),
    ("", "/?utm_source=chatgpt", CHROME, "ai", "chatgpt", ""),
    ("https://chat.openai.com/c/abc", "/", CHROME, "ai", "chatgpt", ""),
    ("https://www.perplexity.ai/search/foo", "/", CHROME, "ai", "perplexity", ""),
    ("https://gemini.google.com/app", "/", CHROME, "ai", "gemini", ""),
    ("https://chatgpt.com/", "/?utm_campaign=bahar", CHROME, "ai", "chatgpt", ""),
    ("https://www.google.com/", "/", CHROME, "search", "google", ""),
    ("https://www.google.com.tr/", "/", CHROME, "search", "google", ""),
    ("https://www.google.com/", "/?gclid=abc123", CHROME, "paid", "google", ""),
    ("https://news.google.com/", "/", CHROME, "search", "google", ""),
    ("https://mail.google.com/mail/u/0/", "/", CHROME, "email", "gmail", ""),
    ("", "/?utm_source=bulten&utm_medium=email", CHROME, "email", "bulten", ""),
    ("https://t.co/abc", "/", CHROME, "social", "x", ""),
    ("", "/?ref=producthunt", CHROME, "referral", "producthunt", ""),
    ("https://l.facebook.com/", "/?fbclid=zzz", CHROME, "paid", "facebook", ""),
    ("https://blog.acme.dev/yazi", "/", CHROME, "referral", "blog.acme.dev", ""),
    ("", "/", CHROME, "direct", "", ""),
    ("https://www.example.com/", "/", CHROME, "internal", "", ""),
    ("https://shop.example.com/", "/", CHROME, "internal", "", ""),
    ("", "/blog", GPTBOT, "direct", "", "ai-crawler"),
    ("https://chatgpt.com/", "/", "Mozilla/5.0 (compatible; ChatGPT-User/1.0)", "ai", "chatgpt", "ai-agent"),
    ("", "/", "Mozilla/5.0 (compatible; Googlebot/2.1)", "direct", "", "search-crawler"),
    ("", "/", "Mozilla/5.0 (compatible; AhrefsBot/7.0)", "direct", "", "seo"),
    ("", "/", "Slackbot-LinkExpanding 1.0", "direct", "", "preview"),
    ("", "/", "curl/8.4.0", "direct", "", "generic"),
    ("", "/", "", "direct", "", "generic"),
    ("", "/", "my own bot 1", "direct", "", "generic"),
    ("", "/", IPHONE, "direct", "", ""),
    ("https://claude.ai/chat/1", "/", CHROME, "ai", "claude", ""),
    ("https://copilot.microsoft.com/", "/", CHROME, "ai", "copilot", ""),
    ("https://grok.com/", "/", CHROME, "ai", "grok", ""),
    ("https://chat.deepseek.com/", "/", CHROME, "ai", "deepseek", ""),
    ("https://www.bing.com/search?q=x", "/", CHROME, "search", "bing", ""),
    ("https://duckduckgo.com/", "/", CHROME, "search", "duckduckgo", ""),
    ("https://search.brave.com/search?q=x", "/", CHROME, "search", "brave", ""),
    ("https://outlook.live.com/mail/0/", "/", CHROME, "email", "outlook", ""),
    ("https://news.ycombinator.com/item?id=1", "/", CHROME, "social", "hackernews", ""),
    ("https://www.reddit.com/r/SaaS/comments/x", "/", CHROME, "social", "reddit", ""),
    ("https://www.linkedin.com/feed/", "/", CHROME, "social", "linkedin", ""),
    ("https://example.com/fiyat", "/kayit", CHROME, "internal", "", ""),
    ("https://www.perplexity.ai/", "/", "Mozilla/5.0 (compatible; Perplexity-User/1.0)", "ai", "perplexity", "ai-agent"),
    ("", "/", "Mozilla/5.0 (compatible; ClaudeBot/1.0)", "direct", "", "ai-crawler"),
    ("", "/", "Mozilla/5.0 (compatible; PerplexityBot/1.0)", "direct", "", "ai-crawler"),
    ("", "/", "Mozilla/5.0 (compatible; Claude-User/1.0)", "direct", "", "ai-agent"),
    ("", "/pricing", "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/138.0.0.0 Safari/537.36", "direct", "", ""),
]


def test_golden_classification(spark):
    raw = raw_frame(spark, [(VIEW | {"url": u, "referrer": r}, {"user_agent": a}) for r, u, a, *_ in GOLDEN])
    events, _ = enrich(raw, sites_frame(spark), "s")
    want = spark.createDataFrame(
        [(f"r{i}", c, s, b) for i, (_, _, _, c, s, b) in enumerate(GOLDEN)],
        "id string, want_channel string, want_source string, want_bot string",
    )
    got = {r.id: (r.channel, r.source, r.bot_kind) for r in events.collect()}
    assert got == {f"r{i}": g[3:] for i, g in enumerate(GOLDEN)}
    assert tuple(classification_quality(events, want, ["id"]).first()) == (len(GOLDEN), len(GOLDEN), 1.0, 1.0, 1.0)


@pytest.mark.parametrize(
    "ua, want",
    [
        (CHROME, ("desktop", "macOS", "Chrome")),
        (IPHONE, ("mobile", "iOS", "Safari")),
        ("footlog-ios/1.2 (iPhone15,2; ios 17)", ("mobile", "iOS", "iOS app")),
        ("footlog-ios/1.2 (iPad13,4; ipados 17)", ("tablet", "iOS", "iOS app")),
        ("footlog-kmp/0.1 (x; toaster)", ("unknown", "unknown", "App")),
        ("Mozilla/5.0 (Linux; Android 14; SM-X710) Chrome/1 Safari/1", ("tablet", "Android", "Chrome")),
        ("Mozilla/5.0 (Windows NT 10.0) Chrome/1 Safari/1 Edg/1", ("desktop", "Windows", "Edge")),
        ("", ("unknown", "unknown", "unknown")),
    ],
)
def test_clients(spark, ua, want):
    stages = (*clients.BOT, *clients.client())
    assert one(spark, {"user_agent": ua}, stages, "_device", "os", "browser") == want


def test_automation_signals(spark):
    def signals(ua, headers):
        return one(spark, {"user_agent": ua, "headers": headers}, (*clients.BOT, *clients.SIGNALS), "bot_signals", "bot_score")

    good = {"accept-language": "de", "sec-fetch-mode": "cors", "sec-ch-ua": "x", "accept": "*/*", "sec-ch-ua-platform": '"macOS"'}
    assert signals(CHROME, good) == ("", 0)
    assert signals(CHROME, good | {"sec-ch-ua-platform": '"Windows"'}) == ("platform-mismatch", 5)
    assert signals(CHROME, {}) == ("no-accept-language,no-fetch-metadata,chromium-without-client-hints,no-accept", 11)
    assert signals("curl/8", {}) == ("", 0)


def test_agent_trust_and_signer(spark):
    kept, _ = run(
        spark, VIEW, (VIEW, {"signature": "verified", "signer": "https://a.example"}), (VIEW, {"signature": "unknown_key"}),
        (VIEW, {"signature": "no_signature"}), (VIEW, {"user_agent": GPTBOT}),
    )
    assert [kept[f"r{i}"].agent_trust for i in range(5)] == ["human", "verified", "claimed", "human", "claimed"]
    assert kept["r1"].agent_signer == "https://a.example" and kept["r4"].device == "bot"


def test_identity_is_hashed_once_or_twice(spark):
    import hashlib

    browser = hashlib.sha256(b"demo|user-42").hexdigest()
    kept, _ = run(spark, event({}, identity="user-42"), event({}, identity=browser), event({}))
    assert kept["r0"].identity == kept["r1"].identity != ""
    assert kept["r2"].identity == ""
    assert json.loads(kept["r0"].props)["_id_raw"] is True
    assert "_id_raw" not in json.loads(kept["r1"].props)


def test_sessions_follow_the_inclusive_gap(spark):
    gap = 30 * 60_000
    times = [0, gap, 2 * gap + 1, 2 * gap + 2]
    raw = raw_frame(spark, [(VIEW, {"received_at": NOW + t}) for t in times])
    events, _ = ingest(raw, sites_frame(spark), "s")
    rows = sorted(events.collect(), key=lambda r: r.ts)
    assert rows[0].session_id == rows[1].session_id != rows[2].session_id == rows[3].session_id
    assert len({r.visitor_id for r in rows}) == 1


def test_visitors_change_daily_and_late_events_are_dated_back(spark):
    day = 86_400_000
    nonce = "abcdefghijklmnop"
    kept, _ = run(
        spark, VIEW, (VIEW, {"received_at": NOW + day}), VIEW | {"ago": 3_600_000}, VIEW | {"nonce": nonce},
        (VIEW | {"nonce": nonce}, {"ip": "9.9.9.9"}),
    )
    assert kept["r0"].visitor_id != kept["r1"].visitor_id
    assert kept["r2"].ts == NOW + 2 - 3_600_000
    assert kept["r3"].visitor_id == kept["r4"].visitor_id != kept["r0"].visitor_id


def test_ai_source_names(spark):
    assert one(spark, {"utm_source": "WWW.claude.ai"}, channels.AI_SOURCE, "_assistant") == ("claude",)
    assert one(spark, {"utm_source": "newsletter"}, channels.AI_SOURCE, "_assistant") == (None,)


def test_hosts_are_found_by_their_longest_known_end(spark):
    table = {h: f"{c}:{s}" for c, hosts in channels.HOSTS.items() for h, s in hosts.items()}
    hosts = ["", ".", "com", "localhost", "10.0.0.1"]
    for host in table:
        hosts += [host, f"a.{host}", f"a.b.c.d.{host}", f"x{host}", f"{host}.evil.net", f".{host}", host.split(".", 1)[1], f"mail.{host}"]

    def ends_of(host: str) -> str | None:
        ends = [known for known in table if host == known or host.endswith("." + known)]
        return table[max(ends, key=len)] if ends else None

    rows = spark.createDataFrame([(h,) for h in hosts], "host string").selectExpr("host", f"{channels._by_suffix(table, 'host')} AS found")
    got = {r.host: r.found for r in rows.collect()}
    assert got == {h: ends_of(h) for h in hosts} and sum(v is not None for v in got.values()) > 200
