"""The registered queries as plain SQL, written from the metric definitions alone."""

from __future__ import annotations

from checks.sample_view import LONG_VISIT, duckdb_view

FULL = (1_704_067_200_000, 1_706_659_200_000)
LATE = (1_705_363_200_000, 1_706_659_200_000)
MIDDLE = (1_705_294_800_000, 1_705_467_600_000)
EARLY = (1_704_067_200_000, 1_705_363_200_000)
DAY = 86_400_000
HUMAN = "bot_kind = '' AND agent_trust = 'human'"
AGENT = "bot_kind = '' AND agent_trust = 'verified'"


def win(w=FULL) -> str:
    return f"ts >= {w[0]} AND ts < {w[1]}"


def rnd(x: str, n: int = 0) -> str:
    f = 10.0**n
    return f"(floor(CAST({x} AS DOUBLE) * {f} + 0.5) / {f})"


def js(key: str, props: str = "props") -> str:
    return f"json_extract_string({props}, '$.{key}')"


def ev(body: str, *ctes: str, w=FULL) -> str:
    """A query over ``ev`` (all events), ``win`` (the window), ``h`` (its people) and further CTEs."""
    parts = [
        f"ev AS ({duckdb_view()})",
        f"win AS (SELECT * FROM ev WHERE {win(w)})",
        f"h AS (SELECT * FROM win WHERE {HUMAN})",
        *ctes,
    ]
    return "WITH " + ",\n".join(parts) + "\n" + body


def over_days(sql: str) -> str:
    """The same query over visits of up to three days."""
    return sql.replace(f"ev AS ({duckdb_view()})", f"ev AS (SELECT * REPLACE ({LONG_VISIT} AS session_id) FROM ({duckdb_view()}))")


def top(inner: str, order: str, limit: int | None, group: str = "site_id") -> str:
    if limit is None:
        return inner
    return (
        f"SELECT * EXCLUDE (rk) FROM (SELECT q.*, row_number() OVER (PARTITION BY {group} ORDER BY {order}) AS rk "
        f"FROM ({inner}) q) WHERE rk <= {limit}"
    )


CNT = "count(*)"
SES = "count(DISTINCT session_id)"
VIS = "count(DISTINCT visitor_id)"


def one(value: str, where: str = "true", src: str = "h") -> str:
    return ev(f"SELECT site_id, {value} AS value FROM {src} WHERE {where} GROUP BY site_id")


def table(keys: dict[str, str], shows: dict[str, str], where="true", limit=100, order=None, src="h") -> str:
    names = ", ".join(f"{expr} AS {name}" for name, expr in keys.items())
    aggs = ", ".join(f"{expr} AS {name}" for name, expr in shows.items())
    width = ", ".join(str(i + 1) for i in range(len(keys) + 1))
    inner = f"SELECT site_id, {names}, {aggs} FROM {src} WHERE {where} GROUP BY {width}"
    order = order or f"{next(iter(shows))} DESC, " + ", ".join(f"{k} ASC NULLS FIRST" for k in keys)
    return ev(top(inner, order, limit))


def sessions_by(col: str, limit=100, where="true") -> str:
    return table({col: col}, {"sessions": SES}, where, limit)


BITMAP_METRICS = "('visitors.unique', 'sessions.total', 'bots.suspected', 'agent.sessions')"


def comparison(w) -> str:
    """Every scalar of a window beside the window of equal length before it."""
    return (
        f"SELECT c.site_id, c.metric, c.value, coalesce(p.value, 0.0) AS previous, {rnd('c.value - coalesce(p.value, 0.0)', 1)} AS delta_abs, "
        f"CASE WHEN coalesce(p.value, 0.0) <> 0 THEN {rnd('(c.value - p.value) / p.value * 100', 1)} END AS delta_pct "
        f"FROM ({scalar_values(w)}) c LEFT JOIN ({scalar_values((2 * w[0] - w[1], w[0]))}) p USING (site_id, metric)"
    )


def scalar_values(w) -> str:
    """Every scalar of one window as (site_id, metric, value)."""
    ins = win(w)
    counts = {
        "visitors.unique": f"count(DISTINCT CASE WHEN {HUMAN} THEN visitor_id END)",
        "sessions.total": f"count(DISTINCT CASE WHEN {HUMAN} THEN session_id END)",
        "pageviews.total": f"count(CASE WHEN {HUMAN} AND type = 'pageview' THEN 1 END)",
        "ai.sessions": f"count(DISTINCT CASE WHEN {HUMAN} AND channel = 'ai' THEN session_id END)",
        "ai.crawler.hits": "count(CASE WHEN bot_kind = 'ai-crawler' THEN 1 END)",
        "bots.suspected": f"count(DISTINCT CASE WHEN {HUMAN} AND bot_score >= 5 THEN visitor_id END)",
        "agent.sessions": f"count(DISTINCT CASE WHEN {AGENT} THEN session_id END)",
        "agent.pageviews": f"count(CASE WHEN {AGENT} AND type = 'pageview' THEN 1 END)",
        "agents.verified": "count(CASE WHEN agent_trust = 'verified' THEN 1 END)",
        "agents.claimed": "count(CASE WHEN agent_trust = 'claimed' THEN 1 END)",
        "errors.total": f"count(CASE WHEN {HUMAN} AND name = 'error' THEN 1 END)",
        "cta.clicks": f"count(CASE WHEN {HUMAN} AND name = 'cta_click' THEN 1 END)",
        "rage.clicks": f"count(CASE WHEN {HUMAN} AND name = 'rage_click' THEN 1 END)",
        "signups.total": f"count(CASE WHEN {HUMAN} AND name IN ('signup','waitlist','conversion') THEN 1 END)",
        "scroll.depth": f"coalesce({rnd(f'avg(CASE WHEN {HUMAN} AND name = ' + chr(39) + 'scroll' + chr(39) + ' THEN CAST(' + js('percent') + ' AS DOUBLE) END)', 1)}, 0)",
    }
    per_session = (
        f"SELECT site_id, session_id, count(CASE WHEN type = 'pageview' THEN 1 END) AS pv, "
        f"(max(ts) - min(ts)) / 1000.0 AS span, max(CASE WHEN name = 'cta_click' THEN 1 ELSE 0 END) AS cta "
        f"FROM ev WHERE {ins} AND {HUMAN} GROUP BY 1, 2"
    )
    derived = {
        "bounce.rate": rnd("100.0 * count(CASE WHEN pv = 1 THEN 1 END) / count(CASE WHEN pv > 0 THEN 1 END)", 1),
        "visit.duration": rnd("avg(span)", 0),
        "views.per_session": rnd("1.0 * sum(pv) / count(*)", 2),
        "cta.conversion": rnd("100.0 * sum(cta) / count(*)", 1),
    }
    parts = [
        f"SELECT site_id, '{m}' AS metric, CAST({x} AS DOUBLE) AS value FROM ev WHERE {ins} GROUP BY site_id"
        for m, x in counts.items()
    ] + [
        f"SELECT site_id, '{m}' AS metric, CAST({x} AS DOUBLE) AS value FROM ({per_session}) GROUP BY site_id"
        for m, x in derived.items()
    ]
    return " UNION ALL ".join(parts)


def bucket(w, width=DAY, ts="ts") -> str:
    return f"CAST(floor(({ts} - {w[0]}) / {width}) AS BIGINT)"


TRAFFIC = (
    "count(CASE WHEN type = 'pageview' THEN 1 END) AS views, count(DISTINCT visitor_id) AS visitors, "
    "count(DISTINCT session_id) AS sessions, count(CASE WHEN type = 'event' THEN 1 END) AS events"
)
PER_SESSION = (
    "SELECT site_id, session_id, min(ts) AS start, (max(ts) - min(ts)) / 1000.0 AS span, "
    "count(CASE WHEN type = 'pageview' THEN 1 END) AS pv FROM h GROUP BY 1, 2"
)
QUALITY = (
    "count(*) AS sessions, "
    + rnd("100.0 * count(CASE WHEN pv = 1 THEN 1 END) / nullif(count(CASE WHEN pv > 0 THEN 1 END), 0)", 1)
    + " AS bounce_rate, "
    + rnd("avg(span)")
    + " AS duration, "
    + rnd("1.0 * sum(pv) / count(*)", 2)
    + " AS pages_per_session"
)


def nearest(samples: str, keys: str, p: str) -> str:
    """Nearest rank over (keys, val): least(n, floor(p * n) + 1)."""
    return (
        f"SELECT {keys}, max(CASE WHEN rn = least(n, CAST(floor({p} * n) AS BIGINT) + 1) THEN val END) AS value, max(n) AS samples "
        f"FROM (SELECT {keys}, val, row_number() OVER (PARTITION BY {keys} ORDER BY val) AS rn, "
        f"count(*) OVER (PARTITION BY {keys}) AS n FROM ({samples}) s0 WHERE val IS NOT NULL) GROUP BY {keys}"
    )


VITALS = ["lcp", "inp", "cls", "fcp", "ttfb"]


def vital_samples(extra: str, src: str = "h") -> str:
    return " UNION ALL ".join(
        f"SELECT site_id, '{v}' AS vital{extra}, {rnd('CAST(' + js(v) + ' AS DOUBLE)', 3)} AS val FROM {src} WHERE name = 'web_vitals'"
        for v in VITALS
    )


def vitals_overview(window: tuple) -> str:
    return ev(
        "SELECT site_id, vital, percentile, max(CASE WHEN period = 'now' THEN value END) AS value, "
        "coalesce(max(CASE WHEN period = 'now' THEN samples END), 0) AS samples, "
        "max(CASE WHEN period = 'before' THEN value END) AS previous, "
        "coalesce(max(CASE WHEN period = 'before' THEN samples END), 0) AS previous_samples FROM ("
        + " UNION ALL ".join(
            f"SELECT {p} AS percentile, * FROM ({nearest('SELECT * FROM s', 'site_id, vital, period', str(p / 100))})"
            for p in (50, 75, 90, 99)
        )
        + ") GROUP BY 1, 2, 3",
        f"s AS ({vital_samples(f', CASE WHEN {win(window)} THEN ' + chr(39) + 'now' + chr(39) + ' ELSE ' + chr(39) + 'before' + chr(39) + ' END AS period')})",
        w=(2 * window[0] - window[1], window[1]),
    )


def bundle_oracles() -> dict[str, str]:
    edge = (
        "SELECT site_id, path, count(*) AS sessions FROM (SELECT site_id, path, row_number() OVER "
        "(PARTITION BY site_id, session_id ORDER BY ts {d}, ingest_seq {d}) AS rn FROM h WHERE type = 'pageview') "
        "WHERE rn = 1 GROUP BY 1, 2"
    )
    detail = (
        "SELECT site_id, path, count(*) AS views, count(DISTINCT session_id) AS sessions, count(DISTINCT visitor_id) AS visitors, "
        + rnd("avg(CASE WHEN next_ts IS NOT NULL THEN (next_ts - ts) / 1000.0 END)")
        + " AS avg_time, count(CASE WHEN next_ts IS NULL THEN 1 END) AS exits FROM (SELECT *, lead(ts) OVER "
        "(PARTITION BY site_id, session_id ORDER BY ts, ingest_seq) AS next_ts FROM h WHERE type = 'pageview') GROUP BY 1, 2"
    )
    hits = {"hits": CNT}
    live = f"ts >= {FULL[0]} AND {HUMAN}"
    p75_part = (
        "(SELECT site_id, max(CASE WHEN rn = t THEN {v} END) AS {v} FROM (SELECT site_id, {v}, row_number() OVER "
        "(PARTITION BY site_id ORDER BY {v} NULLS FIRST) AS rn, CAST(floor(0.75 * count(*) OVER (PARTITION BY site_id)) AS BIGINT) + 1 AS t "
        "FROM v) GROUP BY site_id) {v}_"
    )
    segs = ["channel", "source", "path", "country", "device", "browser"]
    segment = " UNION ALL ".join(
        f"SELECT site_id, '{d}' AS dimension, {d} AS segment, count(DISTINCT CASE WHEN {win(LATE)} THEN visitor_id END) AS value, "
        f"count(DISTINCT CASE WHEN {win(EARLY)} THEN visitor_id END) AS previous FROM h GROUP BY 1, 2, 3"
        for d in segs
    )
    tidy_tables = [
        ("channels.sessions", "channel", {"sessions": SES}, "true", None),
        ("pages.top", "path", {"views": CNT, "sessions": SES}, "type = 'pageview'", 100),
        ("referrers.top", "referrer_host", {"sessions": SES}, "referrer_host <> ''", 100),
    ]
    tidy = []
    for metric, col, shows, where, limit in tidy_tables:
        aggs = ", ".join(f"{x} AS {n}" for n, x in shows.items())
        inner = top(
            f"SELECT site_id, {col}, {aggs} FROM h WHERE {where} GROUP BY 1, 2", f"{next(iter(shows))} DESC, {col}", limit
        )
        tidy += [
            f"SELECT site_id, '{metric}' AS metric, {col} AS dim_key, '{n}' AS measure, CAST({n} AS DOUBLE) AS value FROM ({inner})"
            for n in shows
        ]
    for metric, direction in (("entry.pages", "ASC"), ("exit.pages", "DESC")):
        inner = top(edge.format(d=direction), "sessions DESC, path", 100)
        tidy.append(
            f"SELECT site_id, '{metric}' AS metric, path AS dim_key, 'sessions' AS measure, CAST(sessions AS DOUBLE) AS value FROM ({inner})"
        )
    tidy.append(
        f"SELECT site_id, metric, '' AS dim_key, 'value' AS measure, value FROM ({scalar_values(FULL)}) WHERE metric IN "
        "('visitors.unique','sessions.total','pageviews.total','bounce.rate','visit.duration','views.per_session')"
    )
    return {
        "e01_timeseries": ev(f"SELECT site_id, {bucket(FULL)} AS bucket, {TRAFFIC} FROM h GROUP BY 1, 2"),
        "e02_timeseries_sessions": ev(
            f"SELECT site_id, {bucket(FULL, ts='start')} AS bucket, {QUALITY} FROM ({PER_SESSION}) GROUP BY 1, 2"
        ),
        "e03_errors_series": ev(
            f"SELECT site_id, {bucket(FULL)} AS bucket, count(*) AS errors, {SES} AS sessions FROM h WHERE name = 'error' GROUP BY 1, 2"
        ),
        "e04_live_visitors": ev(f"SELECT site_id, {VIS} AS value FROM ev WHERE {live} GROUP BY 1"),
        "e05_visitors_unique": one(VIS),
        "e06_sessions_total": one(SES),
        "e07_pageviews_total": one(CNT, "type = 'pageview'"),
        "e08_bounce_rate": ev(
            f"SELECT site_id, {rnd('100.0 * count(CASE WHEN n = 1 THEN 1 END) / count(*)', 1)} AS value FROM (SELECT site_id, session_id, "
            "count(*) AS n FROM h WHERE type = 'pageview' GROUP BY 1, 2) GROUP BY 1"
        ),
        "e09_visit_duration": ev(f"SELECT site_id, {rnd('avg(span)')} AS value FROM ({PER_SESSION}) GROUP BY 1"),
        "e10_views_per_session": ev(f"SELECT site_id, {rnd('1.0 * sum(pv) / count(*)', 2)} AS value FROM ({PER_SESSION}) GROUP BY 1"),
        "e11_channels_sessions": sessions_by("channel", None),
        "e12_ai_sessions": one(SES, "channel = 'ai'"),
        "e13_ai_sources": sessions_by("source", None, "channel = 'ai'"),
        "e14_ai_landing_pages": sessions_by("path", 10, "channel = 'ai' AND type = 'pageview'"),
        "e15_ai_crawler_hits": one(CNT, "bot_kind = 'ai-crawler'", "win"),
        "e16_ai_crawler_pages": table({"path": "path", "bot_name": "bot_name"}, hits, "bot_kind = 'ai-crawler'", 10, src="win"),
        "e17_pages_top": table({"path": "path"}, {"views": CNT, "sessions": SES}, "type = 'pageview'"),
        "e18_titles_top": table({"title": "title"}, {"views": CNT, "sessions": SES}, "type = 'pageview' AND title <> ''"),
        "e19_hostnames_top": table(
            {"hostname": "hostname"}, {"views": CNT, "sessions": SES}, "type = 'pageview' AND hostname <> ''"
        ),
        "e20_pages_detail": ev(top(detail, "views DESC, path", 200)),
        "e21_referrers_top": sessions_by("referrer_host", 100, "referrer_host <> ''"),
        "e22_events_top": table({"name": "name"}, {"count": CNT, "sessions": SES}, "type = 'event'"),
        "e23_outbound_links": table({"host": js("host")}, {"clicks": CNT, "sessions": SES}, "name = 'outbound_click'"),
        "e24_downloads_files": table({"file": js("file")}, {"downloads": CNT, "sessions": SES}, "name = 'file_download'"),
        "e25_devices_sessions": sessions_by("device", None),
        "e26_browsers_sessions": sessions_by("browser", 50),
        "e27_os_sessions": sessions_by("os", 50),
        "e28_screens_sessions": sessions_by("screen", 100, "screen <> ''"),
        "e29_languages_sessions": sessions_by("lang", 100, "lang <> ''"),
        "e30_countries_sessions": sessions_by("country", 250, "country <> ''"),
        "e31_regions_sessions": table(
            {"region": "region"},
            {"sessions": SES, "region_name": "max(region_name)", "country": "max(country)"},
            "region <> ''",
        ),
        "e32_cities_sessions": table({"city": "city"}, {"sessions": SES, "country": "max(country)"}, "city <> ''"),
        "e33_entry_pages": ev(top(edge.format(d="ASC"), "sessions DESC, path", 100)),
        "e34_exit_pages": ev(top(edge.format(d="DESC"), "sessions DESC, path", 100)),
        "e35_utm_campaigns": table(
            {"source": "utm_source", "medium": "utm_medium", "campaign": "utm_campaign"},
            {"sessions": SES},
            "utm_source <> '' OR utm_campaign <> ''",
            15,
            "sessions DESC, campaign, source, medium",
        ),
        **{
            f"e{36 + i}_utm_{part}": sessions_by(f"utm_{part}", 100, f"utm_{part} <> ''")
            for i, part in enumerate(["source", "medium", "campaign", "term", "content"])
        },
        "e41_heatmap_weekhour": ev(
            "SELECT site_id, CAST((floor(ts / 86400000) + 4) % 7 AS INTEGER) AS dow, CAST(floor(ts / 3600000) % 24 AS INTEGER) AS hour, "
            f"{SES} AS sessions FROM h GROUP BY 1, 2, 3"
        ),
        "e42_bots_suspected": one(VIS, "bot_score >= 5"),
        "e43_bots_signal_rules": table(
            {"signals": "bot_signals", "score": "bot_score"},
            {"events": CNT, "visitors": VIS},
            "bot_kind = '' AND bot_signals <> ''",
            15,
            src="win",
        ),
        "e44_agent_sessions": one(SES, AGENT, "win"),
        "e45_agent_pageviews": one(CNT, f"{AGENT} AND type = 'pageview'", "win"),
        "e46_agent_operators": table({"operator": "agent_signer"}, {"sessions": SES, "events": CNT}, AGENT, 10, src="win"),
        "e47_agent_pages": table({"path": "path"}, {"views": CNT, "sessions": SES}, f"{AGENT} AND type = 'pageview'", 10, src="win"),
        "e48_agent_events": table({"name": "name"}, {"count": CNT}, f"{AGENT} AND type = 'event'", 10, src="win"),
        "e49_agents_verified": one(CNT, "agent_trust = 'verified'", "win"),
        "e50_agents_claimed": one(CNT, "agent_trust = 'claimed'", "win"),
        "e51_agents_by_signer": table(
            {"signer": "agent_signer", "agent": "bot_name"},
            {"hits": CNT, "pages": "count(DISTINCT path)"},
            "agent_trust = 'verified' AND agent_signer <> ''",
            15,
            src="win",
        ),
        "e52_agents_unverified_bots": table(
            {"agent": "bot_name", "kind": "bot_kind"}, hits, "agent_trust = 'claimed'", 15, src="win"
        ),
        "e53_vitals_p75": ev(
            f"SELECT site_id, lcp, inp, cls FROM {', '.join([p75_part.format(v='lcp')])} JOIN {p75_part.format(v='inp')} USING (site_id) "
            f"JOIN {p75_part.format(v='cls')} USING (site_id)",
            f"v AS (SELECT site_id, {rnd('CAST(' + js('lcp') + ' AS DOUBLE)')} AS lcp, {rnd('CAST(' + js('inp') + ' AS DOUBLE)')} AS inp, "
            f"{rnd('CAST(' + js('cls') + ' AS DOUBLE)', 3)} AS cls FROM h WHERE name = 'web_vitals' AND {js('lcp')} IS NOT NULL)",
        ),
        "e54_vitals_slow_pages": ev(
            top(
                f"SELECT site_id, path, {rnd('avg(CAST(' + js('lcp') + ' AS DOUBLE))')} AS lcp, count(*) AS samples FROM h "
                f"WHERE name = 'web_vitals' AND {js('lcp')} IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 3",
                "lcp DESC, path",
                10,
            )
        ),
        "e55_errors_total": one(CNT, "name = 'error'"),
        "e56_errors_top": table(
            {"message": js("message"), "path": js("path")}, {"hits": CNT, "sessions": SES}, "name = 'error'", 10
        ),
        "e57_errors_groups": table(
            {"message": js("message"), "source": js("source"), "line": js("line")},
            {"hits": CNT, "sessions": SES, "pages": "count(DISTINCT h.path)", "first_seen": "min(ts)", "last_seen": "max(ts)"},
            "name = 'error'",
            100,
            "sessions DESC, hits DESC, message, source, line",
        ),
        "e58_errors_browsers": table({"browser": "browser", "os": "os"}, hits, "name = 'error'", 8),
        "e59_cta_clicks": one(CNT, "name = 'cta_click'"),
        "e60_cta_conversion": ev(
            "SELECT site_id, "
            + rnd("100.0 * count(DISTINCT CASE WHEN name = 'cta_click' THEN session_id END) / count(DISTINCT session_id)", 1)
            + " AS value FROM h GROUP BY 1"
        ),
        "e61_form_abandon_fields": table({"field": js("field")}, {"abandons": CNT}, "name = 'form_abandon'", 10),
        "e62_scroll_depth": one(rnd(f"avg(CAST({js('percent')} AS DOUBLE))", 1), "name = 'scroll'"),
        "e63_rage_clicks": one(CNT, "name = 'rage_click'"),
        "e64_signups_total": one(CNT, "name IN ('signup', 'waitlist', 'conversion')"),
        "e65_signups_by_channel": table(
            {"channel": "channel"}, {"signups": CNT}, "name IN ('signup', 'waitlist', 'conversion')", None
        ),
        "e70_bundle_scalars": ev(scalar_values(FULL)),
        "e72_period_comparison": ev(comparison(LATE)),
        "e72_unique_comparison_bitmaps": ev(f"SELECT * FROM ({comparison(LATE)}) WHERE metric IN {BITMAP_METRICS}"),
        "e72_unique_comparison_cut_days": ev(f"SELECT * FROM ({comparison(MIDDLE)}) WHERE metric IN {BITMAP_METRICS}"),
        "e74_series_fill": ev(
            f"SELECT s.site_id, b.bucket, {FULL[0]} + b.bucket * {DAY} AS ts, coalesce(q.sessions, 0) AS sessions, q.bounce_rate, "
            "q.duration, q.pages_per_session FROM (SELECT DISTINCT site_id FROM h) s CROSS JOIN (SELECT range AS bucket FROM range(30)) b "
            f"LEFT JOIN (SELECT site_id, {bucket(FULL, ts='start')} AS bucket, {QUALITY} FROM ({PER_SESSION}) GROUP BY 1, 2) q "
            "ON q.site_id = s.site_id AND q.bucket = b.bucket"
        ),
        "e75_series_previous": ev(
            "SELECT s.site_id, b.bucket, "
            + f"{LATE[0]} + b.bucket * {DAY} AS ts, "
            + ", ".join(f"coalesce(c.{m}, 0) AS {m}" for m in ("views", "visitors", "sessions", "events"))
            + ", "
            + ", ".join(f"coalesce(p.{m}, 0) AS previous_{m}" for m in ("views", "visitors", "sessions", "events"))
            + " FROM (SELECT DISTINCT site_id FROM h) s CROSS JOIN (SELECT range AS bucket FROM range(15)) b "
            f"LEFT JOIN (SELECT site_id, {bucket(LATE)} AS bucket, {TRAFFIC} FROM h WHERE {win(LATE)} GROUP BY 1, 2) c "
            "ON c.site_id = s.site_id AND c.bucket = b.bucket "
            f"LEFT JOIN (SELECT site_id, {bucket(EARLY)} AS bucket, {TRAFFIC} FROM h WHERE {win(EARLY)} GROUP BY 1, 2) p "
            "ON p.site_id = s.site_id AND p.bucket = b.bucket"
        ),
        "e76_query_stats": table({"event": "name"}, {"value": SES}, "type = 'event'", 100),
        "e76_query_stats_day": ev(
            f"SELECT site_id, strftime(make_timestamp(ts * 1000), '%Y-%m-%d') AS day, {VIS} AS value FROM h GROUP BY 1, 2"
        ),
        "e77_realtime": ev(
            top(
                f"SELECT site_id, 'all' AS list, '' AS value, {VIS} AS visitors FROM ev WHERE {live} GROUP BY 1 UNION ALL "
                f"SELECT site_id, 'page', path, {VIS} FROM ev WHERE {live} AND type = 'pageview' GROUP BY 1, 3 UNION ALL "
                f"SELECT site_id, 'channel', channel, {VIS} FROM ev WHERE {live} GROUP BY 1, 3",
                "visitors DESC, value",
                10,
                "site_id, list",
            )
        ),
        "e77_pack_overview": ev(" UNION ALL ".join(tidy)),
        "e78_segment_change": ev(f"SELECT *, value - previous AS change FROM ({segment})"),
        "f44_vitals_overview": vitals_overview(LATE),
        "f44_vitals_overview_counts": vitals_overview(MIDDLE),
        "f45_vitals_by_path": ev(
            top(nearest("SELECT * FROM s", "site_id, vital, g", "0.75"), "samples DESC, g", 50, "site_id, vital"),
            f"s AS ({vital_samples(', path AS g')})",
        ),
        "f46_vitals_series": ev(
            nearest("SELECT * FROM s", "site_id, vital, bucket", "0.75"),
            f"s AS ({vital_samples(f', {bucket(FULL)} AS bucket')})",
        ),
    }


SESSION_ATTRIBUTES = "visitor_id country browser os device screen lang channel source referrer_host".split()
TIMELINE = (
    "id ts type name path query title hostname referrer_host channel source props country browser os device screen lang "
    "identity visitor_id utm_source utm_medium utm_campaign"
).split()
FREE = "('free','trial','none','cancelled','canceled','expired','inactive')"
ACTION = (
    "(type = 'event' AND name NOT IN ('pageview','identify','signup','login','logout','plan','renewal','app_open','scroll',"
    "'web_vitals','error','form_submit','form_abandon','outbound_click','file_download','rage_click','cta_click'))"
)
DAY_NO = "CAST(floor(ts / 86400000) AS BIGINT)"


def known(w) -> str:
    return f"k AS (SELECT * FROM ev WHERE ts < {w[1]} AND identity <> '' AND {HUMAN})"


def cond_array(conditions: list[str]) -> str:
    return " UNION ALL ".join(conditions)


def funnel_sql(steps: list[tuple[str, str]], src: str = "h", labels: list[str] | None = None) -> str:
    """One CTE of earliest times per step, joined step by step."""
    def match(step):
        kind, value = step
        return f"type = 'pageview' AND path = '{value}'" if kind == "page" else f"type = 'event' AND name = '{value}'"

    ctes = [f"s0 AS (SELECT site_id, session_id, min(ts) AS t FROM {src} WHERE {match(steps[0])} GROUP BY 1, 2)"]
    for i, step in enumerate(steps[1:], 1):
        ctes.append(
            f"s{i} AS (SELECT e.site_id, e.session_id, min(e.ts) AS t FROM {src} e JOIN s{i - 1} p ON p.site_id = e.site_id "
            f"AND p.session_id = e.session_id AND e.ts >= p.t WHERE {match(step)} GROUP BY 1, 2)"
        )
    counts = " UNION ALL ".join(
        f"SELECT a.site_id, {i} AS step, '{k}' AS type, '{v}' AS value, '{(labels or [x[1] for x in steps])[i]}' AS label, "
        f"(SELECT count(*) FROM s{i} s WHERE s.site_id = a.site_id) AS sessions FROM (SELECT DISTINCT site_id FROM {src}) a"
        for i, (k, v) in enumerate(steps)
    )
    ctes.append(f"n AS ({counts})")
    ctes.append(
        "r AS (SELECT *, lag(sessions) OVER (PARTITION BY site_id ORDER BY step) AS before, "
        "first_value(sessions) OVER (PARTITION BY site_id ORDER BY step) AS base FROM n)"
    )
    ctes.append("d AS (SELECT *, CASE WHEN step = 0 THEN 0 ELSE greatest(before - sessions, 0) END AS dropped FROM r)")
    body = (
        "SELECT site_id, step, type, value, label, sessions, "
        f"CASE WHEN step = 0 THEN 100.0 WHEN before = 0 THEN 0.0 ELSE {rnd('100.0 * sessions / before', 1)} END::DOUBLE AS step_rate, "
        f"CASE WHEN base = 0 THEN 0.0 ELSE {rnd('100.0 * sessions / base', 1)} END::DOUBLE AS total_rate, dropped, "
        "dropped > 0 AND step = (SELECT min(x.step) FROM d x WHERE x.site_id = d.site_id AND x.dropped = "
        "(SELECT max(y.dropped) FROM d y WHERE y.site_id = d.site_id)) AS worst FROM d"
    )
    return body, ctes


WIDE = [("page", "/"), ("event", "error"), ("event", "error"), ("event", "purchase")]


def journeys_sql(steps: int, limit: int, where: str = "true") -> str:
    cols = [f"p{i + 1}" for i in range(steps)]
    picks = ", ".join(f"max(CASE WHEN rn = {i + 1} THEN path END) AS p{i + 1}" for i in range(steps))
    inner = (
        f"SELECT site_id, {', '.join(cols)}, count(*) AS sessions FROM (SELECT site_id, session_id, {picks} FROM (SELECT *, row_number() OVER "
        "(PARTITION BY site_id, session_id ORDER BY ts, ingest_seq) AS rn FROM (SELECT *, lag(path) OVER (PARTITION BY site_id, session_id "
        f"ORDER BY ts, ingest_seq) AS prev FROM h WHERE type = 'pageview') WHERE prev IS NULL OR prev <> path) WHERE rn <= {steps} GROUP BY 1, 2) "
        f"WHERE {where} GROUP BY ALL"
    )
    return ev(top(inner, "sessions DESC, " + ", ".join(f"{c} NULLS FIRST" for c in cols), limit))


PEOPLE = (
    "pp AS (SELECT site_id, identity, min(ts) AS first_ts, max(ts) AS last_ts, count(DISTINCT floor(ts / 86400000)) AS days, "
    f"count(DISTINCT session_id) AS visits, count(CASE WHEN {ACTION} THEN 1 END) AS actions FROM ev WHERE identity <> '' AND {HUMAN} GROUP BY 1, 2), "
    f"pl AS (SELECT site_id, identity, arg_max({js('plan')}, ts * 1000000 + ingest_seq) AS plan FROM ev WHERE identity <> '' AND {HUMAN} "
    f"AND {js('plan')} IS NOT NULL GROUP BY 1, 2), "
    "people AS (SELECT pp.*, pl.plan, CASE WHEN days >= 2 THEN 'returning' WHEN actions > 0 THEN 'one_time' ELSE 'signed_up_only' END AS status "
    "FROM pp LEFT JOIN pl USING (site_id, identity))"
)


def alias_sql() -> str:
    from footlog.functions.aliases import PERSON_ADJECTIVES, PERSON_ANIMALS

    def word(words, start):
        items = ", ".join(f"'{w}'" for w in words)
        return f"([{items}])[CAST(('0x' || substr(identity, {start}, 4))::BIGINT % {len(words)} AS INTEGER) + 1]"

    return f"{word(PERSON_ADJECTIVES, 1)} || ' ' || {word(PERSON_ANIMALS, 5)} || ' · ' || substr(identity, 1, 6)"


def people_list(where: str, order: str) -> str:
    inner = "SELECT site_id, identity, status, actions, days, visits, first_ts, last_ts, plan FROM people WHERE " + where
    return ev(f"SELECT *, {alias_sql()} AS alias FROM ({top(inner, order + ', identity', 100)})", PEOPLE)


PAID = (
    f"paid AS (SELECT *, CAST({js('revenue')} AS DOUBLE) AS amount, {js('currency')} AS currency FROM win WHERE {js('revenue')} IS NOT NULL), "
    f"hp AS (SELECT * FROM paid WHERE {HUMAN}), "
    f"cur AS (SELECT site_id, currency, {rnd('sum(amount)', 4)} AS revenue, count(*) AS orders FROM hp GROUP BY 1, 2), "
    "best AS (SELECT site_id, currency FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY revenue DESC, currency) AS rk FROM cur) "
    "WHERE rk = 1)"
)


def account(w) -> str:
    return (
        "count(*) AS known, count(CASE WHEN cur = 1 THEN 1 END) AS active, count(CASE WHEN prev = 1 THEN 1 END) AS prev_active, "
        f"count(CASE WHEN cur = 1 AND first_ts >= {w[0]} THEN 1 END) AS new_users, count(CASE WHEN cur = 1 AND prev = 1 THEN 1 END) AS retained, "
        f"count(CASE WHEN cur = 1 AND prev = 0 AND first_ts < {w[0]} THEN 1 END) AS resurrected, "
        "count(CASE WHEN cur = 0 AND prev = 1 THEN 1 END) AS churned"
    )


def flags(w) -> str:
    return (
        f"fl AS (SELECT site_id, identity, min(ts) AS first_ts, max(CASE WHEN {win(w)} THEN 1 ELSE 0 END) AS cur, "
        f"max(CASE WHEN {win((2 * w[0] - w[1], w[0]))} THEN 1 ELSE 0 END) AS prev FROM k GROUP BY 1, 2)"
    )


def changes(w) -> str:
    return (
        f"ch AS (SELECT *, lag(plan) OVER (PARTITION BY site_id, identity ORDER BY ts, ingest_seq) AS before FROM (SELECT *, {js('plan')} AS plan "
        f"FROM k WHERE {js('plan')} IS NOT NULL)), mv AS (SELECT *, CASE WHEN plan NOT IN {FREE} AND (before IS NULL OR before IN {FREE}) THEN 'became_paying' "
        f"WHEN plan IN {FREE} AND before IS NOT NULL AND before NOT IN {FREE} THEN 'stopped_paying' END AS move FROM ch WHERE ts >= {w[0]})"
    )


def accounting(w) -> str:
    return ev(
        "SELECT *, new_users + resurrected AS gained, churned AS lost, new_users + resurrected - churned AS net, "
        f"CASE WHEN churned > 0 THEN {rnd('1.0 * (new_users + resurrected) / churned', 2)} END AS quick_ratio, "
        f"CASE WHEN prev_active > 0 THEN {rnd('100.0 * retained / prev_active', 1)} END AS retained_rate FROM (SELECT site_id, {account(w)} FROM fl GROUP BY 1)",
        known(w), flags(w), w=w,
    )


def plan_changes(w) -> str:
    counted = "SELECT site_id, move, plan, count(DISTINCT identity) AS users FROM mv WHERE move IS NOT NULL GROUP BY 1, 2, 3"
    return ev(counted, known(w), changes(w), w=w)


def new_series(w, width: int) -> str:
    return ev(
        f"SELECT site_id, {bucket(w, width, 'first_ts')} AS bucket, count(*) AS new_users FROM (SELECT site_id, identity, min(ts) AS first_ts FROM k "
        f"GROUP BY 1, 2) WHERE first_ts >= {w[0]} GROUP BY 1, 2",
        known(w), w=w,
    )


ACCOUNT, FLAGS, CHANGES = account(LATE), flags(LATE), changes(LATE)
LATEST_PLAN = (
    f"lp AS (SELECT site_id, identity, arg_max({js('plan')}, ts * 1000000 + ingest_seq) AS plan FROM k WHERE {js('plan')} IS NOT NULL GROUP BY 1, 2)"
)
COHORTS = (
    f"act AS (SELECT DISTINCT site_id, identity, {DAY_NO} AS day FROM win WHERE bot_kind = '' AND identity <> ''), "
    "co AS (SELECT site_id, identity, min(day) AS cohort FROM act GROUP BY 1, 2), "
    "sz AS (SELECT site_id, cohort, count(*) AS size FROM co GROUP BY 1, 2), "
    "nw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY cohort DESC) AS rk FROM sz) WHERE rk <= 12), "
    "us AS (SELECT a.site_id, c.cohort, a.day - c.cohort AS off, count(*) AS users FROM act a JOIN co c USING (site_id, identity) GROUP BY 1, 2, 3), "
    f"cells AS (SELECT nw.site_id, nw.cohort * {DAY} AS day, nw.size, CAST(r.range AS INTEGER) AS \"offset\", coalesce(us.users, 0) AS users, "
    + rnd("100.0 * coalesce(us.users, 0) / nw.size", 1)
    + f" AS rate FROM nw CROSS JOIN range(8) r LEFT JOIN us ON us.site_id = nw.site_id AND us.cohort = nw.cohort AND us.off = r.range "
    f"WHERE (nw.cohort + r.range) * {DAY} < {FULL[1]})"
)
SITES = "sites AS (SELECT DISTINCT site_id, CASE WHEN site_id = 's2' THEN 'strict' ELSE 'standard' END AS privacy_mode FROM ev)"
PLATFORM = (
    "CASE WHEN browser = 'iOS app' THEN 'ios' WHEN browser = 'Android app' THEN 'android' "
    "WHEN browser = 'App' OR lower(browser) LIKE '% app' THEN 'app' ELSE 'web' END"
)


def portfolio_ctes() -> list[str]:
    z = ["visitors", "pageviews", "prev_visitors", "signups", "became_paying", "stopped_paying", "paying"]
    z += [f"{p}_visitors" for p in ("web", "ios", "android", "app")]
    people = ["known", "active", "prev_active", "new_users", "resurrected", "churned"]
    plats = ", ".join(
        f"count(DISTINCT CASE WHEN {PLATFORM} = '{p}' THEN visitor_id END) AS {p}_visitors" for p in ("web", "ios", "android", "app")
    )
    return [
        known(LATE), FLAGS, CHANGES, LATEST_PLAN, SITES,
        f"tr AS (SELECT site_id, count(DISTINCT CASE WHEN {win(LATE)} THEN visitor_id END) AS visitors, count(CASE WHEN {win(LATE)} AND type = 'pageview' "
        f"THEN 1 END) AS pageviews, count(DISTINCT CASE WHEN {win(EARLY)} THEN visitor_id END) AS prev_visitors FROM ev WHERE {HUMAN} GROUP BY 1)",
        f"pe AS (SELECT site_id, {ACCOUNT} FROM fl GROUP BY 1)",
        f"sg AS (SELECT site_id, count(*) AS signups FROM ev WHERE {win(LATE)} AND {HUMAN} AND name = 'signup' GROUP BY 1)",
        "mo AS (SELECT site_id, count(DISTINCT CASE WHEN move = 'became_paying' THEN identity END) AS became_paying, "
        "count(DISTINCT CASE WHEN move = 'stopped_paying' THEN identity END) AS stopped_paying FROM mv GROUP BY 1)",
        f"pa AS (SELECT site_id, count(CASE WHEN plan NOT IN {FREE} THEN 1 END) AS paying FROM lp GROUP BY 1)",
        f"wd AS (SELECT site_id, {plats} FROM ev WHERE {win(LATE)} AND {HUMAN} GROUP BY 1)",
        "pf AS (SELECT sites.site_id, " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in z) + ", "
        + ", ".join(f"CASE WHEN privacy_mode <> 'strict' THEN coalesce({c}, 0) END AS {c}" for c in people)
        + " FROM sites LEFT JOIN tr USING (site_id) LEFT JOIN pe USING (site_id) LEFT JOIN sg USING (site_id) LEFT JOIN mo USING (site_id) "
        "LEFT JOIN pa USING (site_id) LEFT JOIN wd USING (site_id))",
    ]


def portfolio_series(w, buckets: int, sites: str) -> str:
    """Per listed site and bucket; people only where they are measured."""
    return (
        f"SELECT s.site_id, b.range AS bucket, coalesce(q.visitors, 0) AS visitors, CASE WHEN s.privacy_mode <> 'strict' THEN coalesce(q.users, 0) END AS users "
        f"FROM {sites} s CROSS JOIN range({buckets}) b LEFT JOIN (SELECT site_id, {bucket(w)} AS bucket, {VIS} AS visitors, count(DISTINCT CASE WHEN identity <> '' "
        "THEN identity END) AS users FROM h GROUP BY 1, 2) q ON q.site_id = s.site_id AND q.bucket = b.range"
    )


def report_oracles() -> dict[str, str]:
    late, middle = {"w": LATE}, {"w": MIDDLE}
    de = "country = 'DE' AND browser <> 'Safari'"
    sess = (
        "SELECT m.site_id, m.session_id, " + ", ".join(f"f.{c}" for c in SESSION_ATTRIBUTES) + ", a.identity, a.started, a.ended, "
        "CAST(floor((a.ended - a.started) / 1000) AS BIGINT) AS duration, a.pageviews, a.events, "
        "p.entry_page, p.exit_page FROM m JOIN (SELECT site_id, session_id, min(ts) AS started, max(ts) AS ended, max(identity) AS identity, "
        "count(CASE WHEN type = 'pageview' THEN 1 END) AS pageviews, count(CASE WHEN type = 'event' THEN 1 END) AS events FROM ev GROUP BY 1, 2) a "
        "USING (site_id, session_id) JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site_id, session_id ORDER BY ts, ingest_seq) AS rn "
        "FROM ev) WHERE rn = 1) f USING (site_id, session_id) LEFT JOIN (SELECT site_id, session_id, arg_min(path, ts * 1000000 + ingest_seq) AS entry_page, "
        "arg_max(path, ts * 1000000 + ingest_seq) AS exit_page FROM ev WHERE type = 'pageview' GROUP BY 1, 2) p USING (site_id, session_id)"
    )
    m = "m AS (SELECT DISTINCT site_id, session_id FROM h WHERE path = '/p/3')"

    def users(key, cond):
        inner = (
            f"SELECT site_id, {key} AS id, {SES} AS sessions, count(CASE WHEN type = 'pageview' THEN 1 END) AS pageviews, "
            "count(CASE WHEN type = 'event' THEN 1 END) AS events, min(ts) AS first_seen, max(ts) AS last_seen, "
            + ", ".join(f"arg_max({c}, ts * 1000000 + ingest_seq) AS {c}" for c in ("country", "device", "browser", "os"))
            + f" FROM h WHERE {cond} GROUP BY 1, 2"
        )
        return ev(top(inner, "last_seen DESC, id", 200))

    def counts(kind):
        return f"count(DISTINCT CASE WHEN {kind} THEN session_id END)"

    entries = (
        "ee AS (SELECT site_id, session_id, arg_min(path, ts * 1000000 + ingest_seq) AS entry, arg_max(path, ts * 1000000 + ingest_seq) AS leave "
        "FROM ev WHERE type = 'pageview' GROUP BY 1, 2)"
    )
    exploded = (
        "ex AS (SELECT site_id, name, session_id, identity, ts, ingest_seq, unnest(json_keys(props)) AS key, props FROM {src}), "
        "kv AS (SELECT * EXCLUDE (props), json_extract_string(props, '$.' || key) AS value FROM ex WHERE key NOT LIKE '\\_%' ESCAPE '\\')"
    )
    funnels = {}
    for key, steps, src, labels in (
        ("f13_funnel", [("page", "/"), ("event", "cta_click"), ("event", "signup")], "h", ["Home page", "Clicked the CTA", "Signed up"]),
        ("f13_funnel_repeats", WIDE, "h", None),
        ("f13_funnel_agents", [("page", "/p/3"), ("event", "error")], "ag", None),
        ("f13_funnel_filtered", WIDE, "mo", None),
    ):
        body, ctes = funnel_sql(steps, src, labels)
        funnels[key] = ev(body, f"ag AS (SELECT * FROM win WHERE {AGENT})", "mo AS (SELECT * FROM h WHERE device = 'mobile')", *ctes)
    pay = "SELECT site_id, {g} AS g, {c} AS currency, " + rnd("sum(amount)", 4) + " AS revenue, count(*) AS orders FROM {t} GROUP BY 1, 2, 3"
    ft = "ft AS (SELECT site_id, session_id, arg_min(channel, ts * 1000000 + ingest_seq) AS g FROM ev GROUP BY 1, 2)"
    first_cols = "country region region_name city lat lon browser os device channel source referrer_host".split()
    aud = {
        "human": HUMAN,
        "human_strict": f"{HUMAN} AND bot_score < 5",
        "agent": AGENT,
        "unbotted": "bot_kind = ''",
        "everyone": "true",
    }
    filtered = ev(
        f"SELECT c.site_id, c.metric, c.value, coalesce(p.value, 0.0) AS previous, {rnd('c.value - coalesce(p.value, 0.0)', 1)} AS delta_abs, "
        f"CASE WHEN coalesce(p.value, 0.0) <> 0 THEN {rnd('(c.value - p.value) / p.value * 100', 1)} END AS delta_pct "
        f"FROM ({scalar_values(LATE)}) c LEFT JOIN ({scalar_values(EARLY)}) p USING (site_id, metric)"
    ).replace("ev AS (", "ev0 AS (", 1).replace("win AS (", f"ev AS (SELECT * FROM ev0 WHERE {de}),\nwin AS (", 1)
    return {
        "d01_audiences": ev(
            cond_array([f"SELECT site_id, '{n}' AS audience, count(*) AS events, {SES} AS sessions FROM ev WHERE {c} GROUP BY 1" for n, c in aud.items()])
        ),
        "d02_row_filter": sessions_by("channel", None, de),
        "d03_property_filter": table({"name": "name"}, {"count": CNT, "sessions": SES}, f"type = 'event' AND {js('tier')} = 't1'"),
        "d04_session_event_filter": table(
            {"path": "path"},
            {"views": CNT, "sessions": SES},
            "type = 'pageview' AND (site_id, session_id) IN (SELECT (site_id, session_id) FROM ev WHERE type = 'event' AND name = 'purchase')",
        ),
        "d05_entry_exit_filter": ev(
            top(
                f"SELECT h.site_id, channel, {SES} AS value FROM h JOIN ee USING (site_id, session_id) WHERE entry = '/' AND leave <> '/p/1' GROUP BY 1, 2",
                "value DESC, channel",
                10,
            ),
            entries,
        ),
        "d06_is_not": table({"device": "device"}, {"value": "count(CASE WHEN type = 'event' THEN 1 END)"}, "os <> 'iOS'", 10),
        "d07_like": table(
            {"referrer_host": "referrer_host"},
            {"value": SES},
            "referrer_host ILIKE '%google%' AND path ILIKE '/p/%' AND browser NOT ILIKE '%app%'",
            10,
        ),
        "d08_regex": table(
            {"path": "path"}, {"value": SES}, "regexp_matches(path, '^/p/[1-3]$') AND NOT regexp_matches(source, 'oo')", 10
        ),
        "d08_matched_values": ev("SELECT DISTINCT site_id, path AS value FROM ev WHERE regexp_matches(path, '^/p/[1-3]$')"),
        "d09_filtered_comparison": filtered,
        "d11_suggestions": table({"value": "path"}, {"sessions": SES}, "type = 'pageview' AND path ILIKE '%p/%'", 50),
        "d11_property_suggestions": table({"value": js("currency")}, {"sessions": SES}, f"type = 'event' AND {js('currency')} IS NOT NULL", 50),
        "f01_sessions": ev(top(sess, "started DESC, session_id", 200), m, **late),
        "f01_sessions_over_days": over_days(ev(sess, m, **middle)),
        "d04_event_filter_over_days": over_days(
            ev(
                top(
                    f"SELECT site_id, path, {CNT} AS views, {SES} AS sessions FROM h WHERE type = 'pageview' AND (site_id, session_id) IN "
                    "(SELECT (site_id, session_id) FROM ev WHERE type = 'event' AND name = 'purchase') GROUP BY 1, 2",
                    "views DESC, path",
                    100,
                ),
                **middle,
            )
        ),
        "d05_entry_exit_over_days": over_days(
            ev(
                top(
                    f"SELECT h.site_id, channel, {SES} AS value FROM h JOIN ee USING (site_id, session_id) WHERE entry = '/' AND leave <> '/p/1' GROUP BY 1, 2",
                    "value DESC, channel",
                    10,
                ),
                entries,
                **middle,
            )
        ),
        "f40_first_touch_over_days": over_days(
            ev(
                top(
                    pay.format(g="ft.g", c="currency", t="hp JOIN best USING (site_id, currency) JOIN ft USING (site_id, session_id)"),
                    "revenue DESC, g",
                    50,
                ),
                PAID,
                ft,
                **middle,
            )
        ),
        "f01_sessions_total": ev("SELECT site_id, count(DISTINCT session_id) AS n FROM m GROUP BY 1", m, **late),
        "f02_timelines": ev(
            "SELECT site_id, session_id, " + ", ".join(TIMELINE) + " FROM (SELECT *, row_number() OVER (PARTITION BY site_id, session_id "
            "ORDER BY ts, ingest_seq) AS rk FROM ev) WHERE rk <= 2000"
        ),
        "f03_users": users("identity", "identity <> ''"),
        "f03_visitors": users("visitor_id", "identity = ''"),
        "f03_users_total": ev("SELECT site_id, count(DISTINCT identity) AS n FROM h WHERE identity <> '' GROUP BY 1"),
        "f04_profiles": ev(
            f"SELECT site_id, identity, {SES} AS sessions, count(CASE WHEN type = 'pageview' THEN 1 END) AS pageviews, count(CASE WHEN type = 'event' "
            f"THEN 1 END) AS events, min(ts) AS first_seen, max(ts) AS last_seen FROM ev WHERE identity <> '' AND {HUMAN} GROUP BY 1, 2"
        ),
        "f05_traits": ev(
            "SELECT site_id, identity, key, arg_max(value, ts * 1000000 + ingest_seq) AS value FROM kv GROUP BY 1, 2, 3",
            "idf AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site_id, identity ORDER BY ts DESC, ingest_seq DESC) AS rk FROM ev "
            "WHERE name = 'identify' AND identity <> '') WHERE rk <= 50)",
            exploded.format(src="idf"),
        ),
        "f06_event_properties": ev(
            top(
                f"SELECT site_id, name, key, value, count(*) AS count, {SES} AS sessions FROM kv GROUP BY 1, 2, 3, 4",
                "key, count DESC, value NULLS FIRST",
                500,
                "site_id, name",
            ),
            "he AS (SELECT * FROM h WHERE type = 'event')",
            exploded.format(src="he"),
        ),
        "f07_event_series": ev(
            f"SELECT site_id, name, {bucket(FULL)} AS bucket, count(*) AS count, {SES} AS sessions FROM h WHERE type = 'event' GROUP BY 1, 2, 3"
        ),
        "f08_event_log": ev(
            "SELECT site_id, name, ts, path, session_id, props, country, browser, os, device FROM (SELECT *, row_number() OVER (PARTITION BY site_id, name "
            "ORDER BY ts DESC, ingest_seq DESC) AS rk FROM h WHERE type = 'event') WHERE rk <= 100"
        ),
        "f09_error_occurrences": ev(
            "SELECT site_id, ts, path, session_id, browser, os, device, country FROM (SELECT *, row_number() OVER (PARTITION BY site_id "
            f"ORDER BY ts DESC, ingest_seq DESC) AS rk FROM h WHERE name = 'error' AND {js('message')} = 'E1' AND {js('source')} = '/a1.js' "
            f"AND {js('line')} = '1') WHERE rk <= 200"
        ),
        "f10_journeys": journeys_sql(4, 100),
        "f10_journeys_filtered": journeys_sql(3, 100, "p1 LIKE '/p/%' AND p3 = '/p/2'"),
        "f10_journeys_total": ev(f"SELECT site_id, {SES} AS total_sessions FROM h WHERE type = 'pageview' GROUP BY 1"),
        "f12_goal_page": ev(
            "SELECT site_id, c AS conversions, s AS sessions, " + rnd("100.0 * c / s", 1) + " AS rate FROM (SELECT site_id, "
            + counts("type = 'pageview' AND regexp_matches(path, '^/p/[^/]*$')") + f" AS c, {SES} AS s FROM h GROUP BY 1)"
        ),
        "f12_goal_event": ev(
            "SELECT site_id, c AS conversions, s AS sessions, " + rnd("100.0 * c / s", 1) + " AS rate FROM (SELECT site_id, "
            + counts(f"type = 'event' AND name = 'purchase' AND {js('currency')} = 'USD'") + f" AS c, {SES} AS s FROM h GROUP BY 1)"
        ),
        "f12_goal_paths": ev("SELECT DISTINCT site_id, path FROM ev WHERE type = 'pageview' AND path LIKE '/%'"),
        **funnels,
        "f15_retention": ev("SELECT * FROM cells", COHORTS),
        "f15_retention_curve": ev(
            'SELECT site_id, "offset", ' + rnd("100.0 * sum(users) / sum(size)", 1) + ' AS rate FROM cells GROUP BY 1, 2', COHORTS
        ),
        "f15_availability": ev(
            "SELECT site_id, privacy_mode <> 'strict' AND n > 0 AS available, CASE WHEN privacy_mode = 'strict' THEN 'strict_mode' "
            "WHEN n = 0 THEN 'no_identity' ELSE '' END AS reason FROM sites JOIN (SELECT site_id, count(CASE WHEN identity <> '' THEN 1 END) AS n "
            "FROM win WHERE bot_kind = '' GROUP BY 1) USING (site_id)",
            SITES,
        ),
        "f16_accounting": accounting(LATE),
        "f16_accounting_ledger": accounting(MIDDLE),
        "f17_one_and_done": ev(
            "SELECT site_id, count(*) AS eligible, count(CASE WHEN days = 1 THEN 1 END) AS one_day, "
            + rnd("100.0 * count(CASE WHEN days = 1 THEN 1 END) / count(*)", 1)
            + f" AS rate FROM (SELECT site_id, identity, min(ts) AS first_ts, count(DISTINCT {DAY_NO}) AS days FROM k GROUP BY 1, 2) "
            f"WHERE first_ts >= {LATE[0]} AND first_ts < {LATE[1] - 7 * DAY} GROUP BY 1",
            known(LATE), **late,
        ),
        "f18_lifecycle_events": ev(
            "SELECT site_id, name, count(*) AS events, count(DISTINCT CASE WHEN identity <> '' THEN identity END) AS users FROM h "
            "WHERE name IN ('signup', 'login', 'logout') GROUP BY 1, 2"
        ),
        "f19_plans": ev(top("SELECT site_id, plan, count(*) AS users FROM lp GROUP BY 1, 2", "users DESC, plan", 20), known(FULL), LATEST_PLAN),
        "f20_plan_changes": plan_changes(LATE),
        "f20_plan_changes_ledger": plan_changes(MIDDLE),
        "f21_active_series": ev(
            f"SELECT site_id, {bucket(FULL)} AS bucket, count(DISTINCT identity) AS active FROM h WHERE identity <> '' GROUP BY 1, 2"
        ),
        "f21_new_series": new_series(FULL, DAY),
        "f21_new_series_ledger": new_series(MIDDLE, 3_600_000),
        "f22_privacy_check": ev(
            f"SELECT site_id, count(CASE WHEN {js('_id_raw')} IN ('true', '1') THEN 1 END) AS raw_ids, "
            f"CAST(coalesce(sum(CAST({js('_pii_dropped')} AS BIGINT)), 0) AS BIGINT) AS pii_dropped, "
            f"count({js('_plan_rejected')}) AS plan_rejected FROM win GROUP BY 1"
        ),
        "f23_data_from": ev("SELECT site_id, min(ts) AS data_from FROM ev WHERE identity <> '' GROUP BY 1"),
        "f24_people": people_list("true", "last_ts DESC"),
        "f24_people_segment": people_list("status = 'returning' AND plan = 'pro'", "actions DESC"),
        "f24_people_total": ev("SELECT site_id, count(*) AS total FROM people WHERE status = 'returning' GROUP BY 1", PEOPLE),
        "f25_people_summary": ev(
            "SELECT site_id, count(*) AS known, count(CASE WHEN status = 'returning' THEN 1 END) AS \"returning\", count(CASE WHEN status = 'one_time' THEN 1 END) "
            "AS one_time, count(CASE WHEN status = 'signed_up_only' THEN 1 END) AS signed_up_only, "
            f"count(CASE WHEN last_ts >= {FULL[1] - 7 * DAY} THEN 1 END) AS active_7d, count(CASE WHEN last_ts >= {FULL[1] - 30 * DAY} THEN 1 END) AS active_30d, "
            f"count(CASE WHEN first_ts >= {FULL[1] - 30 * DAY} THEN 1 END) AS new_30d, "
            f"count(CASE WHEN first_ts >= {FULL[1] - 30 * DAY} AND days >= 2 THEN 1 END) AS new_30d_returned FROM people GROUP BY 1",
            PEOPLE,
        ),
        "f26_top_actions": ev(
            top(
                f"SELECT site_id, identity, name, count(*) AS n FROM ev WHERE identity <> '' AND {HUMAN} AND {ACTION} GROUP BY 1, 2, 3",
                "n DESC, name",
                3,
                "site_id, identity",
            )
        ),
        "f27_people_by_plan": ev(
            top("SELECT site_id, plan, count(*) AS users FROM people WHERE plan IS NOT NULL GROUP BY 1, 2", "users DESC, plan", 20), PEOPLE
        ),
        "f28_actions_by_day": ev(
            "SELECT d.site_id, d.identity, d.day, d.total, a.name, count(*) AS n FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site_id, identity "
            "ORDER BY day DESC) AS rk FROM (SELECT site_id, identity, day, count(*) AS total FROM a GROUP BY 1, 2, 3)) WHERE rk <= 14) d "
            "JOIN a USING (site_id, identity, day) GROUP BY 1, 2, 3, 4, 5",
            f"a AS (SELECT site_id, identity, {DAY_NO} * {DAY} AS day, name FROM ev WHERE identity <> '' AND {HUMAN} AND {ACTION})",
        ),
        "f28_latest_visits": ev(
            top(
                "SELECT site_id, identity, session_id, min(ts) AS started, max(ts) AS ended, count(CASE WHEN type = 'pageview' THEN 1 END) AS pages, "
                f"count(CASE WHEN {ACTION} THEN 1 END) AS actions FROM ev WHERE identity <> '' AND {HUMAN} GROUP BY 1, 2, 3",
                "started DESC, session_id",
                10,
                "site_id, identity",
            )
        ),
        "f30_portfolio_traffic": ev("SELECT * FROM tr", *portfolio_ctes(), **late),
        "f31_portfolio_people": ev("SELECT * FROM pe", *portfolio_ctes(), **late),
        "f32_portfolio_signups": ev("SELECT * FROM sg", *portfolio_ctes(), **late),
        "f32_portfolio_moves": ev("SELECT site_id, became_paying, stopped_paying FROM mo", *portfolio_ctes(), **late),
        "f32_portfolio_paying": ev("SELECT * FROM pa", *portfolio_ctes(), **late),
        "f33_portfolio_revenue": ev("SELECT * FROM cur", PAID, **late),
        "f34_portfolio_series": ev(
            portfolio_series(FULL, 30, "sites"), SITES
        ),
        "f34_portfolio_sites": ev(
            portfolio_series(LATE, 15, "(SELECT * FROM sites UNION ALL SELECT 's9', 'standard')"), SITES, **late
        ),
        "f35_portfolio_platforms": ev(f"SELECT site_id, {PLATFORM} AS platform, {VIS} AS visitors FROM h GROUP BY 1, 2"),
        "f36_portfolio": ev("SELECT * FROM pf", *portfolio_ctes(), **late),
        "f36_portfolio_totals": ev(
            "SELECT count(*) AS sites, "
            + ", ".join(
                f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}"
                for c in "visitors prev_visitors active new_users churned signups became_paying paying".split()
            )
            + " FROM pf",
            *portfolio_ctes(),
            **late,
        ),
        "f36_portfolio_money": ev(
            f"SELECT currency, {rnd('sum(' + rnd('revenue', 2) + ')', 2)} AS revenue, CAST(sum(orders) AS BIGINT) AS orders FROM cur "
            "WHERE currency <> '' GROUP BY 1",
            PAID,
        ),
        "f37_revenue_currencies": ev("SELECT * FROM cur", PAID),
        "f38_revenue_totals": ev(
            "SELECT b.site_id, b.currency, "
            + rnd(f"sum(CASE WHEN {win(LATE)} THEN amount ELSE 0 END)", 4)
            + f" AS revenue, count(CASE WHEN {win(LATE)} THEN 1 END) AS orders, count(DISTINCT CASE WHEN {win(LATE)} THEN session_id END) AS sessions, "
            + rnd(f"sum(CASE WHEN {win(EARLY)} THEN amount ELSE 0 END)", 2)
            + f" AS previous_revenue, count(CASE WHEN {win(EARLY)} THEN 1 END) AS previous_orders, count(DISTINCT CASE WHEN {win(EARLY)} THEN session_id END) "
            f"AS previous_sessions FROM best b JOIN (SELECT *, CAST({js('revenue')} AS DOUBLE) AS amount, {js('currency')} AS currency FROM ev "
            f"WHERE {HUMAN} AND {js('revenue')} IS NOT NULL) p ON p.site_id = b.site_id AND p.currency = b.currency GROUP BY 1, 2",
            PAID,
            **late,
        ),
        "f39_revenue_per_visitor": ev(
            "SELECT v.site_id, b.currency, v.visitors, v.sessions, "
            + rnd(f"{rnd('t.revenue', 2)} / t.orders", 2) + " AS average_order_value, "
            + rnd(f"{rnd('t.revenue', 2)} / v.visitors", 2) + " AS revenue_per_visitor, "
            + rnd("100.0 * t.paying / v.sessions", 2)
            + f" AS conversion_rate FROM (SELECT site_id, {VIS} AS visitors, {SES} AS sessions FROM h GROUP BY 1) v JOIN best b USING (site_id) "
            f"JOIN (SELECT site_id, currency, {rnd('sum(amount)', 4)} AS revenue, count(*) AS orders, {SES} AS paying FROM hp GROUP BY 1, 2) t "
            "ON t.site_id = b.site_id AND t.currency = b.currency",
            PAID,
        ),
        "f38_revenue_no_sales": ev(
            "SELECT DISTINCT site_id, 'GBP' AS currency, CAST(0 AS DOUBLE) AS revenue, 0 AS orders, 0 AS sessions, CAST(0 AS DOUBLE) AS previous_revenue, 0 AS previous_orders, "
            f"0 AS previous_sessions FROM ev WHERE {HUMAN} AND {win((EARLY[0], LATE[1]))}"
        ),
        "f39_revenue_no_sales": ev(
            f"SELECT site_id, 'GBP' AS currency, {VIS} AS visitors, {SES} AS sessions, CAST(NULL AS DOUBLE) AS average_order_value, CAST(0 AS DOUBLE) AS revenue_per_visitor, "
            "CAST(0 AS DOUBLE) AS conversion_rate FROM h GROUP BY 1"
        ),
        "f39_revenue_named": ev(
            "SELECT v.site_id, 'EUR' AS currency, v.visitors, v.sessions, "
            + rnd(f"{rnd('t.revenue', 2)} / t.orders", 2) + " AS average_order_value, "
            + rnd(f"{rnd('coalesce(t.revenue, 0)', 2)} / v.visitors", 2) + " AS revenue_per_visitor, "
            + rnd("100.0 * coalesce(t.paying, 0) / v.sessions", 2)
            + f" AS conversion_rate FROM (SELECT site_id, {VIS} AS visitors, {SES} AS sessions FROM h GROUP BY 1) v "
            f"LEFT JOIN (SELECT site_id, {rnd('sum(amount)', 4)} AS revenue, count(*) AS orders, {SES} AS paying FROM hp WHERE currency = 'EUR' GROUP BY 1) t USING (site_id)",
            PAID,
        ),
        "f40_revenue_by_channel": ev(
            top(
                pay.format(g="ft.g", c="currency", t="hp JOIN best USING (site_id, currency) JOIN ft USING (site_id, session_id)"),
                "revenue DESC, g",
                50,
            ),
            PAID,
            ft,
        ),
        "f40_revenue_by_path": ev(
            top(pay.format(g="path", c="currency", t="(SELECT * FROM hp WHERE currency = 'USD')"), "revenue DESC, g", 50), PAID
        ),
        "f41_revenue_series": ev(
            f"SELECT site_id, currency, {bucket(FULL)} AS bucket, {rnd('sum(amount)', 4)} AS revenue, count(*) AS orders FROM hp "
            "JOIN best USING (site_id, currency) GROUP BY 1, 2, 3",
            PAID,
        ),
        "f42_agent_revenue": ev(
            f"SELECT site_id, currency, {rnd('sum(amount)', 4)} AS revenue, count(*) AS orders FROM paid JOIN best USING (site_id, currency) "
            f"WHERE {AGENT} GROUP BY 1, 2",
            PAID,
        ),
        "f43_revenue_rejected": ev(
            f"SELECT site_id, {js('_revenue_rejected')} AS reason, count(*) AS events FROM win WHERE {js('_revenue_rejected')} IS NOT NULL GROUP BY 1, 2"
        ),
        "f47_geo_coverage": ev(
            f"SELECT site_id, {SES} AS sessions, {counts(chr(99) + 'ountry <> ' + chr(39) * 2)} AS with_country, {counts('region <> ' + chr(39) * 2)} AS with_region, "
            f"{counts('city <> ' + chr(39) * 2)} AS with_city, {counts('lat IS NOT NULL')} AS with_coords FROM h GROUP BY 1"
        ),
        "f48_geo_countries": sessions_by("country", None, "country <> ''"),
        "f48_geo_regions": table({"region": "region"}, {"sessions": SES, "region_name": "max(region_name)"}, "region <> ''", 5000),
        "f49_geo_points": table(
            {"lat": "lat", "lon": "lon"}, {"sessions": SES, "city": "max(city)", "country": "max(country)"}, "lat IS NOT NULL AND lon IS NOT NULL", 5000
        ),
        "f50_geo_sessions": ev(
            top(
                "SELECT site_id, session_id, min(ts) AS started, max(ts) AS ended, count(CASE WHEN type = 'pageview' THEN 1 END) AS pageviews, "
                "count(CASE WHEN type = 'event' THEN 1 END) AS events, "
                + ", ".join(f"max(CASE WHEN a = 1 THEN {c} END) AS {c}" for c in first_cols)
                + ", max(CASE WHEN a = 1 THEN path END) AS entry, max(CASE WHEN z = 1 THEN path END) AS exit FROM (SELECT *, "
                "row_number() OVER (PARTITION BY site_id, session_id ORDER BY ts, ingest_seq) AS a, "
                "row_number() OVER (PARTITION BY site_id, session_id ORDER BY ts DESC, ingest_seq DESC) AS z FROM h) GROUP BY 1, 2",
                "started DESC, session_id",
                5000,
            )
        ),
        "f51_geo_report": ev(
            f"SELECT c.site_id, c.country, c.sessions, coalesce(n.name, c.country) AS country_name, n.lat AS country_lat, n.lon AS country_lon FROM "
            f"(SELECT site_id, country, {SES} AS sessions FROM h WHERE country <> '' GROUP BY 1, 2) c LEFT JOIN (SELECT code, "
            "list_aggregate(list_transform(string_split(lower(n_name), ' '), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ') AS name, lat, lon FROM nation "
            "JOIN (VALUES ('FRANCE', 'FR', 46.0::DOUBLE, 2.0::DOUBLE), ('GERMANY', 'DE', 51.0, 9.0), ('UNITED STATES', 'US', 38.0, -97.0)) k(n_name, code, lat, lon) "
            "USING (n_name)) n ON n.code = c.country"
        ),
    }


# Per pack: the registered query behind each metric, its labels and its measures.
PACKED = {
    "ai_traffic": [
        ("ai.sessions", "e12_ai_sessions", [], ["value"]),
        ("ai.sources", "e13_ai_sources", ["source"], ["sessions"]),
        ("ai.landing_pages", "e14_ai_landing_pages", ["path"], ["sessions"]),
        ("ai.crawler.hits", "e15_ai_crawler_hits", [], ["value"]),
        ("ai.crawler.pages", "e16_ai_crawler_pages", ["path", "bot_name"], ["hits"]),
        ("sessions.total", "e06_sessions_total", [], ["value"]),
    ],
    "web_vitals": [
        ("vitals.p75", "e53_vitals_p75", [], ["lcp", "inp", "cls"]),
        ("vitals.slow_pages", "e54_vitals_slow_pages", ["path"], ["lcp", "samples"]),
    ],
    "errors": [
        ("errors.total", "e55_errors_total", [], ["value"]),
        ("errors.top", "e56_errors_top", ["message", "path"], ["hits", "sessions"]),
        ("errors.browsers", "e58_errors_browsers", ["browser", "os"], ["hits"]),
    ],
}


def pack_oracles(known: dict[str, str]) -> dict[str, str]:
    """The packs as one long table, out of the SQL of their metrics."""
    out = {}
    for name, metrics in PACKED.items():
        parts = []
        for metric, query, labels, measures in metrics:
            key = " || '|' || ".join(f"coalesce({c}, '')" for c in labels) or "''"
            parts += [
                f"SELECT site_id, '{metric}' AS metric, {key} AS dim_key, '{m}' AS measure, CAST({m} AS DOUBLE) AS value FROM ({known[query]})"
                for m in measures
            ]
        out[f"e77_pack_{name}"] = " UNION ALL ".join(parts)
    return out


FROM_BITMAPS = ["e05_visitors_unique", "e06_sessions_total", "e42_bots_suspected", "e44_agent_sessions"]
FROM_COUNTS = ["e53_vitals_p75", "e54_vitals_slow_pages", "f45_vitals_by_path", "f46_vitals_series"]
FROM_LEDGER = (
    "f17_one_and_done f19_plans f23_data_from f24_people f25_people_summary f26_top_actions f27_people_by_plan f28_actions_by_day f28_latest_visits"
).split()


def all_oracles() -> dict[str, str]:
    known = bundle_oracles() | report_oracles()
    # From the ledger of people the same rows must come as from the events.
    known |= {f"{name}_ledger": known[name] for name in FROM_LEDGER}
    # And from day bitmaps.
    known |= {f"{name}_bitmaps": known[name] for name in FROM_BITMAPS}
    # And from stored value counts.
    known |= {f"{name}_counts": known[name] for name in FROM_COUNTS}
    return known | pack_oracles(known)
