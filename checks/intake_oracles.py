"""SQL for the intake, recording, change-line and claim-check queries: what each part of a sample request must become."""

from __future__ import annotations

from checks import sample_requests as sample
from checks.oracles import DAY, EARLY, FULL, HUMAN, LATE, bucket, ev, rnd, scalar_values, top
from checks.sample_requests import choose
from checks.sample_view import COLUMNS_SQL, GAP_MS, MS_DUCKDB, duckdb_view

GAP = 1_800_000
BAD = {
    80: "body_not_object", 81: "site_missing", 82: "site_invalid", 83: "type_invalid", 84: "url_missing", 85: "name_missing",
    86: "name_invalid", 87: "props_not_object", 88: "props_too_many", 89: "prop_type_unsupported", 90: "ago_invalid",
    91: "ago_too_old", 92: "site_unknown",
}
STRICT = "site = 's2'"

# Expected parts of an event, from k.
BOT = choose("k % 8", ["'|'", "'|'", "'ai-crawler|GPTBot'", "'search-crawler|Googlebot'", "'generic|empty user-agent'", "'|'", "'|'", "'|'"])
CLIENT = choose(
    "k % 8",
    [
        "'desktop|macOS|Chrome'", "'mobile|iOS|Safari'", "'bot|unknown|unknown'", "'bot|unknown|unknown'", "'bot|unknown|unknown'",
        "'desktop|Windows|Edge'", "'tablet|Android|Chrome'", "'mobile|iOS|iOS app'",
    ],
)
# A browser is claimed by k % 8 in 0, 1, 5, 6; three of them say they are Chromium.
RULES = (
    "CASE WHEN k % 8 NOT IN (0, 1, 5, 6) THEN '' WHEN k % 5 IN (1, 2, 3) THEN 'no-accept-language,no-fetch-metadata' || "
    "CASE WHEN k % 8 = 1 THEN '' ELSE ',chromium-without-client-hints' END || ',no-accept' "
    "WHEN k % 5 = 0 AND k % 8 IN (5, 6) THEN 'platform-mismatch' WHEN k % 5 = 4 AND k % 8 IN (0, 1, 6) THEN 'platform-mismatch' "
    "WHEN k % 5 = 0 AND k % 8 = 1 THEN '' ELSE '' END"
)
PATH = choose("k % 6", ["'/p/' || cast(k % 5 as string)", "'/pricing'", "'/a%20b'", "'/docs#/guide?x'", "'/'", "'/y'"])
QUERY = choose(
    "k % 6",
    ["''", "'?ref=producthunt'", "'?utm_source=chatgpt.com'", "''", "'?gclid=1'", "'?utm_source=News&utm_medium=email&utm_campaign=c' || cast(k % 3 as string)"],
)
UTM_SOURCE = choose("k % 6", ["''", "'producthunt'", "'chatgpt.com'", "''", "''", "'news'"])
UTM_MEDIUM = choose("k % 6", ["''", "''", "''", "''", "'cpc'", "'email'"])
REF_HOST = choose("k % 7", ["''", "'google.com'", "'chat.openai.com'", "'example.com'", "'blog.acme.dev'", "'t.co'", "'mail.google.com'"])
CHANNEL = """CASE WHEN k % 7 = 3 THEN 'internal||internal' WHEN k % 6 = 2 THEN 'ai|chatgpt|utm_source'
  WHEN k % 7 = 1 THEN CASE WHEN k % 6 = 4 THEN 'paid|google|utm_medium' ELSE 'search|google|referrer' END
  WHEN k % 7 = 5 THEN CASE WHEN k % 6 = 4 THEN 'paid|x|utm_medium' ELSE 'social|x|referrer' END
  WHEN k % 7 = 2 THEN 'ai|chatgpt|referrer' WHEN k % 7 = 6 THEN 'email|gmail|referrer'
  WHEN k % 6 = 4 THEN CASE WHEN k % 7 = 4 THEN 'paid|blog.acme.dev|utm_medium' ELSE 'paid||utm_medium' END
  WHEN k % 6 = 5 THEN 'email|news|utm_medium' WHEN k % 7 = 4 THEN 'referral|blog.acme.dev|referrer'
  WHEN k % 6 = 1 THEN 'referral|producthunt|utm_source' ELSE 'direct||none' END"""
PREFIX = choose(
    "k % 4",
    ["'10.0.0.' || cast(user_id % 200 as string)", "'10.0.0.' || cast(user_id % 200 as string)", "'2a02:e0:73f3:1300::/64'", "'not:an:ip'"],
)
PAID = choose(
    "cast(floor(k / 4) as int) % 6",
    [
        '\'"revenue":12.3457,"currency":"USD",\'', '\'"revenue":7,"currency":"EUR",\'',
        '\'"currency":"EUR","_revenue_rejected":"amount_not_a_number",\'', '\'"currency":"EUR","_revenue_rejected":"amount_negative",\'',
        '\'"_revenue_rejected":"currency_missing",\'', '\'"currency":"euro","_revenue_rejected":"currency_invalid",\'',
    ],
)
EIGHT = ",".join(f'"p{i}":{i}' for i in range(9, 1, -1))
SIGNED = choose(
    "cast(floor(k / 4) as int) % 5",
    [
        '\'"plan":"pro",\'', '\'"_plan_rejected":"plan_not_a_label",\'', '\'"_plan_rejected":"plan_not_a_string",\'',
        '\'"note":"ok","_pii_dropped":2,\'', f"CASE WHEN {STRICT} THEN '{EIGHT},' ELSE '{sample.TEN},' END",
    ],
)
REFERRER = choose(
    "k % 7",
    [
        "''", f"CASE WHEN {STRICT} THEN 'https://www.google.com/search' ELSE 'https://www.google.com/search?q=a' END", "'https://chat.openai.com/c/1'",
        "'https://www.example.com/x'", f"CASE WHEN {STRICT} THEN 'https://blog.acme.dev/p' ELSE 'https://blog.acme.dev/p?x=1' END", "'t.co/abc'",
        "'https://mail.google.com/mail'",
    ],
)


def rq(body: str, *ctes: str) -> str:
    """A query over ``e``: the expected events of the sample requests, and ``bad``: the expected refusals."""
    reasons = " ".join(f"WHEN {k} THEN '{r}'" for k, r in BAD.items())
    q = f"q AS ({sample.duckdb_requests()})"
    judged = f"j AS (SELECT *, coalesce(CASE k {reasons} END, CASE WHEN {STRICT} AND k % 10 = 7 THEN 'do_not_track' END) AS reason FROM q)"
    base = f"""a AS (SELECT *, ts - CASE WHEN k % 9 = 0 THEN 1000 * k ELSE 0 END AS when_ms, {BOT} AS bot, {CLIENT} AS client, {RULES} AS rules,
      {CHANNEL} AS verdict, {PREFIX} AS prefix, CASE WHEN {STRICT} THEN '' ELSE told END AS kept_id FROM j WHERE reason IS NULL)"""
    secret = sample.SECRET
    events = f"""e AS (SELECT request_id AS id, event_id AS ingest_seq, site AS site_id, when_ms AS ts, k,
      substr(sha256(CASE WHEN k % 16 = 5 THEN '{secret}|device|' || strftime(make_timestamp(when_ms * 1000), '%Y-%m-%d') || '|' || site || '|abcdefghijklmnop' || user_id
        ELSE '{secret}|' || strftime(make_timestamp(when_ms * 1000), '%Y-%m-%d') || '|' || site || '|' || prefix || '|' || user_agent END), 1, 32) AS visitor_id,
      CASE WHEN is_event THEN 'event' ELSE 'pageview' END AS type, CASE WHEN is_event THEN called ELSE 'pageview' END AS name,
      {PATH} AS path, {QUERY} AS query, 'T' || (k % 4) AS title, 'example.com' AS hostname, {REFERRER} AS referrer, {REF_HOST} AS referrer_host,
      split_part(verdict, '|', 1) AS channel, split_part(verdict, '|', 2) AS source, split_part(verdict, '|', 3) AS signal,
      {UTM_SOURCE} AS utm_source, {UTM_MEDIUM} AS utm_medium, CASE WHEN k % 6 = 5 THEN 'c' || (k % 3) ELSE '' END AS utm_campaign,
      '' AS utm_term, '' AS utm_content, split_part(client, '|', 1) AS device, split_part(client, '|', 2) AS os, split_part(client, '|', 3) AS browser,
      CASE WHEN {STRICT} THEN '' ELSE '1440x900' END AS screen, 'en-us' AS lang,
      CASE WHEN {STRICT} THEN '' WHEN k % 5 = 2 THEN 'DE' WHEN k % 5 = 3 THEN 'BR' ELSE '' END AS country,
      CASE WHEN k % 5 = 2 AND NOT {STRICT} THEN 'DE-BE' ELSE '' END AS region, CASE WHEN k % 5 = 2 AND NOT {STRICT} THEN 'Berlin' ELSE '' END AS region_name,
      CASE WHEN {STRICT} THEN '' WHEN k % 5 = 2 THEN 'Berlin' WHEN k % 5 = 3 THEN 'São Paulo' ELSE '' END AS city,
      CASE WHEN k % 5 = 2 AND NOT {STRICT} THEN CAST(52.6 AS DOUBLE) END AS lat, CASE WHEN k % 5 = 2 AND NOT {STRICT} THEN CAST(13.4 AS DOUBLE) END AS lon,
      'v2' AS tag,
      CASE WHEN kept_id = '' THEN '' ELSE substr(sha256('{secret}|identity|' || site || '|' || CASE WHEN k % 3 = 2 THEN kept_id ELSE sha256(site || '|' || kept_id) END), 1, 32)
        END AS identity,
      split_part(bot, '|', 1) AS bot_kind, split_part(bot, '|', 2) AS bot_name,
      CASE WHEN k % 25 = 3 THEN 'verified' WHEN k % 25 = 4 THEN 'claimed' WHEN bot <> '|' THEN 'claimed' ELSE 'human' END AS agent_trust,
      CASE WHEN k % 25 = 3 THEN 'https://agent.example' ELSE '' END AS agent_signer, rules AS bot_signals,
      CAST(CASE WHEN rules = '' THEN 0 WHEN rules = 'platform-mismatch' THEN 5 WHEN rules LIKE '%chromium%' THEN 11 ELSE 8 END AS INTEGER) AS bot_score,
      '{{' || CASE WHEN NOT is_event THEN '' WHEN k % 4 = 1 THEN {PAID} ELSE {SIGNED} END || CASE WHEN k % 3 = 1 AND NOT {STRICT} THEN '"_id_raw":true,' ELSE '' END
        || '"_signal":"' || split_part(verdict, '|', 3) || '"}}' AS props
      FROM a)"""
    bad = "bad AS (SELECT request_id, reason FROM j WHERE reason IS NOT NULL)"
    return "WITH " + ",\n".join([q, judged, base, events, bad, *ctes]) + "\n" + body


def grouped(*columns: str) -> str:
    return rq(f"SELECT {', '.join(columns)}, count(*) AS events FROM e GROUP BY ALL")


def js(key: str, props: str = "props") -> str:
    return f"json_extract_string({props}, '$.{key}')"


EVENT_COLUMNS = (
    "id ingest_seq site_id ts visitor_id type name path query title hostname referrer referrer_host channel source utm_source utm_medium utm_campaign "
    "utm_term utm_content device os browser screen lang country region region_name city lat lon tag identity bot_kind bot_name agent_trust agent_signer "
    "bot_signals bot_score props"
).split()
VIEW = COLUMNS_SQL.replace("{MS}", MS_DUCKDB).replace("{EVENTS}", "events") + "select * from c"
PAGE = r"""p AS (SELECT page_id, url, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '^www\.', '') AS host,
  CASE WHEN regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '(.)/$', '\1') = '' THEN '/'
    ELSE regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '(.)/$', '\1') END AS path,
  regexp_extract(url, '(\?[^#]*)', 1) AS query FROM pages),
  pu AS (SELECT *, coalesce(nullif(regexp_extract(query, '[?&]utm_source=([^&]*)', 1), ''), nullif(regexp_extract(query, '[?&]ref=([^&]*)', 1), ''), '') AS src FROM p)"""

# Exported rows of the import queries, with what each must become.
EXPORT = f"""x AS (SELECT *, right(id, 1) AS d FROM ({VIEW})),
  y AS (SELECT *, CASE WHEN d = '7' THEN 'bad_timestamp' WHEN ts >= {LATE[0]} THEN 'overlaps_collected_data' WHEN d = '3' THEN 'missing_id'
    WHEN type = 'event' AND d = '9' THEN 'unknown_event_type' WHEN type = 'event' AND d = '1' THEN 'event_without_name' END AS skip FROM x)"""
IMPORT_CHANNEL = """CASE referrer_host WHEN 'google.com' THEN 'search|google' WHEN 'chatgpt.com' THEN 'ai|chatgpt' WHEN 'reddit.com' THEN 'social|reddit'
  WHEN 'blog.acme.dev' THEN 'referral|blog.acme.dev' WHEN 'mail.google.com' THEN 'email|gmail'
  ELSE CASE WHEN utm_source <> '' THEN 'referral|' || utm_source ELSE 'direct|' END END"""

# Recorded chunks, one row per valid recorded event.
CHUNKS = f"""kk AS (SELECT event_id, cast(replace(replace(props, '{{"k": ', ''), '}}', '') as int) AS k FROM events),
  cb AS (SELECT c.*, kk.k, {sample.CHUNK_BODY} AS body FROM ({VIEW}) c JOIN kk ON kk.event_id = c.ingest_seq),
  ce AS (SELECT site_id, visitor_id, ingest_seq AS seq, ts, country, length(body) AS bytes, i - 1 AS pos, json_extract(body, '$[' || (i - 1) || ']') AS e
    FROM cb, unnest(range(1, CAST(json_array_length(body) AS BIGINT) + 1)) u(i)),
  re AS (SELECT * EXCLUDE (e), CAST(json_extract_string(e, '$[0]') AS BIGINT) AS t, CAST(json_extract_string(e, '$[1]') AS INTEGER) AS type,
    json_extract_string(e, '$[2]') AS a0, json_extract_string(e, '$[3]') AS a1, json_extract_string(e, '$[4]') AS a2, json_extract_string(e, '$[5]') AS a3
    FROM ce WHERE CAST(json_extract_string(e, '$[1]') AS INTEGER) < 10)"""
# Chunks of one visitor never follow each other for longer than the limit here only if no run is longer: runs are walked one by one below.
WALK = f"""ch AS (SELECT site_id, visitor_id, seq, ts, country, max(t) AS t_last, count(*) AS events,
    count(CASE WHEN type IN (0, 7) THEN 1 END) AS pages, count(CASE WHEN type = 3 THEN 1 END) AS clicks, count(CASE WHEN type = 6 THEN 1 END) AS inputs,
    count(CASE WHEN type = 8 THEN 1 END) AS errors, count(CASE WHEN type = 9 THEN 1 END) AS gaps,
    max(CASE WHEN type = 0 THEN a3 END) AS entry, max(CASE WHEN type = 0 THEN a1 || 'x' || a2 END) AS vp FROM re GROUP BY ALL),
  num AS (SELECT *, row_number() OVER (PARTITION BY site_id, visitor_id ORDER BY ts, seq) AS n FROM ch),
  walk AS (
    SELECT site_id, visitor_id, seq, n, ts, ts AS since, ts - least(t_last, 1800000) AS started, ts AS until, true AS taken FROM num WHERE n = 1
    UNION ALL
    SELECT c.site_id, c.visitor_id, c.seq, c.n, c.ts,
      CASE WHEN c.ts - w.until > {GAP} THEN c.ts ELSE w.since END,
      CASE WHEN c.ts - w.until > {GAP} THEN c.ts - least(c.t_last, 1800000) ELSE w.started END,
      CASE WHEN c.ts - w.until > {GAP} OR c.ts - w.started <= 1800000 THEN c.ts ELSE w.until END,
      c.ts - w.until > {GAP} OR c.ts - w.started <= 1800000
    FROM walk w JOIN num c ON c.site_id = w.site_id AND c.visitor_id = w.visitor_id AND c.n = w.n + 1),
  rc AS (SELECT c.*, w.since, w.started FROM num c JOIN walk w USING (site_id, visitor_id, n) WHERE w.taken),
  vw AS ({duckdb_view()}),
  lk AS (SELECT rc.site_id, rc.visitor_id, rc.n, arg_max(v.session_id, v.ts) AS session_id FROM rc JOIN vw v ON v.site_id = rc.site_id AND v.visitor_id = rc.visitor_id
    AND v.ts <= rc.ts AND v.ts >= rc.ts - {GAP} GROUP BY ALL),
  rec AS (SELECT rc.site_id, rc.visitor_id, since, min(started) AS started_at, max(rc.ts) AS last_at, count(*) AS chunks, CAST(sum(events) AS BIGINT) AS events,
    CAST(sum(pages) AS BIGINT) AS pages, CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(inputs) AS BIGINT) AS inputs, CAST(sum(errors) AS BIGINT) AS errors,
    CAST(sum(gaps) AS BIGINT) AS gaps, coalesce(arg_min(coalesce(entry, ''), rc.n), '') AS entry_path, coalesce(arg_min(coalesce(vp, ''), rc.n), '') AS viewport,
    arg_min(country, rc.n) AS country, 'desktop' AS device, coalesce(arg_min(lk.session_id, rc.n), '') AS session_id
    FROM rc LEFT JOIN lk ON lk.site_id = rc.site_id AND lk.visitor_id = rc.visitor_id AND lk.n = rc.n GROUP BY 1, 2, 3)"""
RETENTION = "CAST(CASE site_id WHEN 's0' THEN 15 ELSE 30 END AS BIGINT)"
# The rows of a site's day as one visitor's, in half the time.
CLOSER = f"""SELECT * REPLACE ('day-' || CAST(floor(ts / {DAY}) AS BIGINT) AS visitor_id,
  CAST(floor(ts / {DAY}) AS BIGINT) * {DAY} + (ts % {DAY}) // 2 AS ts) FROM"""
CLOSE = ",\n".join([CHUNKS.replace(f"({VIEW}) c JOIN", f"({CLOSER} ({VIEW})) c JOIN"), WALK.replace("vw AS (", f"vw AS ({CLOSER} (").replace("),\n  lk AS", ")),\n  lk AS")]) + """,
  rr AS (SELECT re.*, started, substr(sha256('replay|' || site_id || '|' || visitor_id || '|' || since), 1, 32) AS replay_id
    FROM re JOIN (SELECT site_id, visitor_id, seq, since, started FROM rc) USING (site_id, visitor_id, seq))"""
# The page view, viewport and scroll in force at each recorded event of a recording.
VIEWS = """st AS (SELECT *, last_value(CASE WHEN type = 0 THEN CAST(a1 AS DOUBLE) WHEN type = 5 AND a0 <> '0' THEN CAST(a0 AS DOUBLE) END IGNORE NULLS) OVER o AS vw0,
    last_value(CASE WHEN type = 0 THEN CAST(a2 AS DOUBLE) WHEN type = 5 AND a1 <> '0' THEN CAST(a1 AS DOUBLE) END IGNORE NULLS) OVER o AS vh0,
    last_value(CASE WHEN type = 0 THEN 0.0 WHEN type = 4 AND a0 = '0' THEN CAST(a1 AS DOUBLE) END IGNORE NULLS) OVER o AS sx0,
    last_value(CASE WHEN type IN (0, 7) THEN 0.0 WHEN type = 4 AND a0 = '0' THEN CAST(a2 AS DOUBLE) END IGNORE NULLS) OVER o AS sy0,
    sum(CASE WHEN type IN (0, 7) THEN 1 ELSE 0 END) OVER o AS view FROM rr
    WINDOW o AS (PARTITION BY site_id, replay_id ORDER BY seq, pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
  s2 AS (SELECT *, coalesce(vw0, 0) AS w, coalesce(vh0, 0) AS vh, coalesce(sx0, 0) AS sx, coalesce(sy0, 0) AS sy FROM st),
  op AS (SELECT site_id, replay_id, view, CASE WHEN type = 0 THEN a3 ELSE a0 END AS path, w AS width, vh AS height, type = 7 AS spa,
    CASE WHEN type = 0 THEN a0 END AS snap, started AS at FROM s2 WHERE type IN (0, 7)),
  sn AS (SELECT site_id, replay_id, view, max(sy + vh) AS seen FROM s2 WHERE type = 4 AND a0 = '0' GROUP BY 1, 2, 3),
  pv AS (SELECT op.*, greatest(height, coalesce(seen, 0)) AS bottom, CASE WHEN width >= 1024 THEN 'desktop' WHEN width >= 640 THEN 'tablet' ELSE 'mobile' END AS device
    FROM op LEFT JOIN sn USING (site_id, replay_id, view) WHERE width > 0)"""
CLOCK = """cl AS (SELECT site_id, replay_id, min(ts - hi) AS off, min(lo) AS lo, max(hi) AS hi FROM (SELECT site_id, replay_id, seq, ts, max(t) AS hi, min(t) AS lo
    FROM rr GROUP BY 1, 2, 3, 4) GROUP BY 1, 2)"""


def change_lines() -> str:
    table = (
        f"t AS (SELECT c.site_id, c.metric, c.value, coalesce(p.value, 0.0) AS previous, CASE WHEN coalesce(p.value, 0.0) <> 0 THEN "
        f"{rnd('(c.value - p.value) / p.value * 100', 1)} END AS delta FROM ({scalar_values(LATE)}) c LEFT JOIN ({scalar_values(EARLY)}) p USING (site_id, metric))"
    )
    none = "CAST(NULL AS DOUBLE)"

    def value(metric: str) -> str:
        return f"(SELECT value FROM t x WHERE x.site_id = t.site_id AND x.metric = '{metric}')"

    def rows(kind, metric, value_sql, detail="''", where="true", src="w", previous=none, delta=none):
        return (
            f"SELECT site_id, '{kind}' AS kind, {metric} AS metric, {detail} AS detail, CAST({value_sql} AS DOUBLE) AS value, {previous} AS previous, "
            f"{delta} AS delta_pct FROM {src} WHERE {where}"
        )

    def leader(name, col, measure, where, who=HUMAN):
        inner = f"SELECT site_id, {col} AS d, {measure} AS v FROM win WHERE {who} AND {where} GROUP BY ALL"
        return f"{name} AS ({top(inner, 'v DESC, d', 1)})"

    wide = (
        "w AS (SELECT DISTINCT t.site_id, "
        + ", ".join(
            f"{value(m)} AS {m.replace('.', '_')}"
            for m in ("ai.sessions", "ai.crawler.hits", "sessions.total", "cta.conversion", "signups.total", "rage.clicks", "bounce.rate")
        )
        + ", s.d AS ai_source, c.d AS crawler_page, f.d AS field, f.v AS abandons FROM t LEFT JOIN l_s s USING (site_id) LEFT JOIN l_c c USING (site_id) "
        "LEFT JOIN l_f f USING (site_id))"
    )
    counted = "metric NOT IN ('bounce.rate','visit.duration','views.per_session','cta.conversion','scroll.depth')"
    first = "metric = 'visitors.unique' AND previous >= 20"
    series = (
        f"ts AS (SELECT s.site_id, b.range AS bucket, {LATE[0]} + b.range * {DAY} AS start_ms, coalesce(q.views, 0) AS views FROM (SELECT DISTINCT site_id FROM h) s "
        f"CROSS JOIN range(15) b LEFT JOIN (SELECT site_id, {bucket(LATE)} AS bucket, count(CASE WHEN type = 'pageview' THEN 1 END) AS views FROM h GROUP BY 1, 2) q "
        "ON q.site_id = s.site_id AND q.bucket = b.range), "
        "pk AS (SELECT site_id, max(views) AS peak, avg(views) AS mean, min(CASE WHEN r = 1 THEN start_ms END) AS start_ms FROM (SELECT *, row_number() OVER "
        "(PARTITION BY site_id ORDER BY views DESC, bucket) AS r FROM ts) GROUP BY 1)"
    )
    parts = [
        rows("headline", "metric", "value", where="metric IN ('visitors.unique','sessions.total','pageviews.total')", src="t",
             previous=f"CASE WHEN {first} THEN previous END", delta=f"CASE WHEN {first} THEN delta END"),
        rows("change", "metric", "value", where=f"metric <> 'visitors.unique' AND abs(delta) >= 15 AND (NOT ({counted}) OR previous >= 20)", src="t",
             previous="previous", delta="delta"),
        rows("peak", "'timeseries'", "peak", "CAST(start_ms AS VARCHAR)", "peak > 0 AND peak >= mean * 1.5", "pk", previous="mean"),
        rows("ai", "'ai.sessions'", "ai_sessions", "ai_source", "ai_sessions > 0", delta="ai_sessions / sessions_total * 100"),
        rows("ai", "'ai.crawler.hits'", "ai_crawler_hits", "crawler_page", "ai_crawler_hits > 0"),
        rows("funnel", "'cta.conversion'", "cta_conversion"),
        rows("funnel", "'signups.total'", "signups_total"),
        rows("funnel", "'form.abandon_fields'", "abandons", "field", "abandons > 0"),
        rows("quality", "'rage.clicks'", "rage_clicks", where="rage_clicks > 0"),
        rows("action", "'bounce.rate'", "bounce_rate", where="bounce_rate >= 70"),
        rows("action", "'cta.conversion'", "cta_conversion", where="cta_conversion < 5"),
        rows("action", "'form.abandon_fields'", "abandons", "field", "abandons IS NOT NULL"),
        rows("action", "'ai.crawler.hits'", "ai_crawler_hits", where="ai_crawler_hits > 0 AND ai_sessions = 0"),
    ]
    return ev(
        " UNION ALL ".join(parts),
        table,
        leader("l_s", "source", "count(DISTINCT session_id)", "channel = 'ai'"),
        "l_c AS (SELECT site_id, arg_min(path, rk) AS d FROM (SELECT site_id, path, row_number() OVER (PARTITION BY site_id ORDER BY v DESC, path, bot_name) AS rk "
        "FROM (SELECT site_id, path, bot_name, count(*) AS v FROM win WHERE bot_kind = 'ai-crawler' GROUP BY ALL)) GROUP BY 1)",
        leader("l_f", js("field"), "count(*)", "name = 'form_abandon'"),
        wide,
        series,
        w=LATE,
    )


CLAIMS = r"""sp AS (SELECT doc_id, source, unnest(regexp_split_to_array(regexp_replace(text, '([.!?…])\s+', '\1' || chr(10), 'g'), '\n+')) AS raw FROM documents),
  se AS (SELECT doc_id, source, row_number() OVER () AS sid, trim(raw, ' ' || chr(9) || chr(13)) AS s FROM sp WHERE trim(raw, ' ' || chr(9) || chr(13)) <> ''),
  cl AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '(?i)\[(?:e\d+(?:\s*,\s*e\d+)*)\]', ' ', 'g'),
    '\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2})?)?', ' ', 'g'), '\b\d{1,2}:\d{2}\b', ' ', 'g'), '(?:https?://)?/[^\s"''<>,;]*', ' ', 'g') AS c FROM se),
  tk AS (SELECT doc_id, source, sid, s, unnest(regexp_extract_all(c, '(?:^|[^\p{L}\d_-])([+-]?\d[\d.,]*)', 1)) AS t FROM cl),
  nm AS (SELECT doc_id, source, sid, s, regexp_replace(t, '[.,]+$', '') AS raw FROM tk),
  nb AS (SELECT *, CASE WHEN raw LIKE '-%' THEN -1.0 ELSE 1.0 END AS sg, regexp_replace(raw, '^[+-]', '') AS b FROM nm),
  nv AS (SELECT *, TRY_CAST(replace(replace(b, '.', ''), ',', '') AS DOUBLE) AS grp,
    TRY_CAST(CASE WHEN b LIKE '%.%' AND b LIKE '%,%' THEN CASE WHEN regexp_matches(b, ',[^.]*$') THEN replace(replace(b, '.', ''), ',', '.') ELSE replace(b, ',', '') END
      ELSE replace(b, ',', '.') END AS DOUBLE) AS dc, (b LIKE '%.%') <> (b LIKE '%,%') AS single, length(regexp_extract(b, '[.,](\d*)$', 1)) AS after FROM nb),
  ok AS (SELECT DISTINCT source, CAST(n_chars AS DOUBLE) AS v FROM documents),
  bad AS (SELECT * FROM nv WHERE (dc IS NOT NULL OR (single AND after = 3)) AND NOT (dc IS NOT NULL AND (sg * dc IN (0, 100) OR EXISTS (SELECT 1 FROM ok WHERE ok.source = nv.source
    AND ok.v = sg * dc))) AND NOT (single AND after = 3 AND grp IS NOT NULL AND (sg * grp IN (0, 100) OR EXISTS (SELECT 1 FROM ok WHERE ok.source = nv.source AND ok.v = sg * grp)))),
  ctx AS (SELECT doc_id, sid, regexp_matches(lower(s), 'commit|deploy|theme|release|version|rollout') AND
    regexp_matches(lower(s), 'caused|causes|led to|resulted in|broke|due to|because of|thanks to|responsible for') AS causal FROM se)"""


def intake_oracles() -> dict[str, str]:
    heat_click = (
        "hc AS (SELECT pv.site_id, pv.device, pv.path, (CAST(s2.a1 AS DOUBLE) + sx) / w AS x, CAST(s2.a2 AS DOUBLE) + sy AS y FROM s2 JOIN pv USING (site_id, replay_id, view) "
        "WHERE s2.type = 3 AND s2.view > 0 AND s2.w > 0)"
    )
    cell_x = "floor(least(1.0, x) / CAST(0.004 AS DOUBLE) + 0.5) * CAST(0.004 AS DOUBLE)"

    def rec(body: str, *more: str) -> str:
        return "WITH RECURSIVE " + ",\n".join([CHUNKS, WALK, *more]) + "\n" + body

    def chunk(body: str, *more: str) -> str:
        return "WITH RECURSIVE " + ",\n".join([CLOSE, *more]) + "\n" + body

    def view(body: str, *more: str) -> str:
        return "WITH " + ",\n".join([f"v AS ({VIEW})", *more]) + "\n" + body

    lead = f"""g AS (SELECT *, CASE WHEN lag(ts) OVER o IS NULL OR ts - lag(ts) OVER o > {GAP} THEN 1 ELSE 0 END AS nw FROM {{src}}
      WINDOW o AS (PARTITION BY site_id, visitor_id ORDER BY ts, ingest_seq)),
      n AS (SELECT *, CAST(sum(nw) OVER (PARTITION BY site_id, visitor_id ORDER BY ts, ingest_seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_no FROM g),
      z AS (SELECT *, min(ts) OVER (PARTITION BY site_id, visitor_id, session_no) AS session_start FROM n)"""
    names = (
        "(['Amber','Azure','Brisk','Calm','Coral','Crimson','Dusky','Eager','Fleet','Gentle','Golden','Hazel','Indigo','Jade','Keen','Lively','Lunar','Mellow',"
        "'Misty','Noble','Olive','Pale','Quiet','Rapid','Rustic','Sable','Silver','Sunny','Tidal','Umber','Velvet','Wild'])"
        "[CAST(('0x' || substr(visitor_id, 1, 4))::BIGINT % 32 AS INTEGER) + 1] || ' ' || "
        "(['Albatross','Badger','Beaver','Bison','Crane','Dolphin','Falcon','Ferret','Finch','Fox','Gecko','Heron','Ibex','Jackal','Koala','Lemur','Lynx','Marten',"
        "'Moose','Newt','Ocelot','Otter','Owl','Panda','Puffin','Quail','Raven','Seal','Stoat','Tapir','Walrus','Wren'])"
        "[CAST(('0x' || substr(visitor_id, 5, 4))::BIGINT % 32 AS INTEGER) + 1]"
    )
    batch_key = "json_extract_string(body, '$.site')"
    return {
        "a01_scan": ev("SELECT site_id, strftime(make_timestamp(ts * 1000), '%Y-%m-%d') AS day, count(*) AS events FROM win GROUP BY 1, 2", w=LATE),
        "a02_idempotent_append": view(f"SELECT site_id, count(*) AS added, min(ts) AS from_ts FROM v WHERE ts >= {LATE[0]} GROUP BY 1"),
        "a03_request_bodies": rq(
            "SELECT CASE WHEN k = 92 THEN 'nowhere' ELSE site END AS site_id, CASE WHEN is_event AND k <> 92 THEN 'event' ELSE 'pageview' END AS type, "
            "CASE WHEN k = 92 THEN '' ELSE 'en-us' END AS lang, CASE WHEN k = 92 THEN '' ELSE 'example.com' END AS hostname, count(*) AS requests "
            "FROM j WHERE k NOT BETWEEN 80 AND 91 GROUP BY ALL"
        ),
        "a04_batches": rq(
            "SELECT 'opened' AS outcome, CAST(coalesce(sum(n) FILTER (why IS NULL), 0) AS BIGINT) AS requests FROM b UNION ALL "
            "SELECT why, count(*) FROM b WHERE why IS NOT NULL GROUP BY 1",
            f"b AS (SELECT coalesce({batch_key}, 'none') AS s, CASE WHEN (event_id // 600) % 20 = 0 THEN event_id // 600 ELSE 1000000000 + event_id // 60 END AS run, count(*) AS n, CASE WHEN count(*) > 50 THEN 'batch_too_large' "
            f"WHEN coalesce({batch_key}, 'none') = 'none' THEN 'site_missing' END AS why FROM q WHERE k <> 80 GROUP BY 1, 2)",
        ),
        "a05_import_summary": "WITH " + EXPORT + f"""
            SELECT outcome, CAST(sum(n) AS BIGINT) AS rows, min(CASE WHEN outcome = 'imported' THEN ts END) AS from_ts, max(CASE WHEN outcome = 'imported' THEN ts END) AS to_ts
            FROM (SELECT coalesce(skip, CASE WHEN ts < {FULL[0] + DAY} THEN 'already_imported' ELSE 'imported' END) AS outcome, 1 AS n, ts FROM y) GROUP BY 1""",
        "a05_imported_events": "WITH " + EXPORT + f"""
            SELECT split_part({IMPORT_CHANNEL}, '|', 1) AS channel, split_part({IMPORT_CHANNEL}, '|', 2) AS source,
              CASE browser WHEN 'iOS app' THEN 'Ios app' WHEN 'Android app' THEN 'Android app' ELSE browser END AS browser, os, device, region, count(*) AS events,
              count(DISTINCT visitor_id) AS visitors, count(DISTINCT visitor_id) AS sessions FROM y WHERE skip IS NULL GROUP BY ALL""",
        "a02_earliest": view("SELECT site_id, path, count(*) AS added, CAST(sum(ingest_seq) AS BIGINT) AS arrivals FROM v GROUP BY 1, 2"),
        "a02_appended_table": view("SELECT site_id, count(*) AS events, min(ts) AS from_ts, max(ts) AS to_ts FROM v GROUP BY 1"),
        "a06_removed_table": view("SELECT site_id, count(*) AS events FROM v WHERE NOT (site_id = 's0' AND device = 'desktop') GROUP BY 1"),
        "a09_refused_chunks": view(
            "SELECT site_id, CASE WHEN ingest_seq % 50 = 1 THEN 'invalid_chunk_address' WHEN ingest_seq % 2000 = 4 THEN 'chunk_too_large' WHEN ingest_seq % 50 = 2 "
            "THEN 'chunk_undecodable_or_too_large' ELSE 'invalid_chunk' END AS refused, count(*) AS chunks FROM v WHERE ingest_seq % 50 BETWEEN 1 AND 3 "
            "OR ingest_seq % 2000 = 4 GROUP BY 1, 2"
        ),
        "c01_sessions_across_runs": view("SELECT site_id, count(*) AS events, 1 AS visits_per_id FROM v GROUP BY 1"),
        "a05_split_csv": "SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, sha256(regexp_replace(text, '\\r\\n?', chr(10), 'g')) AS text_sha256 FROM documents",
        "a06_remove_import": view("SELECT site_id, count(*) AS events FROM v WHERE NOT (site_id = 's0' AND device = 'desktop') GROUP BY 1"),
        "a08_backfill": view(
            "SELECT site_id, '' AS bot_kind, 'human' AS agent_trust, '' AS agent_signer, CAST(0 AS INTEGER) AS bot_score, '' AS tag, count(*) AS events, "
            "CAST(0 AS BIGINT) AS lats FROM v GROUP BY 1"
        ),
        "a09_replay_landing": chunk(
            "SELECT type, count(*) AS events, CAST(sum(pos) AS BIGINT) AS positions, CAST(sum(CASE type WHEN 0 THEN 4 WHEN 3 THEN 3 WHEN 4 THEN 3 WHEN 5 THEN 2 WHEN 6 THEN 2 "
            "ELSE 1 END) AS BIGINT) AS arguments FROM re GROUP BY 1"
        ),
        "a10_replay_purge": rec(f"SELECT site_id, count(*) AS kept FROM rec WHERE started_at >= {FULL[1]} - {RETENTION} * {DAY} GROUP BY 1"),
        "a10_purged_store": rec(
            f"""SELECT site_id, CAST(sum(events) AS BIGINT) AS rows, count(*) AS chunks, count(DISTINCT ts // {DAY}) AS days, min(day) AS first_day
            FROM (SELECT num.site_id, num.events, num.ts, CAST(make_timestamp(num.ts * 1000) AS DATE) AS day, rec.started_at
              FROM num LEFT JOIN rc USING (site_id, visitor_id, n) LEFT JOIN rec ON rec.site_id = rc.site_id AND rec.visitor_id = rc.visitor_id AND rec.since = rc.since)
            WHERE least(ts, coalesce(started_at, ts)) >= {FULL[1]} - {RETENTION} * {DAY} GROUP BY 1"""
        ),
        "b01_rejected_rows": rq("SELECT request_id, reason AS reject_reason FROM bad"),
        "b03_revenue": rq(
            f"SELECT {js('_revenue_rejected')} AS reason, {js('currency')} AS currency, CAST({js('revenue')} AS DOUBLE) AS revenue, count(*) AS events FROM e "
            "WHERE name = 'purchase' GROUP BY ALL"
        ),
        "b05_strict_policy": rq(
            "SELECT site_id, count(CASE WHEN identity <> '' THEN 1 END) AS identified, count(CASE WHEN screen <> '' THEN 1 END) AS screens, "
            "count(CASE WHEN country <> '' THEN 1 END) AS placed, count(CASE WHEN referrer LIKE '%?%' THEN 1 END) AS referrer_queries FROM e GROUP BY 1"
        ),
        "b06_personal_words": r"""SELECT doc_id, count(*) AS personal FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\s+')) AS w FROM documents)
            WHERE regexp_matches(w, '^[^\s@]{1,64}@[^\s@]{1,255}\.[A-Za-z]{2,}$') OR (regexp_matches(w, '^\+[\d\s().-]{8,22}$')
              AND length(regexp_replace(w, '\D', '', 'g')) BETWEEN 8 AND 15) GROUP BY 1""",
        "b07_plans": rq(
            f"SELECT {js('plan')} AS plan, {js('_plan_rejected')} AS reason, {js('_pii_dropped')} AS dropped, count(*) AS events FROM e WHERE name = 'signup' GROUP BY ALL"
        ),
        "b08_bots": grouped("bot_kind", "bot_name"),
        "b09_clients": grouped("device", "os", "browser"),
        "b10_signals": grouped("bot_signals", "bot_score"),
        "b11_page_urls": f"WITH {PAGE} SELECT page_id, path, query, host FROM p",
        "b11_request_urls": grouped("path", "query"),
        "b12_page_campaigns": f"WITH {PAGE} SELECT page_id, lower(src) AS utm_source, '' AS utm_medium, host AS referrer_host FROM pu",
        "b12_request_campaigns": grouped("utm_source", "utm_medium", "utm_campaign"),
        "b14_page_channels": f"WITH {PAGE} SELECT page_id, 'referral' AS channel, host AS source, 'referrer' AS signal FROM pu",
        "b14_request_channels": grouped("channel", "source", "referrer_host", "signal"),
        "b16_places": grouped("site_id", "country", "region", "region_name", "city", "lat", "lon"),
        "b17_ip_prefixes": rq(f"SELECT {PREFIX} AS prefix, count(*) AS requests FROM q GROUP BY 1"),
        "b18_ids": rq("SELECT id, ts, visitor_id, identity FROM e"),
        "b22_trust": grouped("bot_kind", "agent_trust", "agent_signer"),
        "b23_event_rows": rq(f"SELECT {', '.join(EVENT_COLUMNS)} FROM e"),
        "b24_reject_reasons": rq("SELECT reason AS reject_reason, count(*) AS requests FROM bad GROUP BY 1"),
        "b25_quality": rq(
            "SELECT count(*) AS cases, count(CASE WHEN ok THEN 1 END) AS correct, count(CASE WHEN ok THEN 1 END) / count(*) AS accuracy, "
            "count(CASE WHEN said AND wanted THEN 1 END) / count(CASE WHEN said THEN 1 END) AS \"precision\", "
            "count(CASE WHEN said AND wanted THEN 1 END) / count(CASE WHEN wanted THEN 1 END) AS recall FROM (SELECT e.channel = l.want_channel AND e.source = l.want_source "
            "AND e.bot_kind = l.want_bot AS ok, e.channel = 'ai' AS said, l.want_channel = 'ai' AS wanted FROM e JOIN l USING (id))",
            f"l AS ({sample.LABELS_SQL.replace('{EVENTS}', 'events')})",
        ),
        "c01_sessions": view("SELECT id, session_start, session_no FROM z", lead.format(src="v")),
        "c01_ingested_sessions": rq(
            "SELECT id, substr(sha256(site_id || '|' || visitor_id || '|' || session_start), 1, 32) AS session_id FROM z", lead.format(src="e")
        ),
        "c02_stream_sessions": view(
            "SELECT site_id, substr(sha256(site_id || '|' || visitor_id || '|' || session_start), 1, 32) AS session_id, min(ts) AS started, max(ts) AS ended, "
            "count(*) AS events FROM z GROUP BY ALL",
            lead.format(src="v").replace(f"> {GAP} ", f"> {GAP_MS} "),
        ),
        "c07_stream_visitors": view(
            f"""SELECT site_id, (ts // 60000 - b.range) * 60000 AS start, count(DISTINCT visitor_id) AS visitors FROM d, range(5) b GROUP BY ALL""",
            f"""d AS (SELECT site_id, ingest_seq % 20 AS visitor_id, CAST(floor(ts / {DAY}) AS BIGINT) * {DAY} + (ts % {DAY}) // 10 AS ts FROM v WHERE {HUMAN})""",
        ),
        "c04_recordings": rec(
            "SELECT site_id, visitor_id, started_at, last_at, chunks, events, pages, clicks, inputs, errors, gaps, entry_path, viewport, country, device, session_id FROM rec"
        ),
        "c04_dense_recordings": view(
            f"""SELECT site_id, visitor_id, since AS recording_from, started AS started_at, CAST(sum(chunks) AS BIGINT) AS chunks, max(tm) AS last_at
            FROM walk WHERE taken GROUP BY ALL""",
            f"""c AS (SELECT site_id, 'day-' || CAST(floor(ts / {DAY}) AS BIGINT) AS visitor_id, lpad(id, 9, '0') AS page_load,
              CAST(floor(ts / {DAY}) AS BIGINT) * {DAY} + (ts % {DAY}) // 2 AS tm, ingest_seq * 7919 % 60000 AS t_last,
              CASE WHEN site_id = 's1' THEN 600000 ELSE 1800000 END AS cap FROM v)""",
            "a AS (SELECT site_id, visitor_id, tm, cap, tm - arg_min(t_last, page_load) AS started, count(*) AS chunks FROM c GROUP BY 1, 2, 3, 4)",
            "o AS (SELECT *, row_number() OVER (PARTITION BY site_id, visitor_id ORDER BY tm) AS rn FROM a)",
            f"""walk AS (
              SELECT site_id, visitor_id, rn, tm, chunks, tm AS since, started, tm AS until_, true AS taken FROM o WHERE rn = 1
              UNION ALL
              SELECT o.site_id, o.visitor_id, o.rn, o.tm, o.chunks, CASE WHEN o.tm - w.until_ > {GAP} THEN o.tm ELSE w.since END,
                CASE WHEN o.tm - w.until_ > {GAP} THEN o.started ELSE w.started END,
                CASE WHEN o.tm - w.until_ > {GAP} OR o.tm - w.started <= o.cap THEN o.tm ELSE w.until_ END,
                o.tm - w.until_ > {GAP} OR o.tm - w.started <= o.cap
              FROM walk w JOIN o ON o.site_id = w.site_id AND o.visitor_id = w.visitor_id AND o.rn = w.rn + 1)""",
        ).replace("WITH ", "WITH RECURSIVE ", 1),
        "c05_recording_selection": view(
            "SELECT site_id, reason = '' AS record, reason, count(*) AS requests FROM (SELECT *, CASE WHEN site_id = 's2' THEN 'strict_privacy_mode' WHEN tag <> 'v2' THEN "
            "'do_not_track' WHEN site_id = 's1' AND ('0x' || substr(visitor_id, 1, 8))::BIGINT / 4294967296.0 >= 0.5 THEN 'not_sampled' ELSE '' END AS reason FROM v) GROUP BY ALL"
        ),
        "e79_change_lines": change_lines(),
        "e80_claim_check": f"""WITH {CLAIMS} SELECT ctx.doc_id, coalesce(x.numbers, '') AS numbers, causal FROM ctx LEFT JOIN (SELECT sid,
            string_agg(raw, ', ' ORDER BY raw) AS numbers FROM (SELECT DISTINCT sid, raw FROM bad) GROUP BY 1) x USING (sid) WHERE causal OR x.numbers IS NOT NULL""",
        "e80_sentences": f"WITH {CLAIMS} SELECT doc_id, count(*) AS sentences FROM se GROUP BY 1",
        "f52_heatmap_points": chunk(
            top(
                f"SELECT site_id, device, path, floor({cell_x} * 1000 + 0.5) / 1000 AS x, CAST(floor(y / 8 + 0.5) * 8 AS BIGINT) AS y, count(*) AS clicks FROM hc "
                "WHERE x >= 0 AND x <= 1.05 AND y >= 0 GROUP BY 1, 2, 3, 4, 5",
                "clicks DESC, x, y",
                8000,
                "site_id, device, path",
            ),
            VIEWS,
            heat_click,
        ),
        "f53_scroll_reach": chunk(
            "SELECT site_id, device, path, b.range AS bin, count(CASE WHEN bottom >= b.range * 100 THEN 1 END) AS views FROM (SELECT *, ceil(max(bottom) OVER "
            "(PARTITION BY site_id, device, path) / 100) AS bins FROM pv) JOIN range(10000) b ON b.range < bins GROUP BY 1, 2, 3, 4",
            VIEWS,
        ),
        "f54_heatmap_pages": chunk(
            top(
                "SELECT site_id, device, path, count(*) AS views, count(CASE WHEN spa THEN 1 END) AS spa_views FROM pv GROUP BY 1, 2, 3",
                "views DESC, path",
                100,
                "site_id, device",
            ),
            VIEWS,
        ),
        "f54_snapshots": chunk(
            "SELECT site_id, device, path, arg_max(snap, (\"at\", replay_id, view)) AS snap, max(\"at\") AS \"at\" FROM pv WHERE snap IS NOT NULL GROUP BY 1, 2, 3", VIEWS
        ),
        "f55_replay_list": rec(
            top(
                f"SELECT site_id, visitor_id, {names} AS name, started_at, errors FROM rec WHERE started_at >= {FULL[0]} AND started_at < {FULL[1]} "
                f"AND started_at >= {FULL[1]} - {RETENTION} * {DAY} AND pages >= 1 AND errors > 0",
                "started_at DESC",
                200,
            )
        ),
        "f55_replay_total": rec(
            f"SELECT site_id, count(*) AS total FROM rec WHERE started_at >= {FULL[0]} AND started_at < {FULL[1]} "
            f"AND started_at >= {FULL[1]} - {RETENTION} * {DAY} AND pages >= 1 AND errors > 0 GROUP BY 1"
        ),
        "f54_truncation": rec("SELECT site_id, least(count(*), 300) AS recordings, count(*) > 300 AS truncated FROM rec GROUP BY 1"),
        "f56_playback": chunk(
            "SELECT site_id, replay_id, CAST(seq AS INTEGER) AS seq, CAST(pos AS INTEGER) AS pos, t - lo AS at, type FROM rr JOIN cl USING (site_id, replay_id)",
            CLOCK,
        ),
        "f57_markers": chunk(
            "SELECT m.site_id, m.replay_id, greatest(0, v.ts - (cl.off + cl.lo)) AS t, CASE WHEN v.type = 'pageview' THEN 'pageview' WHEN v.name = 'error' "
            "THEN 'error' ELSE 'event' END AS kind, CASE WHEN v.type = 'pageview' THEN v.path ELSE v.name || ' · ' || v.path END AS label FROM m JOIN cl USING (site_id, replay_id) "
            "JOIN vw v ON v.site_id = m.site_id AND v.session_id = m.session_id AND v.ts >= cl.off + cl.lo - 5000 AND v.ts <= cl.off + cl.hi + 5000 "
            "WHERE v.name NOT IN ('web_vitals', 'scroll')",
            CLOCK,
            "m AS (SELECT DISTINCT site_id, replay_id, session_id FROM rec JOIN (SELECT DISTINCT site_id, visitor_id, seq, replay_id FROM rr) USING (site_id, visitor_id) "
            "JOIN (SELECT site_id, visitor_id, seq, since FROM rc) USING (site_id, visitor_id, seq, since) WHERE session_id <> '')",
        ),
    }
