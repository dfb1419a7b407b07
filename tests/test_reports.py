import random

import pytest
from pyspark.sql import functions as F

from footlog.model import DAY_MS, EVENT_SCHEMA, Scope, Window, WindowError
from footlog.operators import breakdowns, explore, filters, lifecycle, paths, scalars, series, vitals
from footlog.operators.claims import check_claims
from footlog.operators.filters import Filter, FilterError
from footlog.operators.paths import FunnelError, Goal, GoalError, Step
from footlog.sources import csv_history
from footlog.sources.event_table import append_events, read_events, remove_batch, with_defaults, write_events

NOW = 1_767_268_800_000
WEEK = Window(NOW - 7 * DAY_MS, NOW)


def table(spark, *rows):
    """Events from short dicts; ids and arrival numbers follow the order."""
    names = EVENT_SCHEMA.fieldNames()
    base = {"site_id": "demo", "visitor_id": "v", "session_id": "s", "type": "pageview", "name": "pageview", "path": "/"}
    full = [dict.fromkeys(names) | base | {"id": f"e{i}", "ingest_seq": i, "ts": NOW - DAY_MS + i} | r for i, r in enumerate(rows)]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in EVENT_SCHEMA)
    return with_defaults(spark.createDataFrame([tuple(r[n] for n in names) for r in full], schema))


def seen(who, ts, **more):
    return {"identity": who, "visitor_id": who, "session_id": f"{who}-{ts}", "ts": ts} | more


def test_growth_accounting_adds_up(spark):
    prev, old = WEEK.from_ms - 3 * DAY_MS, WEEK.from_ms - 30 * DAY_MS
    rows = [
        *[seen(w, t) for w in ("ret-1", "ret-2") for t in (prev, NOW - DAY_MS)], seen("gone-1", prev), seen("gone-2", prev),
        seen("gone-2", prev + 3_600_000), seen("gone-3", prev), seen("back-1", old), seen("back-1", NOW - 3 * DAY_MS),
        seen("new-1", NOW - 6 * DAY_MS), seen("new-1", NOW - DAY_MS), seen("new-2", NOW - 2 * DAY_MS), seen("new-3", NOW - 1000),
        seen("bot-1", NOW - 1000, bot_kind="ai-crawler"),
    ]
    r = lifecycle.accounting(Scope(table(spark, *rows), WEEK, "demo")).first()
    assert (r.active, r.prev_active, r.new_users, r.retained, r.resurrected, r.churned) == (6, 5, 3, 2, 1, 3)
    assert r.active == r.retained + r.new_users + r.resurrected and r.prev_active == r.retained + r.churned
    assert (r.gained, r.lost, r.net, r.quick_ratio, r.retained_rate) == (4, 3, 1, 1.33, 40.0)


def test_an_empty_site_counts_zero_and_has_no_ratio(spark):
    scope = Scope(table(spark, {}), WEEK, "nobody")
    assert scalars.scalar(scope, "visitors.unique").first().value == 0
    assert scalars.scalar(scope, "bounce.rate").first().value == 0.0
    assert lifecycle.accounting(scope).first().quick_ratio is None
    flat = series.series(scope, "timeseries.sessions").collect()
    assert len(flat) == 7 and {(r.sessions, r.bounce_rate) for r in flat} == {(0, None)}


def random_events(spark, seed, sessions=40):
    rng = random.Random(seed)
    rows = []
    for _ in range(400):
        kind = rng.choice(["/a", "/b", "/c", "x", "y"])
        view = kind.startswith("/")
        rows.append(
            {"session_id": f"s{rng.randrange(sessions)}", "ts": NOW - DAY_MS + rng.randrange(60) * 1000, "type": "pageview" if view else "event",
             "name": "pageview" if view else kind, "path": kind if view else "/a"}
        )
    return rows, table(spark, *rows)


def ordered(rows):
    by = {}
    for i, r in enumerate(rows):
        by.setdefault(r["session_id"], []).append((r["ts"], i, r))
    return {s: [x[2] for x in sorted(v, key=lambda x: x[:2])] for s, v in by.items()}


@pytest.mark.parametrize("slice_ms", [2_000, 60_000])
def test_funnel_equals_brute_force_whatever_the_slices(spark, slice_ms):
    steps = (Step("page", "/a"), Step("event", "x"), Step("event", "x"), Step("page", "/b"))
    rows, events = random_events(spark, 1)
    want = {}
    for session, own in ordered(rows).items():
        at, done = -1, 0
        for step in steps:
            hits = [r["ts"] for r in own if r["ts"] >= at and (r["path"] == step.value and r["type"] == "pageview" if step.type == "page" else r["name"] == step.value)]
            if not hits:
                break
            at, done = min(hits), done + 1
        want[session] = done
    got = {r.session_id: r.done for r in paths.reached_steps(Scope(events, WEEK).rows(), steps, slice_ms).collect()}
    assert got == {s: d for s, d in want.items() if s in got} and all(d == 0 for s, d in want.items() if s not in got)
    with pytest.raises(FunnelError):
        paths.funnel(Scope(events, WEEK), steps[:1])


@pytest.mark.parametrize("slice_ms", [2_000, 3_600_000])
def test_journeys_equal_brute_force_whatever_the_slices(spark, slice_ms):
    rows, events = random_events(spark, 2)
    want = {}
    for own in ordered([r for r in rows if r["type"] == "pageview"]).values():
        pages = [r["path"] for i, r in enumerate(own) if i == 0 or own[i - 1]["path"] != r["path"]][:3]
        key = tuple(pages + [None] * (3 - len(pages)))
        want[key] = want.get(key, 0) + 1
    views = Scope(events, WEEK)
    got = {tuple(r)[1:4]: r.sessions for r in paths.journeys(views, 3, 100, slice_ms=slice_ms).collect()}
    assert got == want


def test_percentiles_are_exact(spark):
    rng = random.Random(3)
    values = [round(rng.choice([rng.uniform(0, 1), rng.uniform(0, 9000), -5.0, 0.0, 1e7]), 3) for _ in range(501)]
    frame = spark.createDataFrame([("g", v) for v in values], "g string, value double")
    got = {r.percentile: r.value for r in vitals.nearest_rank(frame, ["g"], [50, 75, 90, 99]).collect()}
    ranked = sorted(values)
    assert got == {p: ranked[min(501, int(p / 100 * 501) + 1) - 1] for p in (50, 75, 90, 99)}


def test_filters_refuse_what_they_do_not_know():
    for bad in (("password", "x"), ("path", ""), ("path", "x" * 201), ("prop:a b", "x")):
        with pytest.raises(FilterError):
            Filter(*bad)
    with pytest.raises(FilterError):
        Filter("path", "x", "like")


def test_filters(spark):
    rows = [
        {"session_id": "a", "path": "/in", "country": "DE"}, {"session_id": "a", "path": "/50%_off", "props": '{"plan":"pro","ok":true}'},
        {"session_id": "b", "path": "/other"}, {"session_id": "b", "type": "event", "name": "buy", "path": "/x", "props": '{"plan":"free"}'},
        {"session_id": "c", "path": "/In/side", "ts": NOW - 8 * DAY_MS}, {"session_id": "c", "path": "/late"},
    ]
    events = table(spark, *rows)

    def sessions(*used):
        found = Scope(events, WEEK, "demo", used).rows().select("session_id").distinct().collect()
        return "".join(sorted(r[0] for r in found))

    assert sessions(Filter("path", "50%_", "contains")) == "a"
    assert sessions(Filter("path", "/IN", "starts_with")) == "a"
    assert sessions(Filter("event", "buy")) == "b"
    assert sessions(Filter("entry_page", "/In/side")) == "c"
    assert sessions(Filter("exit_page", "/late", "is_not")) == "ab"
    assert sessions(Filter("prop:plan", "pro", "is_not")) == "b"
    assert sessions(Filter("prop:ok", "1")) == "a"
    assert sessions(Filter("path", "^/(in|late)$", "regex")) == "ac"
    with pytest.raises(FilterError):
        filters.apply_filters(events, events, (Filter("path", "/"),) * 9)


def test_windows_and_goals():
    assert Window.last_days(3, NOW).span == 3 * DAY_MS
    assert Window.dates("2026-01-01", "2026-01-02").span == 2 * DAY_MS
    for bad in (("2026-1", "2026-01-02"), ("2026-01-03", "2026-01-02"), ("2024-01-01", "2026-01-02")):
        with pytest.raises(WindowError):
            Window.dates(*bad)
    with pytest.raises(WindowError):
        series.bucket_width(Window(0, 30 * DAY_MS), "minute")
    assert paths.path_pattern("/blog/*/x**") == "^/blog/[^/]*/x.*$"
    with pytest.raises(GoalError):
        Goal("page", "blog")


def test_nothing_is_cut_unasked(spark):
    rows = [{"type": "event", "name": "identify", "identity": "p", "props": f'{{"t{i}":"v"}}', "ts": NOW - i} for i in range(60)]
    assert explore.traits(table(spark, *rows)).count() == 60
    many = table(spark, *[{"path": f"/{i}", "session_id": f"s{i}", "ts": NOW - 1 - i} for i in range(1300)])
    scope = Scope(many, WEEK)
    assert explore.list_sessions(scope, limit=250).count() == 250
    assert explore.list_sessions(scope, limit=None).count() == 1300
    assert breakdowns.breakdown(scope, "pages.top", limit=None).count() == 1300
    # More rows than Spark trims by itself are ranked in two stages, with the same result.
    newest = explore.list_sessions(scope, limit=1100, offset=50).collect()
    assert sorted((r.started for r in newest), reverse=True) == [NOW - 1 - i for i in range(50, 1150)]
    assert Window.last_days(400, NOW).span == 400 * DAY_MS


def test_error_groups_use_the_properties(spark):
    props = '{"message":"boom","source":"/app.js","line":4}'
    rows = [{"type": "event", "name": "error", "props": props, "source": s, "path": p} for s, p in (("google", "/a"), ("", "/b"))]
    groups = breakdowns.breakdown(Scope(table(spark, *rows), WEEK), "errors.groups").collect()
    assert [(r.message, r.source, r.line, r.hits, r.pages) for r in groups] == [("boom", "/app.js", "4", 2, 2)]


# Labelled texts with the numbers that were measured and how many sentences must go.
CLAIMS = [
    ([7, 12.3, 40, 247, 1234], "247 sessions were recorded in the last 7 days [e1]. Conversion was 12.3% [e2].", 0),
    ([7, 40, 247], "247 sessions were recorded in the last 7 days. Conversion rose 41.7%.", 1),
    ([40, 200], "40 of 200 sessions came from AI, one fifth of the total. That is 20%.", 1),
    ([247], "Sessions reached 312 [e1].", 1),
    ([5], "Traffic sources look balanced [e1, e2, e12]. The largest channel is search with 5 sessions.", 0),
    ([9], "There were 9 sessions as of 14:30 on 2026-09-12.", 0),
    ([6], "The most viewed page was /blog/10-tips, with 6 views.", 0),
    ([1234], "A total of 1.234 pageviews were recorded.", 0),
    ([1234], "A total of 1,234 pageviews were recorded.", 0),
    ([-18.04], "Traffic fell 18%. GPT-4 sent nobody.", 0),
    ([5], "The deploy caused 5 errors.", 1),
    ([5], "The deploy coincides with 5 errors.", 0),
    ([1234.5], "The average duration was 1.234,5 seconds.", 0),
    ([], "No signups arrived: 0. The mobile share is 100%.", 0),
    ([18], "Visitors are down 18%.", 0),
    ([214, 22, 58], "The error rate went up 2.8 times.", 1),
    ([18], "Visitors are down 18%. The last deploy caused the drop.", 1),
    ([18], "Visitors are down 18%. The drop coincides with the last deploy.", 0),
    ([12], "Conversion fell 12% because of the new theme release.", 1),
    ([], "Search traffic appears to dominate and mobile users stand out.", 0),
    ([10], "There were 10 sessions. 7 of them were mobile. Conversion was 3.4%.", 2),
    ([42.47], "The rate sits around 42.5%.", 0),
    ([3], "3 sessions arrived from GPT-4 and Claude-3.", 0),
]


def test_claims(spark):
    texts = spark.createDataFrame([(i, t) for i, (_, t, _) in enumerate(CLAIMS)], "bundle int, text string")
    measured = spark.createDataFrame([(i, float(v)) for i, (vs, _, _) in enumerate(CLAIMS) for v in vs], "bundle int, value double")
    rows = check_claims(texts, measured, ["bundle"], ["bundle"]).groupBy("bundle").agg(F.sum(F.col("dropped").cast("int")).alias("n"))
    assert {r.bundle: r.n for r in rows.collect()} == {i: n for i, (_, _, n) in enumerate(CLAIMS)}


HEAD = "event_id,session_id,visit_id,created_at,url_path,url_query,referrer_domain,referrer_path,event_type,event_name,browser,os,device,country,region,page_title"


def test_import_append_and_removal(spark, tmp_path):
    csv = tmp_path / "export.csv"
    csv.write_text(
        HEAD + "\r\n"
        'e1,s1,v1,2026-03-01 10:00:00,/,,www.google.com,/search,1,,chrome,Mac OS,laptop,DE,BE,"say ""hi"",\r\nthere"\r\n'
        "e2,s1,v1,2026-03-01 10:02:00.5,/p,,example.com,,2,signup,ios,iOS,mobile,,,\r\n"
        "e2,s1,v1,2026-03-01 10:02:00.5,/p,,example.com,,2,signup,ios,iOS,mobile,,,\r\n"
        "e3,s2,,yesterday,/,,,,1,,,,,,,\r\ne4,s2,,2026-03-01 10:00:00,/,,,,7,,,,,,,\r\ne5,s2,,2026-03-01 10:00:00,/,,,,2,,,,,,,\r\n"
        "e6,s2,,2026-04-01 00:00:00,/,,,,1,,,,,,,\r\n,s2,,2026-03-01 10:00:00,/,,,,1,,,,,,,\r\n"
    )
    path, stage = str(tmp_path / "events"), str(tmp_path / "stage")
    write_events(table(spark, {"id": "own", "ts": NOW}), path)
    rows = csv_history.mapped(csv_history.read_export(spark, str(csv)), "demo", "example.com", "b1", 1_773_532_800_000)
    stored = read_events(spark, path)
    assert {r.outcome: r.rows for r in csv_history.summary(rows, stored).collect()} == {
        "imported": 2, "already_imported": 1, "bad_timestamp": 1, "unknown_event_type": 1, "event_without_name": 1,
        "overlaps_collected_data": 1, "missing_id": 1,
    }
    append_events(csv_history.importable(rows, stored), path)
    append_events(csv_history.importable(rows, stored), path)
    got = {r.id: r for r in read_events(spark, path).collect()}
    assert set(got) == {"own", "umami:e1", "umami:e2"}
    one = got["umami:e1"]
    assert (one.channel, one.source, one.browser, one.os, one.device, one.region) == ("search", "google", "Chrome", "macOS", "desktop", "DE-BE")
    # Spark's CSV reader writes a line break inside quotes as a single newline.
    assert one.title == 'say "hi",\nthere' and got["umami:e2"].channel == "internal" and got["umami:e2"].ts % 1000 == 500
    assert one.session_id == got["umami:e2"].session_id and one.session_id.startswith("umami-")
    assert remove_batch(spark, path, stage, "demo", "other") == 0
    assert remove_batch(spark, path, stage, "demo", "b1") == 2
    assert [r.id for r in read_events(spark, path).collect()] == ["own"]
    with pytest.raises(csv_history.ExportError):
        csv_history.mapped(spark.createDataFrame([("a",)], "date string"), "demo", "example.com", "b")
