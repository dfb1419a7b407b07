import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from footlog.model import DAY_MS, MINUTE_MS, Window
from footlog.operators import heatmap, replays
from footlog.sources import recordings as stored
from footlog.sources.recordings import CHUNK_SCHEMA, land_chunks, purge, purge_store, read_chunks, store_chunks, without_recordings
from tests.raw import CHROME, sites_frame

NOW = 1_767_268_800_000
SETTINGS = "site_id string, enabled boolean, sample_rate double, max_minutes int, retention_days int"


def chunk(load, seq, ts, events, visitor="v1", packed=True, site="demo"):
    text = events if isinstance(events, bytes) else json.dumps(events).encode()
    return (site, visitor, load, seq, ts, CHROME, "de", packed, gzip.compress(text) if packed else text)


def landed(spark, *chunks):
    return land_chunks(spark.createDataFrame(chunks, CHUNK_SCHEMA))


def settings(spark, **over):
    row = {"site_id": "demo", "enabled": True, "sample_rate": 1.0, "max_minutes": 30, "retention_days": 30} | over
    return spark.createDataFrame([tuple(row.values())], SETTINGS)


def snap(name):
    return {"n": name}


def test_landing_skips_bad_chunks_and_masks_input(spark):
    events = [
        [0, 0, snap("a"), 1250, 800, "/p"], [5, 6, 7, "pass word"], [6, 6, 8, True], [7, 42, 1], [8, 3, 1, 2.5, "x"],
        [-1, 3, 1, 1, 1], "no", [9, 8, "x" * 300], [10, 9, 5], [11, 6, 0, "x"],
    ]
    rows = landed(
        spark, chunk("load0001", 0, NOW, events), chunk("load0001", 1, NOW, b"\x00junk", packed=False),
        ("demo", "v1", "load0001", 2, NOW, CHROME, "de", True, b"not gzip"), chunk("load0001", 3, NOW, {"a": 1}),
        chunk("load0001", 4, NOW, b'"' + b"x" * 4_100_000 + b'"'),
    ).collect()
    got = {(r.seq, r.pos): (r.type, r.args) for r in rows}
    assert got == {
        (0, 0): (0, ['{"n":"a"}', "1250", "800", "/p"]), (0, 1): (6, ["7", "**** ****"]), (0, 2): (6, ["8", "true"]),
        (0, 4): (3, ["1", "3", "0"]), (0, 7): (8, ["x" * 200]),
    }


def heat_events(spark):
    def record(rid, at, *loads):
        return [chunk(f"{rid}load{i:04}", 0, at, events, visitor=rid) for i, events in enumerate(loads)]

    day = DAY_MS
    rows = landed(
        spark,
        *record("r1", NOW - 2 * day, [[0, 0, snap("old"), 1250, 800, "/pricing"], [100, 3, 5, 500, 100], [200, 4, 0, 0, 1200], [300, 3, 6, 250, 100]]),
        *record("r2", NOW - day, [[0, 0, snap("new"), 1250, 800, "/pricing"], [50, 3, 5, 500, 100]], [[0, 0, snap("m"), 390, 700, "/pricing"], [10, 3, 5, 195, 50]]),
        *record("r3", NOW - 3 * day, [[0, 0, snap("home"), 1250, 800, "/"], [100, 7, "/pricing"], [200, 3, 9, 100, 300]]),
    )
    return rows.withColumn("replay_id", F.col("visitor_id")).withColumn("started_at", F.col("ts"))


def test_heatmap(spark):
    parts = heatmap.heatmap(heat_events(spark))
    points = {(r.device, r.path, r.x, r.y): r.clicks for r in parts["points"].collect()}
    assert points == {
        ("desktop", "/pricing", 0.4, 104): 2, ("desktop", "/pricing", 0.2, 1304): 1, ("desktop", "/pricing", 0.08, 304): 1,
        ("mobile", "/pricing", 0.5, 48): 1,
    }
    reach = {r.bin: r.views for r in parts["reach"].where("device = 'desktop' AND path = '/pricing'").collect()}
    assert len(reach) == 20 and reach[0] == 3 and reach[8] == 3 and reach[9] == 1 and reach[19] == 1
    pages = {(r.device, r.path): (r.views, r.spa_views) for r in parts["pages"].collect()}
    assert pages == {("desktop", "/pricing"): (3, 1), ("desktop", "/"): (1, 0), ("mobile", "/pricing"): (1, 0)}
    shot = parts["snapshot"].where("device = 'desktop' AND path = '/pricing'").first()
    assert (json.loads(shot.snap), shot.width, shot.at) == (snap("new"), 1250.0, NOW - DAY_MS)


def test_heatmap_state_crosses_chunks(spark):
    rows = landed(
        spark, chunk("load0001", 0, NOW, [[0, 0, snap("a"), 1000, 500, "/a"], [1, 4, 0, 0, 300]]), chunk("load0001", 1, NOW, [[5, 3, 1, 100, 20]]),
        chunk("load0001", 2, NOW, [[6, 5, 500, 400], [7, 3, 1, 100, 20], [8, 7, "/b"], [9, 3, 1, 100, 20]]),
    ).withColumn("replay_id", F.lit("r")).withColumn("started_at", F.col("ts"))
    points = {(r.device, r.path, r.x, r.y) for r in heatmap.heatmap(rows)["points"].collect()}
    assert points == {("tablet", "/a", 0.1, 320), ("tablet", "/a", 0.2, 320), ("mobile", "/b", 0.2, 24)}


def test_recordings_stop_at_the_limit_and_start_again_after_the_gap(spark):
    minutes = [0, 10, 29, 31, 45, 59, 60, 61]
    rows = landed(spark, *[chunk("load0001", i, NOW + m * MINUTE_MS, [[1000, 3, 1, 1, 1]]) for i, m in enumerate(minutes)])
    chunks = replays.recorded_chunks(replays.chunk_facts(rows), settings(spark))
    got = {}
    for r in chunks.collect():
        got.setdefault((r.recording_from - NOW) // MINUTE_MS, []).append((r.ts - NOW) // MINUTE_MS)
    assert {k: sorted(v) for k, v in got.items()} == {0: [0, 10, 29], 60: [60, 61]}


def test_events_are_dealt_out_by_chunk_once(spark):
    sent = chunk("load0001", 0, NOW, [[0, 0, snap("a"), 1250, 800, "/p"], [5, 3, 1, 2, 3], [9, 7, "/q"]])
    facts = replays.chunk_facts(landed(spark, sent, sent, chunk("load0001", 1, NOW + 1, [[3, 6, 4, "x"], [4, 8, "boom"]])))
    plan = facts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Aggregate" not in plan[plan.index("Exchange") :]
    got = {r.seq: (r.events, r.pages, r.clicks, r.inputs, r.errors, r._snap and r._snap.args) for r in facts.collect()}
    assert got == {0: (3, 2, 1, 0, 0, ['{"n":"a"}', "1250", "800", "/p"]), 1: (2, 0, 0, 1, 1, None)}


def test_chunks_are_dealt_out_before_they_are_opened(spark, tmp_path, monkeypatch):
    given, opened = [], stored.open_chunks
    monkeypatch.setattr(stored, "open_chunks", lambda chunks: given.append(chunks) or opened(chunks))
    chunks = [chunk("load0001", n, NOW + n % 3 * DAY_MS, [[i, 3, 1, 2, 3] for i in range(50)], site=f"s{n % 2}") for n in range(12)]
    rows = store_chunks(spark.createDataFrame([*chunks, ("s0", "v1", "load0001", 99, NOW, CHROME, "de", True, b"not gzip")], CHUNK_SCHEMA), str(tmp_path / "chunks"))
    assert "Rebalance" in given[0]._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.seq, r.site_id, r["count"]) for r in rows.groupBy("seq", "site_id", "day").count().collect()} == {*((n, f"s{n % 2}", 50) for n in range(12)), (99, "s0", 1)}
    assert rows.select("day").distinct().count() == 3 and len(list((tmp_path / "chunks").glob("*/*/*.parquet"))) <= 12


def test_recording_row(spark):
    rows = landed(
        spark,
        chunk("load0001", 0, NOW, [[0, 0, snap("a"), 1250, 800, "/p"], [500, 3, 1, 1, 1], [900, 8, "boom"]]),
        chunk("load0001", 0, NOW + 5, [[0, 0, snap("a"), 1250, 800, "/p"], [500, 3, 1, 1, 1], [900, 8, "boom"]]),
        chunk("load0001", 1, NOW + 5000, [[1000, 6, 3, "x"], [1500, 7, "/q"], [2000, 9, "hidden"]]),
    )
    visits = spark.createDataFrame(
        [("demo", "v1", NOW + 3000, "s1"), ("demo", "v1", NOW + 4000, "s2"), ("demo", "v2", NOW, "other")],
        "site_id string, visitor_id string, ts long, session_id string",
    )
    row = replays.recordings(replays.recorded_chunks(replays.chunk_facts(rows), settings(spark)), visits).first()
    assert (row.started_at, row.last_at, row.chunks, row.events) == (NOW - 900, NOW + 5000, 2, 6)
    assert (row.pages, row.clicks, row.inputs, row.errors, row.gaps) == (2, 1, 1, 1, 1)
    assert (row.entry_path, row.viewport, row.country, row.device, row.session_id) == ("/p", "1250x800", "DE", "desktop", "s2")


def test_recording_selection(spark):
    sites = sites_frame(spark)
    requests = spark.createDataFrame(
        [("demo", "00000000ff", {}), ("demo", "ffffffffff", {}), ("demo", "00000000ff", {"dnt": "1"}), ("quiet", "0", {}), ("gone", "0", {})],
        "site_id string, visitor_id string, headers map<string,string>",
    )
    reasons = [r.reason for r in replays.selected(requests, sites, settings(spark, sample_rate=0.5)).orderBy("site_id", "visitor_id", "reason").collect()]
    assert sorted(reasons) == sorted(["", "not_sampled", "do_not_track", "strict_privacy_mode", "site_unknown"])
    off = replays.selected(requests.where("site_id = 'demo'"), sites, settings(spark, enabled=False)).collect()
    assert {r.reason for r in off} == {"replay_disabled"}


def test_playback_and_markers(spark):
    rows = landed(
        spark, chunk("load0001", 0, NOW + 1000, [[0, 0, snap("a"), 1250, 800, "/p"], [900, 3, 1, 1, 1]]),
        chunk("load0001", 1, NOW + 2050, [[2000, 3, 1, 1, 1]]), chunk("load0002", 0, NOW + 10_000, [[0, 0, snap("b"), 1250, 800, "/q"]]),
    ).withColumn("replay_id", F.lit("r"))
    at = sorted((r.at, r.type) for r in replays.playback(rows).collect())
    assert at == [(0, 0), (900, 3), (2000, 3), (9950, 0)]
    recorded = spark.createDataFrame([("demo", "r", "s1")], "site_id string, replay_id string, session_id string")
    start = NOW + 50
    analytics = spark.createDataFrame(
        [
            ("demo", "s1", start - 5000, 1, "pageview", "pageview", "/p"), ("demo", "s1", start - 5001, 2, "pageview", "pageview", "/x"),
            ("demo", "s1", start + 100, 3, "event", "error", "/p"), ("demo", "s1", start + 200, 4, "event", "scroll", "/p"),
            ("demo", "s1", start + 14_950, 5, "event", "buy", "/q"), ("demo", "s2", start, 6, "event", "buy", "/q"),
        ],
        "site_id string, session_id string, ts long, ingest_seq long, type string, name string, path string",
    )
    got = sorted((r.t, r.kind, r.label) for r in replays.markers(rows, recorded, analytics).collect())
    assert got == [(0, "pageview", "/p"), (100, "error", "error · /p"), (14_950, "event", "buy · /q")]


def test_retention_and_deletion(spark):
    rows = spark.createDataFrame(
        [("demo", "a", NOW - 31 * DAY_MS), ("demo", "b", NOW - 29 * DAY_MS), ("bare", "c", NOW - 31 * DAY_MS)],
        "site_id string, replay_id string, started_at long",
    )
    kept, events = purge(rows, rows.drop("started_at"), settings(spark, retention_days=40), NOW)
    assert {r.replay_id for r in kept.collect()} == {"a", "b"} == {r.replay_id for r in events.collect()}
    assert {r.replay_id for r in without_recordings(rows, "demo", "a").collect()} == {"b", "c"}
    assert {r.replay_id for r in without_recordings(rows, "demo").collect()} == {"c"}
    full = kept.withColumns({"last_at": F.col("started_at") + 5000, "pages": F.lit(1), "errors": F.lit(0), "country": F.lit("DE")})
    window = Window(NOW - 90 * DAY_MS, NOW)
    listed = replays.list_replays(full, settings(spark), window, NOW, min_duration_ms=5000, equal={"country": "DE"})
    assert [r.replay_id for r in listed.collect()] == ["b"]
    assert replays.list_replays(full, settings(spark), window, NOW, errors_only=True).count() == 0


def walked(times, cap, gap):
    """What a sequential reader of one visitor's arrivals makes of them: (since, started, arrivals taken)."""
    out = []
    for at, started in times:
        if not out or at - out[-1][2][-1] > gap:
            out.append((at, started, [at]))
        elif at - out[-1][1] <= cap:
            out[-1][2].append(at)
    return [(since, started, len(taken)) for since, started, taken in out]


@pytest.mark.parametrize("seed,staged", [(1, False), (2, True)])
def test_long_runs_are_cut_as_if_walked(spark, tmp_path, seed, staged):
    """Limits of several lengths, restarts after a silence, equal arrival times, chains of one to many recordings."""
    rng, minute = random.Random(seed), 60_000
    rows, want = [], []
    for visitor in range(12):
        site, at, times = "ab"[visitor % 2], 1_000_000, {}
        for n in range([1, 3, 40, 150][visitor % 4]):
            at += rng.choice([0, minute, 4 * minute, 9 * minute, 29 * minute, 30 * minute] + [31 * minute] * (visitor % 3 == 0))
            t_last = rng.randrange(2 * minute)
            rows.append((site, f"v{visitor}", f"p{n:05}", 0, at, t_last))
            times.setdefault(at, at - t_last)  # the first page load of equal arrivals
        taken = dict.fromkeys(times, 0)
        for row in rows:
            if row[1] == f"v{visitor}":
                taken[row[4]] += 1
        for since, started, n in walked(sorted(times.items()), {"a": 30, "b": 12}[site] * minute, 30 * minute):
            want.append((f"v{visitor}", since, started))
    chunks = spark.createDataFrame(rows, "site_id string, visitor_id string, page_load string, seq int, ts long, t_last long")
    settings = spark.createDataFrame([("b", 12)], "site_id string, max_minutes int")
    placed = replays.recorded_chunks(chunks, settings, staging=str(tmp_path / "steps") if staged else None)
    got = {(r.visitor_id, r.recording_from, r.started_at) for r in placed.select("visitor_id", "recording_from", "started_at").distinct().collect()}
    assert got == set(want)


def test_purge_of_the_stored_table(spark, tmp_path):
    """Old days go whole, mixed ones lose their expired recordings only, emptied ones and other sites are right."""
    cutoff = NOW - 30 * DAY_MS
    day = cutoff - cutoff % DAY_MS
    times = {"old": day - 3 * DAY_MS, "edge": cutoff - 60_000, "late": cutoff + 60_000, "new": NOW - DAY_MS}
    chunks = [chunk("p", i, ts, [[0, 7, "/a"], [5, 3, 1, 2, 3]], visitor=name) for i, (name, ts) in enumerate(times.items())]
    chunks += [chunk("p", 9, cutoff + 90_000, [[0, 7, "/b"]], visitor="edge"), chunk("p", 0, times["old"], [[0, 7, "/c"]], visitor="old", site="long")]
    path = str(tmp_path / "chunks")
    rows = store_chunks(spark.createDataFrame(chunks, CHUNK_SCHEMA), path)
    assert rows.count() == 10 and {f.name for f in (tmp_path / "chunks").iterdir() if f.is_dir()} == {"site_id=demo", "site_id=long"}
    own = spark.createDataFrame([("long", True, 1.0, 30, 60)], SETTINGS)
    placed = replays.recorded_chunks(replays.chunk_facts(rows.drop("refused")), own, staging=str(tmp_path / "steps"))
    done = purge_store(spark, path, str(tmp_path / "staging"), placed, own, NOW)
    left = {(r.site_id, r.visitor_id, r.n) for r in read_chunks(spark, path).groupBy("site_id", "visitor_id").agg(F.count("*").alias("n")).collect()}
    # The recording begun a minute before the cutoff goes, and with it the chunk that came after.
    assert left == {("demo", "late", 2), ("demo", "new", 2), ("long", "old", 1)}
    assert done == {"dropped": 1, "rewritten": 1, "removed": 3}
    assert purge_store(spark, path, str(tmp_path / "staging"), placed.limit(0), own, NOW) == {"dropped": 0, "rewritten": 1, "removed": 0}
