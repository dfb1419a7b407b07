import json
import random
import time
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from footlog.model import COLUMN_DEFAULTS, DAY_MS, EVENT_SCHEMA, MINUTE_MS, Scope, Window
from footlog.operators import scalars, vitals
from footlog.operators.ordered import sessionize
from footlog.plans.enrich import SESSION_NAME, ingest
from footlog.sources import distinct_days
from footlog.sources.beacons import batch_answers, open_batches, read_requests, stream_requests
from footlog.sources.event_table import append_events, new_events, read_events, read_near, with_defaults, write_events
from footlog.sources.people_days import VISIT, once, people_days, read_people_days
from footlog.sources.session_days import fold, read_session_days, session_days
from footlog.sources.vital_days import read_vital_days
from footlog.streaming import intake, live, sessions
from tests.raw import CHROME, NOW, raw_frame, sites_frame

GAP = 30 * MINUTE_MS
VIEW = {"site": "demo", "type": "pageview", "url": "/"}


def landed(path, start, times, ip="1.2.3.4", body=VIEW):
    path.mkdir(exist_ok=True)
    lines = [
        json.dumps(
            {"request_id": f"q{start + i}", "ingest_seq": start + i, "body": body, "received_at": NOW + t, "ip": ip, "user_agent": CHROME, "headers": {}}
        )
        for i, t in enumerate(times)
    ]
    (path / f"part{start}.json").write_text("\n".join(lines) + "\n")


def drain(frame, name, checkpoint, mode="append"):
    query = frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return frame.sparkSession.table(name)


def test_stream_and_batch_sessions_agree(spark, tmp_path):
    times = [0, GAP, 2 * GAP + 1, 2 * GAP + 2]
    landed(tmp_path / "in", 0, times[:2])
    landed(tmp_path / "in", 2, times[2:])
    sites = sites_frame(spark)
    batch, _ = ingest(read_requests(spark, str(tmp_path / "in")), sites, "s")
    want = {r.id: r.session_id for r in batch.collect()}
    assert len(set(want.values())) == 2
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", sessions.ROCKSDB)
    stream = intake.enriched(stream_requests(spark, str(tmp_path / "in"), 1), sites, "s")
    got = drain(sessions.assign_sessions(stream), "assigned", tmp_path / "c1")
    assert {r.id: r.session_id for r in got.collect()} == want


def test_session_window_keeps_the_exact_gap(spark, tmp_path):
    landed(tmp_path / "in", 0, [0, GAP, 2 * GAP + 1])
    stream = intake.enriched(stream_requests(spark, str(tmp_path / "in")), sites_frame(spark), "s")
    got = drain(sessions.session_facts(stream), "facts", tmp_path / "c", "complete")
    assert sorted((r.start_ts - NOW, r.end_ts - NOW, r.events) for r in got.collect()) == [(0, GAP, 2), (2 * GAP + 1, 2 * GAP + 1, 1)]


def test_live_visitors(spark, tmp_path):
    landed(tmp_path / "in", 0, [0, 1000])
    landed(tmp_path / "in", 2, [2000], ip="5.6.7.8")
    landed(tmp_path / "in", 3, [3 * 86_400_000])
    stream = intake.enriched(stream_requests(spark, str(tmp_path / "in"), 1), sites_frame(spark), "s")
    got = drain(live.live_visitors_exact(stream), "exact", tmp_path / "c1")
    counts = {(r.window.start.timestamp() * 1000 - NOW) / MINUTE_MS: r.visitors for r in got.collect()}
    assert counts == {-4: 2, -3: 2, -2: 2, -1: 2, 0: 2}
    near = drain(live.live_visitors(stream), "near", tmp_path / "c2")
    assert {r.visitors for r in near.collect()} == {2}
    buckets = drain(live.live_traffic(stream), "buckets", tmp_path / "c3")
    assert {(r.views, r.events) for r in buckets.collect()} == {(3, 0)}


def test_panes_count_visitors_as_sliding_windows_do(spark, tmp_path):
    schema = "site_id string, visitor_id string, ts long, bot_kind string, bot_score int, agent_trust string"
    picked = random.Random(5)
    rows = [("ab"[picked.random() < 0.1], f"v{picked.randrange(6)}", NOW + picked.randrange(90 * MINUTE_MS), "", 0, "human") for _ in range(500)]
    rows += [("a", "v1", NOW + 5 * MINUTE_MS, "crawler", 0, "human"), rows[0]]
    folder = str(tmp_path / "in")
    for part in range(3):  # late and out of order
        spark.createDataFrame(rows[part::3], schema).coalesce(1).write.mode("append").parquet(folder)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", sessions.ROCKSDB)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    panes = drain(live.live_panes(source), "panes", tmp_path / "c")
    want = {}
    for site, visitor, ts, kind, _, _ in rows:
        for back in range(5 if kind == "" else 0):
            want.setdefault((site, (ts // MINUTE_MS - back) * MINUTE_MS), set()).add(visitor)
    assert {(r.site_id, r.start): r.visitors for r in live.live_counts(panes).collect()} == {k: len(v) for k, v in want.items()}
    distinct_panes = {(r[0], r[1], r[2] // MINUTE_MS) for r in rows if r[3] == ""}
    assert panes.count() <= len(distinct_panes)
    assert live.live_counts(panes.limit(0)).count() == 0
    with pytest.raises(ValueError):
        live.live_panes(source, 90_000)


def test_intake_is_idempotent_and_continues_sessions(spark, tmp_path):
    table = str(tmp_path / "events")
    write_events(with_defaults(spark.createDataFrame([], EVENT_SCHEMA)), table)
    (tmp_path / "in").mkdir()
    requests = stream_requests(spark, str(tmp_path / "in"))
    for start, times in ((0, [0, 1000]), (2, [GAP + 1000, 3 * GAP])):
        landed(tmp_path / "in", start, times)
        intake.start_intake(requests, sites_frame(spark), "s", table, str(tmp_path / "c"), True).awaitTermination(120)
    # The same requests again, under a new checkpoint.
    intake.start_intake(requests, sites_frame(spark), "s", table, str(tmp_path / "c2"), True).awaitTermination(120)
    rows = sorted(read_events(spark, table).collect(), key=lambda r: r.ts)
    assert [r.id for r in rows] == ["q0", "q1", "q2", "q3"]
    assert rows[0].session_id == rows[1].session_id == rows[2].session_id != rows[3].session_id


def test_the_intake_keeps_the_side_tables(spark, tmp_path):
    table, side, people, bits, values = (str(tmp_path / name) for name in ("events", "sessions", "people", "distincts", "vitals"))
    paint = {"site": "demo", "type": "event", "name": "web_vitals", "url": "/"}
    distinct_days.create(spark, bits)
    write_events(with_defaults(spark.createDataFrame([], EVENT_SCHEMA)), table)
    (tmp_path / "in").mkdir()
    requests = stream_requests(spark, str(tmp_path / "in"))
    for start, times in ((0, [0, 1000]), (2, [GAP + 1000, 3 * GAP])):
        landed(tmp_path / "in", start, times)
        landed(tmp_path / "in", start + 10, [500], body={**paint, "props": {"lcp": 1200 + start, "cls": 0.25}})
        intake.start_intake(requests, sites_frame(spark), "s", table, str(tmp_path / "c"), True, side, people, bits, values).awaitTermination(120)
    # The same requests again, under a new checkpoint: nothing is stored or told twice.
    intake.start_intake(requests, sites_frame(spark), "s", table, str(tmp_path / "c2"), True, side, people, bits, values).awaitTermination(120)
    got = sorted((r.started, r.ended, r.pageviews) for r in fold(read_session_days(spark, side)).collect())
    rows = sorted((r.started, r.ended, r.pageviews) for r in fold(session_days(read_events(spark, table))).collect())
    assert got == rows and [r[2] for r in got] == [3, 1]
    events = read_events(spark, table)
    visits = sorted(map(str, once(read_people_days(spark, people).visits, VISIT).collect()))
    assert visits == sorted(map(str, once(people_days(events).visits, VISIT).collect()))
    whole = Scope(events, Window(NOW - DAY_MS, NOW + DAY_MS))
    counted = replace(whole, distincts=distinct_days.read_distinct_days(spark, bits))
    for metric, n in (("visitors.unique", 1), ("sessions.total", 2)):
        assert scalars.scalar(counted, metric).collect() == scalars.scalar(whole, metric).collect()
        assert [r.value for r in scalars.scalar(counted, metric).collect()] == [n]
    stored = vitals.overview(replace(whole, vitals=read_vital_days(spark, values)))
    assert sorted(map(str, stored.collect())) == sorted(map(str, vitals.overview(whole).collect()))
    assert {(r.vital, r.value, r.samples) for r in stored.where("percentile = 50").collect()} == {("lcp", 1202.0, 2), ("cls", 0.25, 2)}


def test_a_late_event_joins_the_stored_visit(spark, tmp_path):
    table = str(tmp_path / "events")
    write_events(with_defaults(spark.createDataFrame([], EVENT_SCHEMA)), table)
    sites = sites_frame(spark)
    for start, times in ((0, [GAP, 4 * GAP]), (2, [GAP // 2, 2 * GAP, 3 * GAP]), (5, [0, 7 * GAP])):
        landed(tmp_path / f"in{start}", start, times)
        events, _ = ingest(read_requests(spark, str(tmp_path / f"in{start}")), sites, "s", stored=read_events(spark, table))
        write_events(spark.createDataFrame(events.collect(), events.schema), table)
    rows = {r.id: r.session_id for r in read_events(spark, table).collect()}
    # q4 closes the gap between the two visits stored first: new events take the earlier id, stored rows keep theirs.
    assert rows["q0"] == rows["q2"] == rows["q3"] == rows["q4"] == rows["q5"]
    assert rows["q1"] != rows["q0"] and rows["q6"] not in (rows["q0"], rows["q1"])


def test_a_late_event_joins_the_open_session_of_the_stream(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", sessions.ROCKSDB)
    (tmp_path / "in").mkdir()
    landed(tmp_path / "in", 0, [10 * MINUTE_MS, 5 * GAP])
    landed(tmp_path / "in", 2, [0, 11 * MINUTE_MS])
    stream = intake.enriched(stream_requests(spark, str(tmp_path / "in"), 1), sites_frame(spark), "s")
    got = {r.id: r.session_id for r in drain(sessions.assign_sessions(stream), "late", tmp_path / "c").collect()}
    assert got["q0"] == got["q2"] == got["q3"] != got["q1"]


def random_events(seed, visitors=3, n=400):
    """Events over twelve hours, in files that come in order but for some late rows; one visitor has a third of all."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        at = i * 12 * 60 * MINUTE_MS // n + rng.randrange(40 * MINUTE_MS) - (rng.randrange(3 * 60 * MINUTE_MS) if rng.random() < 0.15 else 0)
        rows.append({"id": f"e{i}", "ingest_seq": i, "ts": NOW + at, "site_id": "demo", "visitor_id": f"v{0 if i % 3 == 0 else rng.randrange(visitors * 4)}"})
    return rows


@pytest.mark.parametrize("seed,part", [(1, 3), (2, 50), (3, 100_000)])
def test_slices_name_the_visits_of_the_batch_job(spark, tmp_path, seed, part):
    """Late events included, whatever the parts a visitor's events are handed over in."""
    schema = "id string, ingest_seq long, ts long, site_id string, visitor_id string"
    rows = random_events(seed)
    for i in range(4):
        spark.createDataFrame(rows[i * 100 : (i + 1) * 100], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", sessions.ROCKSDB)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", part)
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        slices = drain(sessions.session_slices(stream), f"slices{seed}", tmp_path / "c")
        got = {r.id: (r.session_start, r.session_id) for r in sessions.named_by_slices(spark.createDataFrame(rows, schema), slices).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = sessionize(spark.createDataFrame(rows, schema), ["site_id", "visitor_id"]).withColumn("session_id", F.expr(SESSION_NAME))
    assert got == {r.id: (r.session_start, r.session_id) for r in want.collect()}


def test_state_of_old_slices_goes(spark, tmp_path):
    schema = "id string, ingest_seq long, ts long, site_id string, visitor_id string"
    (tmp_path / "in").mkdir()
    for day in range(4):
        spark.createDataFrame([(f"e{day}", day, NOW + day * 24 * 60 * MINUTE_MS, "demo", "v")], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", sessions.ROCKSDB)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    drain(sessions.session_slices(stream, lateness="1 hour"), "old", tmp_path / "c")
    held = spark.read.format("statestore").option("stateVarName", "slices").load(str(tmp_path / "c")).count()
    assert held <= 2


def test_only_the_folders_that_arrive_are_listed(spark, tmp_path):
    table = str(tmp_path / "events")
    rows = [{**COLUMN_DEFAULTS, "lat": None, "lon": None, "id": f"{s}{d}", "ingest_seq": d, "site_id": s, "ts": d * DAY_MS, "type": "event"} for s in ("a", "b,{x}=1", "c") for d in range(5)]
    events = spark.createDataFrame(rows, EVENT_SCHEMA)
    assert read_near(spark, table, events).count() == 0 and read_near(spark, table, events.limit(0)).count() == 0
    write_events(events, table)
    near = read_near(spark, table, events.where("site_id LIKE 'b%' AND ts = 2 * 86400000"), 1)
    assert sorted(r.id for r in near.collect()) == ["b,{x}=11", "b,{x}=12", "b,{x}=13"]
    assert len(near.inputFiles()) == 3
    append_events(events, table)
    assert read_events(spark, table).count() == 15


def test_the_earliest_arrival_is_kept(spark):
    rows = spark.createDataFrame([("a", 5, 1), ("a", 1, 2), ("b", 7, 3)], "id string, ingest_seq long, ts long")
    kept = new_events(rows, rows.where("id = 'b'")).collect()
    assert [(r.id, r.ingest_seq) for r in kept] == [("a", 1)]


def test_batches(spark):
    raw = raw_frame(
        spark,
        [
            ({"events": [VIEW, VIEW | {"url": ""}, VIEW]}, {}), ({"events": []}, {}), ({"events": [VIEW] * 51}, {}), ("[1]", {}),
            ({"events": [VIEW, VIEW | {"site": "quiet"}]}, {}), ({"events": [{"url": "/"}]}, {}), ({"events": [VIEW, 5]}, {}), ({"x": 1}, {}),
        ],
    )
    single, refused = open_batches(raw)
    assert {r.request_id: r.reject_reason for r in refused.collect()} == {
        "r1": "events_missing", "r2": "batch_too_large", "r3": "body_not_object", "r4": "batch_mixed_sites",
        "r5": "site_missing", "r6": "batch_mixed_sites", "r7": "events_missing",
    }
    events, bad = ingest(single, sites_frame(spark), "s")
    assert sorted(r.id for r in events.collect()) == ["r0#0", "r0#2"]
    answer = batch_answers(single, bad).first()
    assert (answer.batch_id, answer.accepted, [tuple(r) for r in answer.rejected]) == ("r0", 2, [(1, "url_missing")])
