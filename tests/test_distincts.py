"""Exact distinct counts from a dense dictionary of ids and day bitmaps, beside counts over the events."""

import datetime as dt
import pathlib
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from footlog.model import COLUMN_DEFAULTS, DAY_MS, EVENT_SCHEMA, HOUR_MS, Scope, Window
from footlog.operators import scalars
from footlog.operators.filters import Filter
from footlog.plans import bundle
from footlog.sources import distinct_days
from footlog.sources.distinct_days import METRICS, append_distinct_days, create, ids_met, numbers_for, read_distinct_days
from footlog.sources.event_table import append_events, read_events, remove_batch, write_events

DAY0 = 1_704_067_200_000
KINDS = [{}, {}, {"bot_score": 7}, {"agent_trust": "verified"}, {"bot_kind": "crawler"}]


def history(days: int = 8) -> list[dict]:
    """Visitors that come back on other days and as other audiences; site c is met by agents and crawlers only."""
    rows = []
    for number in range(900):
        day, visitor = number % days, f"v{(number * number) % 97}"
        site, kind = ("c", KINDS[3 + number % 2]) if number % 9 == 0 else ("ab"[number % 2], KINDS[(number // 7) % 5])
        ts = DAY0 + day * DAY_MS + (number % 24) * HOUR_MS
        given = {"id": f"e{number}", "ingest_seq": number, "site_id": site, "visitor_id": visitor, "session_id": f"{visitor}-{number % 11}", "ts": ts}
        rows.append({**COLUMN_DEFAULTS, "lat": None, "lon": None, "type": "pageview", "name": "pageview", **given, **kind})
    return rows


def stored_in(spark, folder, rows, parts: int = 3) -> tuple[str, str]:
    table, side = str(folder / "events"), str(folder / "distincts")
    write_events(rows.limit(0), table)
    create(spark, side)
    for part in range(parts):
        append_events(rows.where(F.col("ingest_seq") % parts == part), table, distincts=side)
    return table, side


def values(frame) -> list:
    return sorted(tuple(r) for r in frame.collect())


WINDOWS = {
    "whole days": Window(DAY0 + 4 * DAY_MS, DAY0 + 6 * DAY_MS),
    "cut days": Window(DAY0 + 4 * DAY_MS + 5 * HOUR_MS, DAY0 + 6 * DAY_MS + 13 * HOUR_MS),
    "within a day": Window(DAY0 + 3 * DAY_MS + 2 * HOUR_MS, DAY0 + 3 * DAY_MS + 11 * HOUR_MS),
    "without events": Window(DAY0 - 3 * DAY_MS, DAY0 - DAY_MS),
}


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    return stored_in(spark, tmp_path_factory.mktemp("distincts"), spark.createDataFrame(history(), EVENT_SCHEMA))


@pytest.mark.parametrize("window, strict", [*((w, False) for w in WINDOWS), ("cut days", True)])
def test_counts_are_those_of_the_events(spark, stored, window, strict):
    plain = Scope(read_events(spark, stored[0]), WINDOWS[window], strict_bots=strict)
    bits = replace(plain, distincts=read_distinct_days(spark, stored[1]))
    for site in (None, "a", "nowhere"):
        one, other = replace(plain, site=site), replace(bits, site=site)
        want = values(bundle.scalar_table(one, plain.window.previous(), METRICS))
        assert values(bundle.scalar_table(other, plain.window.previous(), METRICS)) == want
        for metric in METRICS:
            assert values(scalars.scalar(other, metric)) == values(scalars.scalar(one, metric)), (site, metric)
    filtered = (Filter("path", "/none"),)  # filtered counts are not the bitmaps' to make
    assert values(scalars.scalar(replace(bits, filters=filtered), "visitors.unique")) == []


def test_no_event_is_read_of_days_no_window_cuts(spark, tmp_path):
    table, side = stored_in(spark, tmp_path, spark.createDataFrame(history(), EVENT_SCHEMA), 1)
    window = WINDOWS["cut days"]
    plain = Scope(read_events(spark, table), window)
    want = values(bundle.scalar_table(plain, window.previous(), METRICS))
    cut = {m // DAY_MS for w in (window, window.previous()) for m in (w.from_ms, w.to_ms)}
    for folder in pathlib.Path(table).glob("site_id=*/day=*"):
        if (dt.date.fromisoformat(folder.name[4:]) - dt.date(1970, 1, 1)).days not in cut:
            (folder / "part-spoiled.parquet").write_bytes(b"not parquet at all")
    bits = Scope(read_events(spark, table), window, distincts=read_distinct_days(spark, side))
    assert values(bundle.scalar_table(bits, window.previous(), METRICS)) == want


def test_numbers_are_dense_and_appends_may_be_repeated(spark, tmp_path):
    rows = spark.createDataFrame(history(), EVENT_SCHEMA)
    table, side = stored_in(spark, tmp_path, rows)
    keys = read_distinct_days(spark, side).keys
    for group in keys.groupBy("site_id", "kind").agg(F.count("*").alias("n"), F.countDistinct("key", "number").alias("k"), F.max("number").alias("m")).collect():
        assert group.n == group.k == group.m
    before, scope = values(keys), Scope(read_events(spark, table), WINDOWS["whole days"])
    want = values(scalars.scalar(scope, "visitors.unique"))
    append_distinct_days(rows, side)  # the same events once more
    assert values(read_distinct_days(spark, side).keys) == before
    assert values(scalars.scalar(replace(scope, distincts=read_distinct_days(spark, side)), "visitors.unique")) == want


def test_numbers_beyond_one_bucket(spark):
    ids = spark.range(70_000).select(F.lit("a").alias("site_id"), F.lit("visitors").alias("kind"), F.concat(F.lit("v"), "id").alias("key"))
    known = numbers_for(ids.where("key < 'v3'"), spark.createDataFrame([], "site_id string, kind string, key string, number long")).persist()
    more = numbers_for(ids, known)
    both = known.unionByName(more).agg(F.count("*").alias("n"), F.countDistinct("number").alias("d"), F.countDistinct("key").alias("k"), F.max("number").alias("m")).first()
    assert (both.n, both.d, both.k, both.m) == (70_000,) * 4
    assert more.agg(F.min("number")).first()[0] == known.count() + 1
    met = ids.withColumn("who", F.lit("strict")).withColumn("day", F.lit(dt.date(2024, 1, 1))).withColumn("at", F.lit(DAY0))
    made = distinct_days.bitmaps(met, known.unionByName(more)).agg(F.count("*").alias("n"), F.sum(F.bitmap_count("bits")).alias("b")).first()
    assert (made.n, made.b) == (3, 70_000)
    known.unpersist()


def test_removal_rebuilds_the_days(spark, tmp_path):
    table, side = stored_in(spark, tmp_path, spark.createDataFrame(history(), EVENT_SCHEMA), 1)
    base = {**history(1)[1], "site_id": "a", "props": '{"_import":"b"}'}
    imported = [{**base, "id": f"i{n}", "ingest_seq": 2000 + n, "visitor_id": f"new{n}", "ts": DAY0 + (4 + 20 * (n % 2)) * DAY_MS} for n in range(6)]
    append_events(spark.createDataFrame(imported, EVENT_SCHEMA), table, distincts=side)
    window = Window(DAY0, DAY0 + 30 * DAY_MS)

    def both() -> tuple:
        plain = Scope(read_events(spark, table), window, site="a")
        return tuple(scalars.scalar(s, "visitors.unique").first().value for s in (plain, replace(plain, distincts=read_distinct_days(spark, side))))

    with_import = both()
    assert with_import[0] == with_import[1]
    assert remove_batch(spark, table, str(tmp_path / "staging"), "a", "b", distincts=side) == 6
    assert both() == (with_import[0] - 6,) * 2


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], EVENT_SCHEMA)
    table, side = stored_in(spark, tmp_path, none, 1)
    scope = Scope(read_events(spark, table), WINDOWS["cut days"], distincts=read_distinct_days(spark, side))
    assert values(scalars.scalar(scope, "visitors.unique")) == [] and ids_met(none).count() == 0
    assert values(scalars.scalar(replace(scope, site="a"), "sessions.total")) == [("a", 0.0)]
