"""Vitals from stored value counts, beside those computed from the events."""

import datetime as dt
import pathlib
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from footlog.model import COLUMN_DEFAULTS, DAY_MS, EVENT_SCHEMA, HOUR_MS, Scope, Window
from footlog.operators import breakdowns, vitals
from footlog.operators.filters import Filter
from footlog.sources.event_table import append_events, read_events, remove_batch, write_events
from footlog.sources.vital_days import read_vital_days, usable, vital_days, write_vital_days

DAY0 = 1_704_067_200_000
KINDS = [{}, {}, {"bot_score": 7}, {"agent_trust": "verified"}]


def history(days: int = 8) -> list[dict]:
    """Vitals with ties, fractions that round twice, missing and unreadable ones."""
    rows = []
    for number in range(700):
        day, kind = number % days, KINDS[(number // 3) % 4]
        parts = [] if number % 5 == 0 else [f'"lcp":{1000 + number % 37}.4996']
        parts += [f'"inp":{40 + number % 9}'] if number % 4 else []
        parts += [f'"cls":0.{number % 97:03d}49996', '"fcp":"soon"']
        props = "{" + ",".join(parts) + "}" if number % 50 else "{broken"
        given = {"id": f"e{number}", "ingest_seq": number, "site_id": "ab"[number % 2], "visitor_id": f"v{number % 60}", "session_id": f"s{number % 90}"}
        place = {"path": f"/{number % 6}", "device": ["mobile", "desktop", ""][number % 3], "ts": DAY0 + day * DAY_MS + (number % 24) * HOUR_MS}
        rows.append({**COLUMN_DEFAULTS, "lat": None, "lon": None, "type": "event", "name": "web_vitals", "props": props, **given, **place, **kind})
    return rows


def stored_in(spark, folder, rows, parts: int = 3) -> tuple[str, str]:
    table, side = str(folder / "events"), str(folder / "vitals")
    write_events(rows.limit(0), table)
    write_vital_days(vital_days(rows.limit(0)), side)
    for part in range(parts):
        append_events(rows.where(F.col("ingest_seq") % parts == part), table, vitals=side, batch=f"part{part}")
    return table, side


def values(frame) -> list:
    return sorted((tuple(r) for r in frame.select(*sorted(frame.columns)).collect()), key=str)


REPORTS = {
    "overview": vitals.overview,
    "pages": vitals.by_dimension,
    "devices": lambda scope: vitals.by_dimension(scope, "device", 90, None),
    "days": lambda scope: vitals.over_time(scope, DAY_MS),
    "hours": lambda scope: vitals.over_time(scope, HOUR_MS),
    "bundle": vitals.bundle_p75,
    "slow": breakdowns.slow_pages,
}
WINDOWS = {
    "whole days": Window(DAY0 + 4 * DAY_MS, DAY0 + 6 * DAY_MS),
    "cut days": Window(DAY0 + 4 * DAY_MS + 5 * HOUR_MS, DAY0 + 6 * DAY_MS + 13 * HOUR_MS),
    "within a day": Window(DAY0 + 3 * DAY_MS + 2 * HOUR_MS, DAY0 + 3 * DAY_MS + 11 * HOUR_MS),
    "without events": Window(DAY0 - 3 * DAY_MS, DAY0 - DAY_MS),
}


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    return stored_in(spark, tmp_path_factory.mktemp("vitals"), spark.createDataFrame(history(), EVENT_SCHEMA))


@pytest.mark.parametrize("window, strict", [*((w, False) for w in WINDOWS), ("cut days", True)])
def test_reports_are_those_of_the_events(spark, stored, window, strict):
    plain = Scope(read_events(spark, stored[0]), WINDOWS[window], strict_bots=strict)
    counts = replace(plain, vitals=read_vital_days(spark, stored[1]))
    # All reports where ends of the window cut days, elsewhere those that differ in what they keep.
    for name in REPORTS if window == "cut days" and not strict else ("overview", "bundle"):
        assert values(REPORTS[name](counts)) == values(REPORTS[name](plain)), name
    if strict:
        assert values(vitals.bundle_p75(replace(counts, site="a"))) == values(vitals.bundle_p75(replace(plain, site="a")))
    assert not usable(replace(counts, filters=(Filter("path", "/1"),)))


def test_no_event_is_read_of_whole_days(spark, tmp_path):
    table, side = stored_in(spark, tmp_path, spark.createDataFrame(history(), EVENT_SCHEMA), 1)
    plain = Scope(read_events(spark, table), WINDOWS["whole days"])
    reports = [r for name, r in REPORTS.items() if name != "hours"]
    want = [values(r(plain)) for r in reports]
    for folder in pathlib.Path(table).glob("site_id=*/day=*"):
        (folder / "part-spoiled.parquet").write_bytes(b"not parquet at all")
    counts = Scope(read_events(spark, table), WINDOWS["whole days"], vitals=read_vital_days(spark, side))
    assert [values(r(counts)) for r in reports] == want


def test_an_append_run_again_counts_once_and_removal_rebuilds(spark, tmp_path):
    rows = spark.createDataFrame(history(), EVENT_SCHEMA)
    table, side = stored_in(spark, tmp_path, rows, 1)
    write_vital_days(vital_days(rows, "part0"), side)
    scope = Scope(read_events(spark, table), WINDOWS["cut days"])
    assert values(vitals.overview(replace(scope, vitals=read_vital_days(spark, side)))) == values(vitals.overview(scope))
    base = {**history()[1], "site_id": "a", "props": '{"lcp":9,"_import":"b"}'}
    alone = 40  # a day on which the site has nothing else
    imported = [{**base, "id": f"i{n}", "ingest_seq": 2000 + n, "ts": DAY0 + (4 if n % 2 else alone) * DAY_MS} for n in range(6)]
    append_events(spark.createDataFrame(imported, EVENT_SCHEMA), table, vitals=side)
    whole = Window(DAY0, DAY0 + 50 * DAY_MS)

    def both() -> list:
        plain = Scope(read_events(spark, table), whole)
        return [values(vitals.overview(s)) for s in (plain, replace(plain, vitals=read_vital_days(spark, side)))]

    with_import = both()
    assert with_import[0] == with_import[1]
    assert remove_batch(spark, table, str(tmp_path / "staging"), "a", "b", vitals=side) == 6
    without = both()
    assert without[0] == without[1] != with_import[0]
    left = read_vital_days(spark, side).where(F.col("day") == dt.date(2024, 1, 1) + dt.timedelta(days=alone))
    assert left.count() == 0


def test_empty_tables(spark, tmp_path):
    table, side = stored_in(spark, tmp_path, spark.createDataFrame([], EVENT_SCHEMA), 1)
    scope = Scope(read_events(spark, table), WINDOWS["cut days"], vitals=read_vital_days(spark, side))
    assert [values(report(scope)) for report in REPORTS.values()] == [[]] * len(REPORTS)
    assert values(vitals.bundle_p75(replace(scope, site="a"))) == [(None, None, None, "a")]
