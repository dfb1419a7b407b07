"""The side table of sessions: whole sessions of any length without reading all days, kept up by appends and removals."""

import datetime as dt
import pathlib

import pytest
from pyspark.sql import functions as F

from footlog.model import COLUMN_DEFAULTS, DAY_MS, EVENT_SCHEMA, HOUR_MS, Scope, Window
from footlog.operators import breakdowns, explore, revenue
from footlog.operators.filters import Filter
from footlog.sources.event_table import append_events, read_events, remove_batch, with_defaults, write_events
from footlog.sources.session_days import fold, read_session_days, rebuild, session_days, write_session_days

DAY0 = 1_704_067_200_000


def event(number: int, session: str, ts: int, name: str = "pageview", site: str = "a", **more) -> dict:
    given = {"id": f"e{number}", "ingest_seq": number, "site_id": site, "session_id": session, "visitor_id": f"v-{session}", "ts": ts, "name": name}
    return {**COLUMN_DEFAULTS, "lat": None, "lon": None, "type": "pageview" if name == "pageview" else "event", **given, **more}


def days_of_visits() -> list[dict]:
    """One visit a day for 20 days, and one that runs from day 3 to day 9, with its first and last page outside any window here."""
    rows = []
    for day in range(20):
        for hour in range(3):
            rows.append(event(len(rows), f"s{day}", DAY0 + day * DAY_MS + hour * HOUR_MS, path=f"/{hour}", channel="search" if hour else "ai"))
    for day in range(3, 10):
        at, channel = DAY0 + day * DAY_MS + 5 * HOUR_MS, "email" if day == 3 else "direct"
        rows.append(event(len(rows), "long", at, path=f"/long{day}", channel=channel))
        if day == 4:
            rows.append(event(len(rows), "long", at + 1, "signup", channel=channel))
        if day == 6:
            rows.append(event(len(rows), "long", at + 1, "purchase", channel=channel, props='{"revenue":7,"currency":"USD"}'))
    return rows


@pytest.fixture()
def stored(spark, tmp_path):
    rows = spark.createDataFrame(days_of_visits(), EVENT_SCHEMA)
    table, side = str(tmp_path / "events"), str(tmp_path / "sessions")
    write_events(rows.limit(0), table)
    for part in range(3):  # one visit's events come in several appends
        append_events(rows.where(F.col("ingest_seq") % 3 == part), table, side, f"part{part}")
    return table, side


def spoil(table: str, days: list[int]) -> None:
    """Files that no scan can read, on days that no scan should open."""
    for day in days:
        folder = pathlib.Path(table) / "site_id=a" / f"day={dt.date.fromordinal(dt.date(2024, 1, 1).toordinal() + day)}"
        (folder / "part-spoiled.parquet").write_bytes(b"not parquet at all")


def scopes(spark, stored, window, filters=()):
    events = read_events(spark, stored[0])
    return Scope(events, window, filters=filters), Scope(events, window, filters=filters, sessions=read_session_days(spark, stored[1]))


SIXTH = Window(DAY0 + 6 * DAY_MS, DAY0 + 7 * DAY_MS)
REPORTS = {
    "f01": (explore.session_rows, (), ()),
    "f01 entry": (explore.session_rows, (Filter("entry_page", "/long3"),), ()),
    "f01 event": (explore.session_rows, (Filter("event", "signup"),), ()),
    "d04": (breakdowns.breakdown, (Filter("event", "signup"),), ("pages.top",)),
    "d05": (breakdowns.breakdown, (Filter("entry_page", "/long3"), Filter("exit_page", "/long9")), ("pages.top",)),
    "f40": (revenue.breakdown, (), ("channel",)),
}


@pytest.mark.parametrize("name", REPORTS)
def test_whole_sessions_from_their_own_days(spark, stored, name):
    operator, filters, more = REPORTS[name]
    want = sorted(map(str, operator(scopes(spark, stored, SIXTH, filters)[0], *more).collect()))
    assert want and any("long" in w or "email" in w for w in want)
    spoil(stored[0], [0, 1, 2, 10, 11, 19])  # outside the days of the long visit
    plain, pruned = scopes(spark, stored, SIXTH, filters)
    assert sorted(map(str, operator(pruned, *more).collect())) == want
    with pytest.raises(Exception, match="(?i)parquet"):
        operator(plain, *more).collect()


def test_the_long_visit_is_told_whole(spark, stored):
    row = explore.session_rows(scopes(spark, stored, SIXTH)[1]).where("session_id = 'long'").first()
    assert (row.started, row.ended) == (DAY0 + 3 * DAY_MS + 5 * HOUR_MS, DAY0 + 9 * DAY_MS + 5 * HOUR_MS)
    assert (row.pageviews, row.events, row.entry_page, row.exit_page, row.channel) == (7, 2, "/long3", "/long9", "email")


def facts(rows):
    return sorted(map(str, fold(rows).drop("batch").collect()))


def test_appends_repeats_and_removal_agree_with_the_events(spark, stored, tmp_path):
    table, side = stored
    again = spark.createDataFrame(days_of_visits(), EVENT_SCHEMA)
    append_events(again, table, side, "part9")  # nothing new
    assert facts(read_session_days(spark, side)) == facts(session_days(read_events(spark, table)))
    # The side table was written, the events were not: the append is run again under its name.
    late = spark.createDataFrame([event(900, "long", DAY0 + 12 * DAY_MS, path="/late"), event(901, "s1", DAY0 + DAY_MS + 9, "login")], EVENT_SCHEMA)
    write_session_days(session_days(late, "late"), side)
    append_events(late, table, side, "late")
    assert facts(read_session_days(spark, side)) == facts(session_days(read_events(spark, table)))
    imported = [event(950 + i, f"i{i % 2}", DAY0 + (25 + i) * DAY_MS, props='{"_import":"b1"}') for i in range(3)]
    imported.append(event(960, "s2", DAY0 + 2 * DAY_MS + 7, props='{"_import":"b1"}'))
    append_events(spark.createDataFrame(imported, EVENT_SCHEMA), table, side)
    assert remove_batch(spark, table, str(tmp_path / "staging"), "a", "b1", side) == 4
    assert facts(read_session_days(spark, side)) == facts(session_days(read_events(spark, table)))
    assert not read_session_days(spark, side).where("session_id LIKE 'i%'").count()
    many = read_session_days(spark, side).count()
    rebuild(read_events(spark, table), side, "a", [r.day for r in read_events(spark, table).select("day").distinct().collect()])
    assert facts(read_session_days(spark, side)) == facts(session_days(read_events(spark, table))) and read_session_days(spark, side).count() <= many


def test_empty_side_table(spark, tmp_path):
    none = spark.createDataFrame([], EVENT_SCHEMA)
    write_events(none, str(tmp_path / "e"))
    write_session_days(session_days(none), str(tmp_path / "s"))
    scope = Scope(read_events(spark, str(tmp_path / "e")), SIXTH, sessions=read_session_days(spark, str(tmp_path / "s")), filters=(Filter("event", "x"),))
    assert explore.session_rows(scope).count() == 0 and with_defaults(none).count() == 0
