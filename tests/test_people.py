"""The ledger of people: reports on people over all history without reading the days of events, kept up by appends and removals."""

import datetime as dt
import pathlib
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from footlog.model import COLUMN_DEFAULTS, DAY_MS, EVENT_SCHEMA, HOUR_MS, Scope, Window
from footlog.operators import lifecycle, people, portfolio
from footlog.sources.event_table import append_events, read_events, remove_batch, write_events
from footlog.sources.people_days import ACTION, VISIT, once, people_days, read_people_days, rebuild, write_people_days

DAY0 = 1_704_067_200_000
NAMES = ["pageview", "signup", "order", "share", "plan"]


def event(number: int, person: str, ts: int, name: str, site: str = "a", **more) -> dict:
    given = {"id": f"e{number}", "ingest_seq": number, "site_id": site, "visitor_id": f"v{person}", "identity": person, "ts": ts, "name": name}
    visit = f"{person}-{ts // (6 * HOUR_MS)}" if number % 5 else "shared"
    return {**COLUMN_DEFAULTS, "lat": None, "lon": None, "type": "pageview" if name == "pageview" else "event", "session_id": visit, **given, **more}


def history(days: int = 12, seed: int = 3) -> list[dict]:
    """People, unnamed visitors, suspects and agents over some days, plans and names that need escaping among them; ties in time."""
    rng, rows = random.Random(seed), []
    for number in range(600):
        person = rng.choice(["", "p'1", "ü|2", "p3", "p4", "p5", "p6", "p7", "hot", "hot", "hot"])
        first, last = (0, days) if person in ("", "hot") else sorted((rng.randrange(days), days - rng.randrange(1, 3)))
        day = rng.randrange(min(first, last), days)
        name = rng.choice(NAMES)
        more = {"props": f'{{"plan":"{rng.choice(["free", "pro", "team", "cancelled"])}"}}'} if name == "plan" else {}
        more |= rng.choice([{}, {}, {}, {"bot_score": 7}, {"agent_trust": "verified"}, {"bot_kind": "crawler"}])
        rows.append(event(number, person, DAY0 + day * DAY_MS + rng.randrange(24) * HOUR_MS, name, rng.choice("ab"), **more))
    # Someone new every half day, who comes once.
    return rows + [event(700 + n, f"once{n}", DAY0 + n * DAY_MS // 2 + 4 * HOUR_MS, "order") for n in range(2 * days)]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("ledger")
    rows = spark.createDataFrame(history(), EVENT_SCHEMA)
    table, side = str(folder / "events"), str(folder / "people")
    write_events(rows.limit(0), table)
    for part in range(2):
        append_events(rows.where(F.col("ingest_seq") % 2 == part), table, batch=f"part{part}", people=side)
    return table, side


WINDOWS = {
    "whole days": Window(DAY0 + 6 * DAY_MS, DAY0 + 9 * DAY_MS),
    "cut days": Window(DAY0 + 6 * DAY_MS + 5 * HOUR_MS, DAY0 + 8 * DAY_MS + 13 * HOUR_MS),
    "within a day": Window(DAY0 + 7 * DAY_MS + 3 * HOUR_MS, DAY0 + 7 * DAY_MS + 9 * HOUR_MS),
    "ten days": Window(DAY0 + DAY_MS, DAY0 + 11 * DAY_MS + 7 * HOUR_MS),
    "before all": Window(DAY0 - 3 * DAY_MS, DAY0 - DAY_MS - 1),
}
REPORTS = {
    "f16": lifecycle.accounting,
    "f17": lifecycle.one_and_done,
    "f19": lifecycle.plans,
    "f20": lifecycle.plan_changes,
    "f21": lambda scope: lifecycle.new_series(scope, HOUR_MS),
    "f23": lifecycle.data_from,
    "f24": lambda scope: people.list_people(scope, limit=None),
    "f25": lambda scope: people.summary(scope, scope.window.to_ms),
    "f26": people.top_actions,
    "f27": people.by_plan,
    "f28 days": lambda scope: people.actions_by_day(scope, days=2),
    "f28 visits": people.latest_visits,
    "f31": portfolio.people,
    "f32 moves": portfolio.moves,
    "f32 paying": portfolio.paying,
}


def rows_of(frame) -> list[str]:
    return sorted(str(sorted(r.asDict().items())) for r in frame.collect())


OF_WINDOWS = ["f16", "f17", "f19", "f20", "f21"]  # the others look at all history, or are made of these


@pytest.mark.parametrize(
    "window, strict, names",
    [("cut days", False, list(REPORTS)), ("cut days", True, list(REPORTS)), *((w, False, OF_WINDOWS) for w in WINDOWS if w != "cut days")],
)
def test_the_ledger_agrees_with_the_events(spark, stored, window, strict, names):
    plain = Scope(read_events(spark, stored[0]), WINDOWS[window], strict_bots=strict)
    ledger = replace(plain, people=read_people_days(spark, stored[1]))
    for name in names:
        want = rows_of(REPORTS[name](plain))
        assert rows_of(REPORTS[name](ledger)) == want, name
        # A week must pass before a person can be one who did not come back.
        if window in ("cut days", "ten days"):
            assert bool(want) == (name != "f17" or window == "ten days"), name
    one = replace(ledger, site="a"), replace(plain, site="a")
    assert rows_of(lifecycle.accounting(one[0])) == rows_of(lifecycle.accounting(one[1]))


def test_no_event_day_outside_the_window_and_the_cut_days_is_read(spark, tmp_path):
    table, side = str(tmp_path / "events"), str(tmp_path / "people")
    rows = spark.createDataFrame(history(), EVENT_SCHEMA)
    write_events(rows, table)
    write_people_days(people_days(rows), side)
    window = WINDOWS["cut days"]  # cuts days 6 and 8; the window before it begins on day 3
    plain = Scope(read_events(spark, table), window)
    want = {name: rows_of(report(plain)) for name, report in REPORTS.items()}
    for folder in pathlib.Path(table).glob("site_id=*/day=*"):
        if (dt.date.fromisoformat(folder.name[4:]) - dt.date(2024, 1, 1)).days not in (3, 4, 6, 7, 8):
            (folder / "part-spoiled.parquet").write_bytes(b"not parquet at all")
    ledger = Scope(read_events(spark, table), window, people=read_people_days(spark, side))
    for name, report in REPORTS.items():
        assert rows_of(report(ledger)) == want[name], name
    with pytest.raises(Exception, match="(?i)parquet"):
        lifecycle.accounting(Scope(read_events(spark, table), window)).collect()


def facts(ledger):
    return rows_of(once(ledger.visits, VISIT)), rows_of(once(ledger.actions, ACTION))


def folded(ledger):
    """What the ledger says of each visit and action, however many appends it came in."""
    visits = once(ledger.visits, VISIT).groupBy(*VISIT).agg(
        F.min("first_ts"), F.max("last_ts"), F.sum("pages"), F.sum("actions"), F.max("planned").cast("string")
    )
    return rows_of(visits), rows_of(once(ledger.actions, ACTION).groupBy(*ACTION).agg(F.sum("n")))


def test_repeated_appends_removal_and_rebuilding(spark, tmp_path):
    table, side = str(tmp_path / "events"), str(tmp_path / "people")
    rows = spark.createDataFrame(history(), EVENT_SCHEMA)
    write_events(rows.limit(0), table)
    write_people_days(people_days(rows, "first"), side)  # an append that failed between its two writes
    append_events(rows, table, batch="first", people=side)
    append_events(rows, table, batch="second", people=side)  # nothing new

    def agrees() -> bool:
        return folded(read_people_days(spark, side)) == folded(people_days(read_events(spark, table)))

    assert agrees()
    imported = [event(900 + n, f"new{n % 2}", DAY0 + (5 + 20 * (n % 2)) * DAY_MS + n, "order", props='{"_import":"b"}') for n in range(5)]
    append_events(spark.createDataFrame(imported, EVENT_SCHEMA), table, people=side)
    assert agrees() and read_people_days(spark, side).visits.where("identity = 'new1'").count()
    assert remove_batch(spark, table, str(tmp_path / "staging"), "a", "b", people=side) == 5
    assert agrees() and not read_people_days(spark, side).visits.where("identity LIKE 'new%'").count()
    rebuild(read_events(spark, table), side, "a", [r.day for r in read_events(spark, table).select("day").distinct().collect()])
    assert agrees()
    held = read_people_days(spark, side).visits.where("site_id = 'a'")
    assert held.count() == once(held, VISIT).count() == people_days(read_events(spark, table)).visits.where("site_id = 'a'").count()


def test_an_empty_ledger(spark, tmp_path):
    none = spark.createDataFrame([], EVENT_SCHEMA)
    write_events(none, str(tmp_path / "e"))
    write_people_days(people_days(none), str(tmp_path / "p"))
    scope = Scope(read_events(spark, str(tmp_path / "e")), WINDOWS["cut days"], people=read_people_days(spark, str(tmp_path / "p")))
    assert all(not report(scope).collect() for report in REPORTS.values())
    named = lifecycle.accounting(replace(scope, site="a")).first()
    assert (named.site_id, named.known) == ("a", 0)
