"""The event table, time windows, audiences and the scope every metric reads through."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field, replace
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

if TYPE_CHECKING:
    from footlog.sources.distinct_days import DistinctDays
    from footlog.sources.people_days import Ledger

SECOND_MS = 1_000
MINUTE_MS = 60 * SECOND_MS
HOUR_MS = 60 * MINUTE_MS
DAY_MS = 24 * HOUR_MS
WEEK_MS = 7 * DAY_MS
SESSION_GAP_MS = 30 * MINUTE_MS
LIVE_MS = 5 * MINUTE_MS

# The columns of the event table. Text is '' when unknown, never null.
_TEXT_COLUMNS = (
    "id site_id visitor_id session_id type name path query title hostname referrer referrer_host "
    "channel source utm_source utm_medium utm_campaign utm_term utm_content device os browser screen "
    "lang country region region_name city tag identity bot_kind bot_name agent_trust agent_signer "
    "bot_signals props"
).split()
COLUMN_DEFAULTS = {name: "" for name in _TEXT_COLUMNS} | {"agent_trust": "human", "props": "{}", "bot_score": 0}

EVENT_SCHEMA = T.StructType(
    [T.StructField(name, T.StringType(), False) for name in _TEXT_COLUMNS]
    + [
        T.StructField("ts", T.LongType(), False),
        T.StructField("ingest_seq", T.LongType(), True),
        T.StructField("bot_score", T.IntegerType(), False),
        T.StructField("lat", T.DoubleType(), True),
        T.StructField("lon", T.DoubleType(), True),
    ]
)

SUSPECT_SCORE = 5

# Who a number is about. Every operator takes its people predicate from here.
AUDIENCES = {
    "human": "bot_kind = '' AND agent_trust = 'human'",
    "human_strict": f"bot_kind = '' AND agent_trust = 'human' AND bot_score < {SUSPECT_SCORE}",
    "agent": "bot_kind = '' AND agent_trust = 'verified'",
    "unbotted": "bot_kind = ''",
    "everyone": "true",
}


def audience(name: str = "human") -> Column:
    return F.expr(AUDIENCES[name])


def is_pageview() -> Column:
    return F.col("type") == "pageview"


def is_event() -> Column:
    return F.col("type") == "event"


# Events that trackers send by themselves, which are not actions.
NON_ACTIONS = [
    "pageview", "identify", "signup", "login", "logout", "plan", "renewal", "app_open", "scroll", "web_vitals",
    "error", "form_submit", "form_abandon", "outbound_click", "file_download", "rage_click", "cta_click",
]


def is_action() -> Column:
    return is_event() & ~F.col("name").isin(NON_ACTIONS)


class WindowError(ValueError):
    """A time range that cannot be measured as asked."""


@dataclass(frozen=True)
class Window:
    """Half-open time range in epoch milliseconds, UTC."""

    from_ms: int
    to_ms: int

    def __post_init__(self) -> None:
        if self.from_ms >= self.to_ms:
            raise WindowError("a window must end after it starts")

    @classmethod
    def last_days(cls, days: int, now_ms: int) -> Window:
        """Look back so many days, at least one, from ``now_ms``."""
        if days < 1:
            raise WindowError("a window looks back at least one day")
        return cls(now_ms - round(days) * DAY_MS, now_ms)

    @classmethod
    def dates(cls, first: str, last: str, now_ms: int | None = None) -> Window:
        """Inclusive UTC dates, at most 366 days, never past ``now_ms``."""
        try:
            start, stop = (dt.datetime.strptime(d, "%Y-%m-%d").replace(tzinfo=dt.UTC) for d in (first, last))
        except ValueError as exc:
            raise WindowError("both ends must be dates like 2026-09-30") from exc
        from_ms, to_ms = int(start.timestamp()) * 1000, int(stop.timestamp()) * 1000 + DAY_MS
        if from_ms >= to_ms:
            raise WindowError("the first date must not be after the last")
        if to_ms - from_ms > 366 * DAY_MS:
            raise WindowError("a range can be at most a year")
        return cls(from_ms, to_ms if now_ms is None else min(to_ms, now_ms))

    @property
    def span(self) -> int:
        return self.to_ms - self.from_ms

    def previous(self) -> Window:
        """The window of equal length directly before this one."""
        return Window(self.from_ms - self.span, self.from_ms)

    def joined(self, earlier: Window) -> Window:
        """The smallest window holding both."""
        return Window(min(self.from_ms, earlier.from_ms), max(self.to_ms, earlier.to_ms))

    def contains(self, ts: Column | str = "ts") -> Column:
        ts = F.col(ts) if isinstance(ts, str) else ts
        return (ts >= F.lit(self.from_ms)) & (ts < F.lit(self.to_ms))


@dataclass(frozen=True)
class Scope:
    """What a metric reads: an event table, a window, optionally one site, filters and the strict audience.

    Without ``site`` every result is computed for all sites at once, one group per ``site_id``, so one
    scan answers every tenant. With ``site`` the scan prunes to its partitions. With ``sessions``, the side table of
    session days, whole sessions are read from it, or from the days on which the window's sessions have events. With
    ``people``, the ledger of people, reports on people read no event day outside the window. With ``distincts``, unfiltered
    counts of visitors and sessions are made of the days' bitmaps, and with ``vitals``, unfiltered vitals of stored value counts.
    """

    events: DataFrame
    window: Window
    site: str | None = None
    filters: tuple = field(default_factory=tuple)
    strict_bots: bool = False
    sessions: DataFrame | None = None
    people: Ledger | None = None
    distincts: DistinctDays | None = None
    vitals: DataFrame | None = None

    def at(self, window: Window) -> Scope:
        return replace(self, window=window)

    def inside(self, until_only: bool = False) -> Column:
        """The window as a scan condition; on a stored table the day partitions are pruned with it."""
        end = F.col("ts") < self.window.to_ms
        condition = end if until_only else self.window.contains()
        return condition & self._days(until_only) if "day" in self.events.columns else condition

    def since(self, from_ms: int) -> Column:
        """From a moment on, as a scan condition that prunes day partitions like ``inside``."""
        condition = F.col("ts") >= from_ms
        if "day" in self.events.columns:
            condition = condition & (F.col("day") >= F.date_from_unix_date(F.lit(from_ms // DAY_MS)))
        return condition

    def site_events(self) -> DataFrame:
        """Every event of the scope's sites, at any time."""
        return self.events if self.site is None else self.events.where(F.col("site_id") == self.site)

    def site_sessions(self) -> DataFrame | None:
        """The side table's rows of the scope's sites, if there is one."""
        return self.sessions if self.sessions is None or self.site is None else self.sessions.where(F.col("site_id") == self.site)

    def site_people(self) -> Ledger | None:
        """The ledger's rows of the scope's sites, if there is one."""
        return self.people if self.people is None or self.site is None else self.people.of_site(self.site)

    def site_distincts(self) -> DistinctDays | None:
        """The dictionary and day bitmaps of the scope's sites, if there are any."""
        return self.distincts if self.distincts is None or self.site is None else self.distincts.of_site(self.site)

    def site_vitals(self) -> DataFrame | None:
        """The stored value counts of the scope's sites, if there are any."""
        return self.vitals if self.vitals is None or self.site is None else self.vitals.where(F.col("site_id") == self.site)

    def session_events(self, until_only: bool = False) -> DataFrame:
        """Every event that a session of the window may have; without the side table, of any time."""
        events, sessions = self.site_events(), self.site_sessions()
        if sessions is None or "day" not in events.columns:
            return events
        from footlog.sources.session_days import days_around

        first, last = days_around(sessions, self._days(until_only))
        return events.where((F.col("day") >= first) & (F.col("day") <= last))

    def _days(self, until_only: bool = False) -> Column:
        """The days the window touches."""
        inside = F.col("day") <= F.date_from_unix_date(F.lit((self.window.to_ms - 1) // DAY_MS))
        return inside if until_only else inside & (F.col("day") >= F.date_from_unix_date(F.lit(self.window.from_ms // DAY_MS)))

    def who(self, name: str = "human") -> Column:
        return audience("human_strict" if self.strict_bots and name == "human" else name)

    def rows(self, audience: str = "human", until_only: bool = False, filtered: bool = True) -> DataFrame:
        """Events of the window and audience that pass the filters.

        ``until_only`` drops the lower bound (all history up to the window's end).
        """
        from footlog.operators.filters import apply_filters

        picked = self.site_events().where(self.inside(until_only) & self.who(audience))
        if not filtered:
            return picked
        whole = self.session_events(until_only) if any(f.field == "event" for f in self.filters) else self.site_events()
        return apply_filters(picked, whole, self.filters, self.site_sessions())

    def per_site(self, rows: DataFrame, *measures: Column) -> DataFrame:
        """One result row per site; a named site always yields a row, even with no events."""
        if self.site is None:
            return rows.groupBy("site_id").agg(*measures)
        names = [F.lit(self.site).alias("site_id")]
        return rows.agg(*measures).select(*names, "*")
