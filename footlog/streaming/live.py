"""Who is on the site now (C7) and traffic per bucket (E1) on a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from footlog.functions.values import count_when
from footlog.model import LIVE_MS, MINUTE_MS, audience, is_event, is_pageview
from footlog.streaming.sessions import LATENESS, timed


def live_visitors(events: DataFrame, length: str = "5 minutes", step: str = "1 minute") -> DataFrame:
    """People per sliding five minutes; approximate, so state stays one small sketch per window and site."""
    people = timed(events.where(audience("human")))
    window = F.window("event_time", length, step)
    return people.groupBy("site_id", window.alias("window")).agg(F.approx_count_distinct("visitor_id").alias("visitors"))


def live_visitors_exact(events: DataFrame, length: str = "5 minutes", step: str = "1 minute") -> DataFrame:
    """The exact count: each visitor is kept once per window, then windows are counted (append mode)."""
    people = timed(events.where(audience("human")))
    placed = people.select("site_id", "visitor_id", F.window("event_time", length, step).alias("window"))
    once = placed.dropDuplicates(["site_id", "visitor_id", "window"])
    return once.groupBy("site_id", "window").agg(F.count(F.lit(1)).alias("visitors"))


class _Panes(StatefulProcessor):
    """Per visitor: one state entry for each pane (one step of time) the visitor was seen in.

    A window is ``width`` panes long, so a pane met for the first time brings the visitor into at most so many windows, and
    into fewer where the panes beside it were met before: only those windows are told, as the first and last of their first
    panes. Whatever the order of arrival, every window of a visitor is told exactly once. Rows come in parts, of which only the
    panes are kept; panes that no event may be near any more, by the watermark, go by event-time timers.
    """

    def __init__(self, width: int, step_ms: int) -> None:
        self._width, self._step = width, step_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._panes = handle.getMapState("panes", "pane long", "met boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known: dict[int, bool] = {}

        def met(pane: int) -> bool:
            if pane not in known:
                known[pane] = self._panes.containsKey((pane,))
            return known[pane]

        told = []
        for part in rows:
            for pane in sorted(set((part["ts"] // self._step).tolist())):
                if met(pane):
                    continue
                before = next((p for p in range(pane - 1, pane - self._width, -1) if met(p)), pane - self._width)
                after = next((p for p in range(pane + 1, pane + self._width) if met(p)), pane + self._width)
                first, last = max(pane - self._width, before) + 1, min(pane, after - self._width)
                if first <= last:
                    told.append((first * self._step, last * self._step))
                self._panes.updateValue((pane,), (True,))
                self._handle.registerTimer((pane + self._width) * self._step)
                known[pane] = True
        if told:
            yield pd.DataFrame({"site_id": key[0], "first_start": [t[0] for t in told], "last_start": [t[1] for t in told]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        pane = expiredTimerInfo.getExpiryTimeInMs() // self._step - self._width
        if self._panes.containsKey((pane,)):
            self._panes.removeKey((pane,))
        return iter(())

    def close(self) -> None:
        pass


def live_panes(events: DataFrame, length_ms: int = LIVE_MS, step_ms: int = MINUTE_MS, lateness: str = LATENESS) -> DataFrame:
    """(site_id, first_start, last_start) for every run of windows that a visitor came into; exact, as events arrive.

    One state row per visitor and pane, and at most one result row, where a sliding window copies every event ``length / step``
    times. Store the rows and count them with ``live_counts``. Needs the RocksDB state store; events later than the watermark,
    ``lateness``, are left out. ``length_ms`` must be a multiple of ``step_ms``.
    """
    if length_ms % step_ms:
        raise ValueError("a window must be made of whole steps")
    people = timed(events.where(audience("human")), lateness).select("site_id", "visitor_id", "ts", "event_time")
    return people.groupBy("site_id", "visitor_id").transformWithStateInPandas(
        statefulProcessor=_Panes(length_ms // step_ms, step_ms),
        outputStructType="site_id string, first_start long, last_start long",
        outputMode="Append",
        timeMode="EventTime",
    )


def live_counts(panes: DataFrame, step_ms: int = MINUTE_MS) -> DataFrame:
    """Visitors per site and window start, of the stored rows of ``live_panes``; windows without visitors have no row.

    Equal runs are counted first, so that a window's visitors never meet in one place.
    """
    runs = panes.groupBy("site_id", "first_start", "last_start").agg(F.count(F.lit(1)).alias("n"))
    each = runs.select("site_id", F.explode(F.sequence("first_start", "last_start", F.lit(step_ms))).alias("start"), "n")
    return each.groupBy("site_id", "start").agg(F.sum("n").alias("visitors"))


def live_traffic(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """E1 on a stream: views and events per tumbling bucket, visitors and sessions as sketches."""
    people = timed(events.where(audience("human")))
    return people.groupBy("site_id", F.window("event_time", width).alias("window")).agg(
        count_when(is_pageview()).alias("views"),
        count_when(is_event()).alias("events"),
        F.approx_count_distinct("visitor_id").alias("visitors"),
    )
