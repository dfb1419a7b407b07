"""Sessions on a stream (C2): live session facts, a session id for every event, and names that settle as late events come."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from footlog.functions.values import count_when
from footlog.model import SESSION_GAP_MS, is_pageview
from footlog.plans.enrich import SESSION_NAME

# An event may be up to a day old when it arrives; older ones were refused at intake.
LATENESS = "24 hours"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def timed(events: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Events with their event time and watermark."""
    return events.withColumn("event_time", F.timestamp_millis("ts")).withWatermark("event_time", lateness)


def unique_events(events: DataFrame) -> DataFrame:
    """A2 on a stream: each id once within the watermark."""
    return timed(events).dropDuplicatesWithinWatermark(["id"])


def session_facts(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """One row per session, for update or append mode; a gap of exactly 30 minutes does not split."""
    window = F.session_window("event_time", gap)
    return (
        timed(events)
        .groupBy("site_id", "visitor_id", window.alias("session"))
        .agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count(F.lit(1)).alias("events"), count_when(is_pageview()).alias("pageviews"))
    )


class _Slices(StatefulProcessor):
    """Per visitor: one state entry for each slice of time as wide as the gap, with its first and last event and its name.

    Events of one slice can never be apart by more than the gap, and only those of adjoining slices can be near enough, so a
    slice is all that an event needs to look at besides its two neighbours. Rows come in parts and leave part by part: memory
    holds one part and the slices it touches, however many events a visitor has. Slices that no event may reach any more,
    by the watermark, go by event-time timers.

    A slice's name is the time its session is named by. With ``settled`` that is the session's first event as known so far,
    and every slice whose name changes is told again; otherwise a session keeps the name it began with, and where a late
    event closes the gap between two, the earlier name goes on.
    """

    def __init__(self, settled: bool, gap_ms: int) -> None:
        self._settled, self._gap = settled, gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._slices = handle.getMapState("slices", "slice long", "first long, last long, name long")

    def _get(self, number: int) -> list[int] | None:
        if number not in self._seen:
            self._seen[number] = list(self._slices.getValue((number,))) if self._slices.containsKey((number,)) else None
        return self._seen[number]

    def _follows(self, number: int) -> bool:
        """Whether a slice goes on with the session of the slice before it."""
        before, own = self._get(number - 1), self._get(number)
        return before is not None and own is not None and own[0] - before[1] <= self._gap

    def _take(self, number: int, first: int, last: int) -> None:
        """A slice has events from ``first`` to ``last``; names follow, here and in the slices that go on from it."""
        own, after = self._get(number), self._get(number + 1)
        name = own[2] if own else after[2] if after and after[0] - first <= self._gap else first
        self._seen[number] = [min(first, own[0]), max(last, own[1]), name] if own else [first, last, name]
        if self._settled:
            self._seen[number][2] = self._seen[number][0]
        if self._follows(number):
            self._seen[number][2] = self._get(number - 1)[2]
        self._changed.add(number)
        while self._follows(number + 1) and self._get(number + 1)[2] != self._get(number)[2]:
            self._seen[number + 1][2] = self._seen[number][2]
            number += 1
            self._changed.add(number)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self._seen: dict[int, list[int] | None] = {}
        told: set[int] = set()
        for part in rows:
            part = part.assign(slice=part["ts"] // self._gap)
            self._changed: set[int] = set()
            spans = part.groupby("slice")["ts"].agg(["min", "max"])  # in order of slices
            for number, first, last in zip(spans.index.tolist(), spans["min"].tolist(), spans["max"].tolist(), strict=True):
                if self._get(number) is None:
                    self._handle.registerTimer((number + 2) * self._gap)
                self._take(number, first, last)
            for number in self._changed:
                self._slices.updateValue((number,), tuple(self._seen[number]))
            told |= self._changed
            if not self._settled:
                names = {n: hashlib.sha256("|".join((*map(str, key), str(self._seen[n][2]))).encode()).hexdigest()[:32] for n in spans.index.tolist()}
                yield pd.DataFrame({"id": part["id"], "ts": part["ts"], "site_id": key[0], "visitor_id": key[1], "session_id": part["slice"].map(names)})
        if self._settled and told:
            numbers = sorted(told)
            yield pd.DataFrame({"site_id": key[0], "visitor_id": key[1], "slice": numbers, "session_start": [self._seen[n][2] for n in numbers]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        number = expiredTimerInfo.getExpiryTimeInMs() // self._gap - 2
        if self._slices.containsKey((number,)):
            self._slices.removeKey((number,))
        return iter(())

    def close(self) -> None:
        pass


def _sliced(events: DataFrame, settled: bool, gap_ms: int, schema: str, lateness: str) -> DataFrame:
    narrow = timed(events, lateness).select("id", "ts", "site_id", "visitor_id", "event_time")
    return narrow.groupBy("site_id", "visitor_id").transformWithStateInPandas(
        statefulProcessor=_Slices(settled, gap_ms), outputStructType=schema, outputMode="Append", timeMode="EventTime"
    )


def assign_sessions(events: DataFrame, gap_ms: int = SESSION_GAP_MS, lateness: str = LATENESS) -> DataFrame:
    """(id, ts, site_id, visitor_id, session_id) per event as it arrives; the same names as the batch job on ordered input.

    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``). Bound the backlog of a first run by the
    source's ``maxFilesPerTrigger``. Events later than the watermark, ``lateness``, are left out.
    """
    return _sliced(events, False, gap_ms, "id string, ts long, site_id string, visitor_id string, session_id string", lateness)


def session_slices(events: DataFrame, gap_ms: int = SESSION_GAP_MS, lateness: str = LATENESS) -> DataFrame:
    """(site_id, visitor_id, slice, session_start) for every slice of time whose session's start became known or changed.

    A start only ever moves back, so the least one told of a slice is the latest. Store the rows and name events by them
    (``named_by_slices``): late events included, the names are those of the batch job.
    """
    return _sliced(events, True, gap_ms, "site_id string, visitor_id string, slice long, session_start long", lateness)


def named_by_slices(events: DataFrame, slices: DataFrame, gap_ms: int = SESSION_GAP_MS) -> DataFrame:
    """Stored events with ``session_start`` and ``session_id`` by the rows of ``session_slices``."""
    keys = ["site_id", "visitor_id", "slice"]
    starts = slices.groupBy(*keys).agg(F.min("session_start").alias("session_start"))
    placed = events.drop("session_id").withColumn("slice", F.floor(F.col("ts") / F.lit(gap_ms)).cast("long"))
    return placed.join(starts, keys).drop("slice").withColumn("session_id", F.expr(SESSION_NAME))
