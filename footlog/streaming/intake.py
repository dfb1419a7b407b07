"""The enrichment job on a stream of landed requests."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from footlog.model import EVENT_SCHEMA
from footlog.plans.enrich import continue_sessions, enrich
from footlog.sources.event_table import new_events, read_near, with_defaults, write_events
from footlog.sources.distinct_days import append_distinct_days
from footlog.sources.people_days import people_days, write_people_days
from footlog.sources.session_days import session_days, write_session_days
from footlog.sources.vital_days import vital_days, write_vital_days


def enriched(requests: DataFrame, sites: DataFrame, secret: str, **options) -> DataFrame:
    """Events of a request stream, without sessions; refused requests are left to ``refusals``."""
    return enrich(requests, sites, secret, **options)[0]


def refusals(requests: DataFrame, sites: DataFrame, secret: str, **options) -> DataFrame:
    return enrich(requests, sites, secret, **options)[1]


def start_intake(
    requests: DataFrame, sites: DataFrame, secret: str, table: str, checkpoint: str, available_now: bool = False,
    sessions: str | None = None, people: str | None = None, distincts: str | None = None,
    vitals: str | None = None, **options,
) -> StreamingQuery:
    """Append a stream of requests to the event table, one idempotent write per micro-batch.

    Each batch is enriched, joined with the stored events of the same days only, and its sessions continue those
    already stored: a batch that is run again after a failure adds nothing twice. ``sessions`` is the folder of the side
    table of session days and ``people`` that of the ledger of people, kept up with every batch if named,
    like the day bitmaps in ``distincts`` and the value counts in ``vitals``.
    """

    def write(batch: DataFrame, number: int) -> None:
        # One micro-batch is enriched once and read several times below; it is rebuilt if an executor is lost.
        events = with_defaults(enrich(batch, sites, secret, **options)[0]).persist(StorageLevel.MEMORY_AND_DISK)
        # Only the folders of the sites and days that arrive are listed, and of the days beside them for visits under way.
        near = read_near(batch.sparkSession, table, events, 1)
        fresh = new_events(events, near.select("id"))
        # A session that is under way keeps its stored name, also when a late event comes before its start.
        named = continue_sessions(fresh.select(*EVENT_SCHEMA.fieldNames()), near)
        if sessions is not None:  # before the events, under the batch's name: a repeated batch is told by it
            write_session_days(session_days(named, f"{checkpoint}#{number}"), sessions)
        if people is not None:
            write_people_days(people_days(named, f"{checkpoint}#{number}"), people)
        if distincts is not None:
            append_distinct_days(named, distincts)
        if vitals is not None:
            write_vital_days(vital_days(named, f"{checkpoint}#{number}"), vitals)
        write_events(named.select(*EVENT_SCHEMA.fieldNames()), table)
        events.unpersist()

    writer = requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
