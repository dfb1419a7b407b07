"""The side table of sessions: one mergeable row per site, day and session, written along with the events.

A session has no length limit in the data, so an operator that needs whole sessions would have to look for their events on
every day of the site. The side table says on which days a session has events, and holds what most operators want to know of
it: its times, counts, first event and first and last page. Rows are partitioned like the events; several appends of one day
give several rows, which ``fold`` puts together. An append that is run again under the same name is counted once.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footlog.functions.values import count_when, in_order
from footlog.model import is_event, is_pageview
from footlog.sources.event_table import PARTITIONS, with_day

KEYS = ["site_id", "session_id"]
#: What is kept of a session's first event.
FIRST = "visitor_id country browser os device screen lang channel source referrer_host utm_campaign".split()
_PAGE = "struct<ts: bigint, ingest_seq: bigint, path: string>"
SCHEMA = (
    "session_id string, started long, ended long, pageviews long, events long, identity string, "
    f"first struct<ts: bigint, ingest_seq: bigint, {', '.join(f'{c}: string' for c in FIRST)}>, "
    f"entry {_PAGE}, leave {_PAGE}, batch string, site_id string, day date"
)


def session_days(events: DataFrame, batch: str | None = None) -> DataFrame:
    """One row per site, day and session of the given events."""
    viewed = F.when(is_pageview(), F.struct("ts", "ingest_seq", "path"))
    placed = events if "day" in events.columns else with_day(events)
    grouped = placed.groupBy(*PARTITIONS, "session_id").agg(
        F.min("ts").alias("started"),
        F.max("ts").alias("ended"),
        count_when(is_pageview()).alias("pageviews"),
        count_when(is_event()).alias("events"),
        F.max("identity").alias("identity"),
        F.min_by(F.struct("ts", "ingest_seq", *FIRST), in_order()).alias("first"),
        F.min_by(viewed, F.when(is_pageview(), in_order())).alias("entry"),
        F.max_by(viewed, F.when(is_pageview(), in_order())).alias("leave"),
    )
    return grouped.withColumn("batch", F.lit(batch or uuid.uuid4().hex))


def write_session_days(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Write rows in the events' partitions; sorted by session, so that row groups tell which sessions they hold."""
    placed = rows.hint("rebalance", *PARTITIONS).sortWithinPartitions(*PARTITIONS, "session_id")
    placed.write.mode(mode).partitionBy(*PARTITIONS).parquet(path)


def read_session_days(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def rebuild(events: DataFrame, path: str, site: str, days: list) -> None:
    """Replace the side table's rows of one site's days by what its events now hold; also puts many appends together."""
    mine = (F.col("site_id") == site) & F.col("day").isin(days)
    replace_days(session_days(events.where(mine), "rebuilt"), path, site, days)


def replace_days(made: DataFrame, path: str, site: str, days: list) -> None:
    """Put the rows ``made`` in the place of one site's days in a side table; a day without any is left with a blank row."""
    spark = made.sparkSession
    empty = spark.createDataFrame([(site, d) for d in days], "site_id string, day date").join(made.select(*PARTITIONS).distinct(), PARTITIONS, "left_anti")
    # An emptied day is overwritten by a row without a session, which ``fold`` and ``days_of`` never meet.
    blank = empty.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in made.schema if f.name not in PARTITIONS], *PARTITIONS)
    rows = made.unionByName(blank.select(*made.columns))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITIONS).parquet(path)


def fold(rows: DataFrame) -> DataFrame:
    """One row per session, of as many days and appends as it has; an append met twice counts once."""
    dealt = rows.where(F.col("session_id").isNotNull()).repartition(*KEYS)  # both groupings below keep to this dealing
    columns = "started ended pageviews events identity first entry leave".split()
    once = dealt.groupBy(*KEYS, "day", "batch").agg(F.first(F.struct(*columns)).alias("x"))
    return once.groupBy(*KEYS).agg(
        F.min("day").alias("first_day"),
        F.max("day").alias("last_day"),
        F.min("x.started").alias("started"),
        F.max("x.ended").alias("ended"),
        F.sum("x.pageviews").alias("pageviews"),
        F.sum("x.events").alias("events"),
        F.max("x.identity").alias("identity"),
        F.min("x.first").alias("first"),
        F.min("x.entry").alias("entry"),
        F.max("x.leave").alias("leave"),
    )


def of_sessions(rows: DataFrame, sessions: DataFrame) -> DataFrame:
    """The folded rows of some sessions; others are left out before anything is dealt by session."""
    return fold(rows.join(sessions.select(*KEYS).distinct(), KEYS, "left_semi"))


def days_around(rows: DataFrame, inside: Column) -> tuple[Column, Column]:
    """The first and last day of all sessions with a row ``inside``, as scalar subqueries a scan prunes its partitions with."""
    held = rows.where(F.col("session_id").isNotNull())
    touching = held.where(inside).select(*KEYS).distinct()
    span = held.select(*KEYS, "day").join(touching, KEYS, "left_semi").agg(F.min("day").alias("first"), F.max("day").alias("last"))
    return span.select("first").scalar(), span.select("last").scalar()
