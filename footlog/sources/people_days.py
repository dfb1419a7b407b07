"""The ledger of people: mergeable rows per site, day and identified person, written along with the events.

Reports on people look at all history: when a person was first seen, on how many days they came, which plan they carried last.
The ledger answers them without reading event days. ``visits`` holds one row per site, day, person, visit and audience with
its times, counts and latest plan; ``actions`` one per site, day, person and action. Visits and actions are rows, not lists,
so that a person with any number of them stays mergeable. Several appends of one day give several rows; one that is run
again under the same name is counted once.

A window that begins or ends within a day needs the events of that day alone; all others come from the ledger. Events without
an identity have no row; an empty table gives an empty ledger.
"""

from __future__ import annotations

import datetime as dt
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footlog.functions.values import count_when, prop
from footlog.model import DAY_MS, Scope, audience, is_action, is_pageview
from footlog.sources.event_table import PARTITIONS, with_day
from footlog.sources.session_days import replace_days

PERSON = ["site_id", "identity"]
VISIT = [*PARTITIONS, "identity", "session_id", "who"]
ACTION = [*PARTITIONS, "identity", "name"]
#: The audiences reports on people ask for, and the labels of ``who`` that each one takes in.
LABELS = {"human": ["strict", "suspect"], "human_strict": ["strict"], "everyone": ["strict", "suspect", "other"]}
VISITS_SCHEMA = (
    "identity string, session_id string, who string, first_ts long, last_ts long, pages long, actions long, "
    "planned struct<ts: bigint, ingest_seq: bigint, plan: string>, batch string, site_id string, day date"
)
ACTIONS_SCHEMA = "identity string, name string, n long, batch string, site_id string, day date"


@dataclass(frozen=True)
class Ledger:
    """The two tables of the ledger."""

    visits: DataFrame
    actions: DataFrame

    def of_site(self, site: str) -> Ledger:
        return Ledger(self.visits.where(F.col("site_id") == site), self.actions.where(F.col("site_id") == site))


def visit_rows(events: DataFrame, *more: str) -> DataFrame:
    """One row per site, day, person, visit and audience (and the columns ``more``) of the given events."""
    placed = events if "day" in events.columns else with_day(events)
    who = F.when(audience("human_strict"), "strict").when(audience("human"), "suspect").otherwise("other")
    known = placed.where(F.col("identity") != "").withColumn("who", who).withColumn("_plan", prop("plan"))
    return known.groupBy(*VISIT, *more).agg(
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        count_when(is_pageview()).alias("pages"),
        count_when(is_action()).alias("actions"),
        F.max(F.when(F.col("_plan").isNotNull(), F.struct("ts", "ingest_seq", F.col("_plan").alias("plan")))).alias("planned"),
    )


def action_rows(events: DataFrame) -> DataFrame:
    """How often each person did each action on each day; people only, no agents."""
    placed = events if "day" in events.columns else with_day(events)
    acts = placed.where((F.col("identity") != "") & audience("human") & is_action())
    return acts.groupBy(*ACTION).agg(F.count(F.lit(1)).alias("n"))


def people_days(events: DataFrame, batch: str | None = None) -> Ledger:
    """The ledger's rows of the given events, under the append's name."""
    name = F.lit(batch or uuid.uuid4().hex)
    return Ledger(visit_rows(events).withColumn("batch", name), action_rows(events).withColumn("batch", name))


def write_people_days(rows: Ledger, path: str, mode: str = "append") -> None:
    """Write both tables in the events' partitions; sorted by person, so that row groups tell whom they hold."""
    for part, name in ((rows.visits, "visits"), (rows.actions, "actions")):
        placed = part.hint("rebalance", *PARTITIONS).sortWithinPartitions(*PARTITIONS, "identity")
        placed.write.mode(mode).partitionBy(*PARTITIONS).parquet(f"{path}/{name}")


def read_people_days(spark: SparkSession, path: str) -> Ledger:
    """The stored ledger; rows that stand for an emptied day are left out."""
    known = F.col("identity").isNotNull()
    return Ledger(
        spark.read.schema(VISITS_SCHEMA).parquet(f"{path}/visits").where(known),
        spark.read.schema(ACTIONS_SCHEMA).parquet(f"{path}/actions").where(known),
    )


def rebuild(events: DataFrame, path: str, site: str, days: list) -> None:
    """Replace the ledger's rows of one site's days by what its events now hold; also puts many appends together."""
    made = people_days(events.where((F.col("site_id") == site) & F.col("day").isin(days)), "rebuilt")
    replace_days(made.visits, f"{path}/visits", site, days)
    replace_days(made.actions, f"{path}/actions", site, days)


def once(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Each append counted once, however often it was run under its name."""
    held = [c for c in rows.columns if c not in {*keys, "batch"}]
    return rows.groupBy(*keys, "batch").agg(F.first(F.struct(*held)).alias("_x")).select(*keys, "_x.*")


def taken_in(scope: Scope, name: str = "human") -> Column:
    """Rows of the audience that the scope means by ``name``."""
    strict = "human_strict" if scope.strict_bots and name == "human" else name
    return F.col("who").isin(LABELS[strict])


def visits_until_end(scope: Scope, *moments: int) -> DataFrame:
    """The ledger's visits before the window's end, every row on one side of each of the ``moments``.

    Only days that a moment or the window's end cuts in two are read from the events. Appends that were run again are not
    taken out: minima, maxima and flags do not need it.
    """
    end = scope.window.to_ms
    cut = [dt.date(1970, 1, 1) + dt.timedelta(days=n) for n in sorted({m // DAY_MS for m in (*moments, end) if m % DAY_MS})]
    before = F.col("day") < F.date_from_unix_date(F.lit(end // DAY_MS))
    ledger = scope.site_people().visits.drop("batch")
    if not cut:
        return ledger.where(before)
    events = scope.site_events()
    placed = events if "day" in events.columns else with_day(events)
    side = sum((F.when(F.col("ts") >= m, 1).otherwise(0) for m in moments), F.lit(0))
    parts = placed.where(F.col("day").isin(cut) & (F.col("ts") < end)).withColumn("_side", side)
    return ledger.where(before & ~F.col("day").isin(cut)).unionByName(visit_rows(parts, "_side").drop("_side"))
