"""Stored value counts of web vitals: mergeable rows per site, day, vital and value, written along with the events.

A percentile of a window is not made of its days' percentiles, but the counts of equal values add up: the exact rank is found
over the merged counts, and no event is read. Each kind of report has rows of its own, at the precision it shows:

* ``all``: each vital of a site (overview and series);
* one kind per dimension, its value in ``g`` (reports by path, device, browser, system and country);
* ``p75``: vitals of events that carry an LCP, a missing one as a null value (the bundle's percentiles);
* ``slow``: sum and number of LCP values per path (mean per page).

A window that begins or ends within a day needs the events of that day alone. An append that is run again under its name
counts once. Events without a vital have no row; an empty table gives an empty result. Only people are counted, with the
strict audience told apart in ``who``.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footlog.functions.values import number, round_to
from footlog.model import DAY_MS, Scope, Window, audience
from footlog.sources.event_table import PARTITIONS, with_day
from footlog.sources.people_days import once
from footlog.sources.session_days import replace_days

VITALS = ["lcp", "inp", "cls", "fcp", "ttfb"]
DIMENSIONS = ["path", "device", "browser", "os", "country"]
#: Decimal places the bundle shows, and those of all other reports.
BUNDLE_DIGITS = {"lcp": 0, "inp": 0, "cls": 3}
DIGITS = 3
KEY = [*PARTITIONS, "kind", "g", "vital", "who", "value"]
SCHEMA = "kind string, g string, vital string, who string, value double, n long, total double, batch string, site_id string, day date"


def value_rows(events: DataFrame, *more: str) -> DataFrame:
    """How often each value was met per site, day, kind and audience (and the columns ``more``), first met ``at``."""
    placed = events if "day" in events.columns else with_day(events)
    who = F.when(audience("human_strict"), "strict").otherwise("suspect").alias("who")
    parsed = F.from_json("props", ", ".join(f"{v} string" for v in VITALS)).alias("p")
    rows = placed.where((F.col("name") == "web_vitals") & audience("human")).select(
        *PARTITIONS, who, *more, *DIMENSIONS, "ts", parsed, number("lcp").alias("_lcp")
    )

    def entry(kind: str, g: Column, vital: str, value: Column, total: Column | None = None) -> Column:
        total = F.lit(None).cast("double") if total is None else total
        return F.struct(F.lit(kind).alias("kind"), g.alias("g"), F.lit(vital).alias("vital"), value.alias("value"), total.alias("total"))

    shown = {v: F.col(f"p.{v}").try_cast("double") for v in VITALS}
    none, no_value = F.lit(None).cast("string"), F.lit(None).cast("double")
    valued = [F.when(shown[v].isNotNull(), entry(kind, g, v, round_to(shown[v], DIGITS))) for v in VITALS
              for kind, g in [("all", none), *((d, F.col(d)) for d in DIMENSIONS)]]
    bundled = [F.when(shown["lcp"].isNotNull(), entry("p75", none, v, round_to(shown[v], d))) for v, d in BUNDLE_DIGITS.items()]
    slow = F.when(F.col("_lcp").isNotNull(), entry("slow", F.col("path"), "lcp", no_value, F.col("_lcp")))
    spread = rows.select(*PARTITIONS, "who", *more, "ts", F.explode(F.array_compact(F.array(*valued, *bundled, slow))).alias("e"))
    flat = spread.select(*PARTITIONS, "who", *more, "ts", "e.*")
    return flat.groupBy(*KEY, *more).agg(F.count(F.lit(1)).alias("n"), F.sum("total").alias("total"), F.min("ts").alias("at"))


def vital_days(events: DataFrame, batch: str | None = None) -> DataFrame:
    """The stored rows of the given events, under the append's name."""
    return value_rows(events).drop("at").withColumn("batch", F.lit(batch or uuid.uuid4().hex))


def write_vital_days(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Write rows in the events' partitions; sorted by kind, so that a report reads the row groups of its own."""
    placed = rows.hint("rebalance", *PARTITIONS).sortWithinPartitions(*PARTITIONS, "kind", "vital", "g")
    placed.write.mode(mode).partitionBy(*PARTITIONS).parquet(path)


def read_vital_days(spark: SparkSession, path: str) -> DataFrame:
    """The stored table; rows that stand for an emptied day are left out."""
    return spark.read.schema(SCHEMA).parquet(path).where(F.col("kind").isNotNull())


def rebuild(events: DataFrame, path: str, site: str, days: list) -> None:
    """Replace one site's days by what its events now hold; also puts many appends together."""
    mine = events.where((F.col("site_id") == site) & F.col("day").isin(days))
    replace_days(vital_days(mine, "rebuilt"), path, site, days)


def usable(scope: Scope) -> bool:
    """Whether reports of this scope can be made of the stored counts."""
    return scope.vitals is not None and not scope.filters


def counts(scope: Scope, windows: list[Window], kind: str) -> DataFrame:
    """Value counts of one kind over all days the windows touch, each row on one side of every window's ends, met ``at``.

    Only days that an end of a window cuts in two are read from the events.
    """
    moments = sorted({m for w in windows for m in (w.from_ms, w.to_ms)})
    cut = [dt.date(1970, 1, 1) + dt.timedelta(days=n) for n in sorted({m // DAY_MS for m in moments if m % DAY_MS})]
    day = F.col("day")
    touched = (day >= F.date_from_unix_date(F.lit(moments[0] // DAY_MS))) & (day <= F.date_from_unix_date(F.lit((moments[-1] - 1) // DAY_MS)))
    labels = F.col("who").isin(["strict"] if scope.strict_bots else ["strict", "suspect"])
    own = (F.col("kind") == kind) & labels
    columns = [*KEY, "n", "total", "at"]
    whole = scope.site_vitals().where(touched & own & ~day.isin(cut) if cut else touched & own)
    stored = once(whole, KEY).withColumn("at", F.unix_date("day").cast("long") * DAY_MS).select(*columns)
    met = _any([w.contains("at") for w in windows])
    if not cut:
        return stored.where(met)
    events = scope.site_events()
    placed = events if "day" in events.columns else with_day(events)
    inside = day.isin(cut) & (F.col("ts") >= moments[0]) & (F.col("ts") < moments[-1])
    side = sum((F.when(F.col("ts") >= m, 1).otherwise(0) for m in moments), F.lit(0))
    parts = value_rows(placed.where(inside).withColumn("_side", side), "_side").where(own)
    return stored.unionByName(parts.select(*columns)).where(met)


def _any(conditions: list[Column]) -> Column:
    found = conditions[0]
    for condition in conditions[1:]:
        found = found | condition
    return found
