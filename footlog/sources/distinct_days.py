"""Distinct counts that merge: a dense dictionary of ids and one bitmap of their numbers per site, day and audience.

Distinct visitors of two windows are not the sum of those of their days, so counting them anew reads every event of both. Here
each id of a site has a number, given at its first arrival and dense from 1 on, and every day keeps bitmaps of the numbers
met, in buckets of 32768. The bitmaps of any set of days are united bucket by bucket and their bits counted: exact, without an
event. An append written again sets the same bits, so nothing needs to be told apart; there must be one writer at a time.

A window that begins or ends within a day needs the events of that day alone. Numbers follow arrival, so that people of the
same time share buckets; a day costs at most 4 KB a bucket it touches. An empty table gives an empty result.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from footlog.model import DAY_MS, Scope, Window, audience
from footlog.sources.event_table import PARTITIONS, with_day
from footlog.sources.session_days import replace_days

IDS = {"visitors": "visitor_id", "sessions": "session_id"}
KEY = ["site_id", "kind", "key"]
#: Metrics made of bitmaps: what is counted, and the labels of ``who`` that count (with the strict audience in the second place).
METRICS = {
    "visitors.unique": ("visitors", ["strict", "suspect"], ["strict"]),
    "sessions.total": ("sessions", ["strict", "suspect"], ["strict"]),
    "bots.suspected": ("visitors", ["suspect"], []),
    "agent.sessions": ("sessions", ["agent"], ["agent"]),
}
#: New ids of a site are numbered in so many hashed parts, each following on from the sizes of those before.
PARTS = 256
KEYS_SCHEMA = "kind string, key string, number long, site_id string"
DAYS_SCHEMA = "kind string, who string, bucket long, bits binary, site_id string, day date"


@dataclass(frozen=True)
class DistinctDays:
    """The dictionary of ids and the day bitmaps."""

    keys: DataFrame
    days: DataFrame

    def of_site(self, site: str) -> DistinctDays:
        return DistinctDays(self.keys.where(F.col("site_id") == site), self.days.where(F.col("site_id") == site))


def read_distinct_days(spark: SparkSession, path: str) -> DistinctDays:
    """The stored tables; rows that stand for an emptied day are left out."""
    days = spark.read.schema(DAYS_SCHEMA).parquet(f"{path}/days").where(F.col("kind").isNotNull())
    return DistinctDays(spark.read.schema(KEYS_SCHEMA).parquet(f"{path}/keys"), days)


def create(spark: SparkSession, path: str) -> None:
    """Empty tables, to be kept up by ``append_distinct_days``."""
    spark.createDataFrame([], KEYS_SCHEMA).write.mode("append").partitionBy("site_id").parquet(f"{path}/keys")
    spark.createDataFrame([], DAYS_SCHEMA).write.mode("append").partitionBy(*PARTITIONS).parquet(f"{path}/days")


def ids_met(events: DataFrame, *more: str) -> DataFrame:
    """Each id once per site, day and audience (and the columns ``more``), with ``at``, a moment it was met."""
    placed = events if "day" in events.columns else with_day(events)
    who = F.when(audience("human_strict"), "strict").when(audience("human"), "suspect").when(audience("agent"), "agent").otherwise("other")
    # Folded to visits before every visit becomes two rows, one for each kind of id.
    visits = placed.withColumn("who", who).groupBy(*PARTITIONS, "who", *more, *IDS.values()).agg(F.min("ts").alias("at"))
    each = F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(c).alias("key")) for kind, c in IDS.items()]))
    spread = visits.select(*PARTITIONS, "who", *more, "at", each.alias("i")).select(*PARTITIONS, "who", *more, "at", "i.*")
    return spread.groupBy(*PARTITIONS, "who", *more, "kind", "key").agg(F.min("at").alias("at"))


def numbers_for(met: DataFrame, known: DataFrame) -> DataFrame:
    """Numbers of the ids not known yet, dense and following on from those given.

    No task orders all ids of a site: each hashed part is ordered on its own and starts behind the sizes of the parts before.
    """
    part = F.pmod(F.xxhash64("key"), F.lit(PARTS))
    fresh = met.select(*KEY).distinct().join(known.select(*KEY), KEY, "left_anti").withColumn("_part", part)
    own = ["site_id", "kind"]
    sizes = fresh.groupBy(*own, "_part").agg(F.count(F.lit(1)).alias("_n"))
    along = W.partitionBy(*own).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    given = known.groupBy(*own).agg(F.max("number").alias("_given"))
    starts = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(along), F.lit(0))).join(given, own, "left").drop("_n")
    ranked = fresh.withColumn("_rank", F.row_number().over(W.partitionBy(*own, "_part").orderBy("key")))
    number = F.coalesce("_given", F.lit(0)) + F.col("_before") + F.col("_rank")
    return ranked.join(starts, [*own, "_part"]).select("kind", "key", number.cast("long").alias("number"), "site_id")


def bitmaps(met: DataFrame, keys: DataFrame, *more: str) -> DataFrame:
    """The numbers of the ids met as bits, per site, day, audience and bucket (and the columns ``more``)."""
    numbered = met.join(keys, KEY)
    bucket, position = F.bitmap_bucket_number("number"), F.bitmap_bit_position("number")
    placed = numbered.withColumn("bucket", bucket).withColumn("_bit", position)
    return placed.groupBy(*PARTITIONS, "kind", "who", "bucket", *more).agg(
        F.bitmap_construct_agg("_bit").alias("bits"), F.min("at").alias("at")
    )


def _stored_columns(made: DataFrame) -> DataFrame:
    return made.select("kind", "who", "bucket", "bits", *PARTITIONS)


def append_distinct_days(events: DataFrame, path: str) -> None:
    """Keep both tables up with events that arrive: first new ids are numbered, then the days' bits are set.

    Only the dictionary of the sites that arrive is read; their names are collected, one per site of the append.
    """
    spark, met = events.sparkSession, ids_met(events)
    sites = [r["site_id"] for r in events.select("site_id").distinct().collect()]
    mine = F.col("site_id").isin(sites)
    fresh = numbers_for(met, read_distinct_days(spark, path).keys.where(mine))
    fresh.hint("rebalance", "site_id").write.mode("append").partitionBy("site_id").parquet(f"{path}/keys")
    made = _stored_columns(bitmaps(met, read_distinct_days(spark, path).keys.where(mine)))
    made.hint("rebalance", *PARTITIONS).write.mode("append").partitionBy(*PARTITIONS).parquet(f"{path}/days")


def rebuild(events: DataFrame, path: str, site: str, days: list) -> None:
    """Replace the bitmaps of one site's days by what its events now hold; ids that are gone keep their numbers."""
    met = ids_met(events.where((F.col("site_id") == site) & F.col("day").isin(days)))
    keys = read_distinct_days(events.sparkSession, path).keys.where(F.col("site_id") == site)
    replace_days(_stored_columns(bitmaps(met, keys)), f"{path}/days", site, days)


def _bits(scope: Scope, windows: list[Window]) -> DataFrame:
    """Bitmaps of all days the windows touch, each row on one side of every window's ends, met first ``at``."""
    held, moments = scope.site_distincts(), sorted({m for w in windows for m in (w.from_ms, w.to_ms)})
    cut = [dt.date(1970, 1, 1) + dt.timedelta(days=n) for n in sorted({m // DAY_MS for m in moments if m % DAY_MS})]
    first, last = moments[0] // DAY_MS, (moments[-1] - 1) // DAY_MS
    day = F.col("day")
    touched = (day >= F.date_from_unix_date(F.lit(first))) & (day <= F.date_from_unix_date(F.lit(last)))
    columns = [*PARTITIONS, "kind", "who", "bucket", "bits", "at"]
    stored = held.days.where(touched).withColumn("at", F.unix_date("day").cast("long") * DAY_MS)
    if not cut:
        return stored.select(*columns)
    events = scope.site_events()
    placed = events if "day" in events.columns else with_day(events)
    inside = day.isin(cut) & (F.col("ts") >= moments[0]) & (F.col("ts") < moments[-1])
    side = sum((F.when(F.col("ts") >= m, 1).otherwise(0) for m in moments), F.lit(0))
    parts = bitmaps(ids_met(placed.where(inside).withColumn("_side", side), "_side"), held.keys, "_side")
    return stored.where(~day.isin(cut)).select(*columns).unionByName(parts.select(*columns))


def _labelled(scope: Scope, metric: str) -> Column:
    kind, loose, strict = METRICS[metric]
    return (F.col("kind") == kind) & F.col("who").isin(strict if scope.strict_bots else loose)


def counts(scope: Scope, windows: dict[str, Window], metrics: list[str]) -> DataFrame:
    """The metrics of each window, as columns ``metric|tag``, per site with any event in the windows.

    One row of bits per site, kind and bucket is what the shuffle moves; ids are never moved.
    """
    bits = _bits(scope, list(windows.values()))
    named = [(f"{m}|{tag}".replace(".", "_"), _labelled(scope, m) & w.contains("at")) for m in metrics for tag, w in windows.items()]
    met = bits.where(_any([w.contains("at") for w in windows.values()]))
    united = met.groupBy("site_id", "kind", "bucket").agg(*[F.bitmap_or_agg(F.when(hit, F.col("bits"))).alias(n) for n, hit in named])
    return scope.per_site(united, *[F.coalesce(F.sum(F.bitmap_count(F.col(n))), F.lit(0)).alias(n) for n, _ in named])


def counted(scope: Scope, metric: str) -> DataFrame:
    """One metric of the window per site where its audience has any event."""
    own = _bits(scope, [scope.window]).where(_labelled(scope, metric))
    united = own.groupBy("site_id", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    return scope.per_site(united, F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("value"))


def _any(conditions: list[Column]) -> Column:
    found = conditions[0]
    for condition in conditions[1:]:
        found = found | condition
    return found
