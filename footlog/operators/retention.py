"""Retention cohorts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from footlog.functions.values import day_of, percent
from footlog.model import DAY_MS, Scope

MAX_COHORTS = 12
MAX_OFFSET = 7


def cohort_cells(scope: Scope, max_offset: int = MAX_OFFSET, cohorts: int = MAX_COHORTS, audience: str = "unbotted") -> DataFrame:
    """Cells of the newest cohorts: people first seen on a UTC day of the window and active ``offset`` days later.

    Days after the window's end have no cell: they were not measured.
    """
    if max_offset < 1:
        raise ValueError("retention looks at least one day ahead")
    known = scope.rows(audience).where(F.col("identity") != "")
    active = known.select("site_id", "identity", day_of().alias("day")).distinct()
    # A person has at most one row per day here, so the window over a person is bounded by the range's days.
    first = F.min("day").over(W.partitionBy("site_id", "identity"))
    placed = active.withColumn("cohort", first).withColumn("offset", F.col("day") - F.col("cohort"))
    counted = placed.groupBy("site_id", "cohort", "offset").agg(F.count(F.lit(1)).alias("users"))
    # Everyone is active on their own first day, so offset 0 is the cohort's size.
    sized = counted.groupBy("site_id", "cohort").agg(
        F.max(F.when(F.col("offset") == 0, F.col("users"))).alias("size"),
        F.map_from_entries(F.collect_list(F.when(F.col("offset") <= max_offset, F.struct("offset", "users")))).alias("by"),
    )
    newest = sized.withColumn("_r", F.row_number().over(W.partitionBy("site_id").orderBy(F.desc("cohort")))).where(
        F.col("_r") <= cohorts
    )
    grid = newest.select(
        "site_id", "cohort", "size", "by", F.explode(F.sequence(F.lit(0), F.lit(max_offset))).alias("offset")
    ).where((F.col("cohort") + F.col("offset")) * DAY_MS < scope.window.to_ms)
    users = F.coalesce(F.try_element_at("by", F.col("offset").cast("long")), F.lit(0).cast("long"))
    return grid.select(
        "site_id",
        (F.col("cohort") * DAY_MS).alias("day"),
        "size",
        "offset",
        users.alias("users"),
        percent(users, F.col("size")).alias("rate"),
    )


def curve(cells: DataFrame) -> DataFrame:
    """Mean retention per offset, weighted by the cohorts that could measure it."""
    return cells.groupBy("site_id", "offset").agg(percent(F.sum("users"), F.sum("size")).alias("rate"))


def availability(scope: Scope, sites: DataFrame | None = None) -> DataFrame:
    """Per site whether people can be counted at all, and why not."""
    known = scope.per_site(
        scope.rows("unbotted"), F.sum(F.when(F.col("identity") != "", 1).otherwise(0)).alias("identified_events")
    )
    if sites is not None:
        known = sites.select("site_id", "privacy_mode").join(known, "site_id", "left")
    strict = F.col("privacy_mode") == "strict" if sites is not None else F.lit(False)
    reason = F.when(strict, "strict_mode").when(F.coalesce("identified_events", F.lit(0)) == 0, "no_identity").otherwise("")
    return known.select("site_id", (reason == "").alias("available"), reason.alias("reason"))
