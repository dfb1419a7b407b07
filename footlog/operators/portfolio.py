"""Many sites side by side."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footlog.functions.values import bucket_of, count_when, distinct, round_to
from footlog.model import DAY_MS, WEEK_MS, Scope, is_pageview
from footlog.operators import lifecycle
from footlog.operators.revenue import currencies

PLATFORMS = ["web", "ios", "android", "app"]


def traffic(scope: Scope) -> DataFrame:
    """visitors and pageviews now, visitors before; folded per visitor, so nothing is counted distinct."""
    earlier = scope.window.previous()
    rows = scope.at(scope.window.joined(earlier)).rows(filtered=False)
    now = scope.window.contains()
    folded = rows.groupBy("site_id", "visitor_id").agg(
        F.max(F.when(now, 1).otherwise(0)).alias("cur"),
        F.max(F.when(now, 0).otherwise(1)).alias("prev"),
        count_when(now & is_pageview()).alias("pv"),
    )
    return folded.groupBy("site_id").agg(
        F.sum("cur").cast("long").alias("visitors"),
        F.sum("pv").cast("long").alias("pageviews"),
        F.sum("prev").cast("long").alias("prev_visitors"),
    )


def people(scope: Scope) -> DataFrame:
    """growth accounting per site."""
    return lifecycle.people_flags(scope).groupBy("site_id").agg(*lifecycle.accounting_columns(scope.window.from_ms))


def signups(scope: Scope) -> DataFrame:
    """F32: signup events per site."""
    rows = scope.rows(filtered=False).where("name = 'signup'")
    return rows.groupBy("site_id").agg(F.count(F.lit(1)).alias("signups"))


def moves(scope: Scope) -> DataFrame:
    """F32: people who became paying or stopped."""
    crossed = lifecycle.plan_moves(scope)
    folded = crossed.groupBy("site_id", "identity").agg(
        F.max(F.when(F.col("move") == "became_paying", 1).otherwise(0)).alias("up"),
        F.max(F.when(F.col("move") == "stopped_paying", 1).otherwise(0)).alias("down"),
    )
    return folded.groupBy("site_id").agg(
        F.sum("up").cast("long").alias("became_paying"), F.sum("down").cast("long").alias("stopped_paying")
    )


def paying(scope: Scope) -> DataFrame:
    """F32: people whose latest plan pays."""
    paid = ~F.col("plan").isin(lifecycle.FREE_PLANS)
    return lifecycle.latest_plans(scope).groupBy("site_id").agg(count_when(paid).alias("paying"))


def revenue(scope: Scope) -> DataFrame:
    """revenue per site and currency."""
    return currencies(scope)


def series_axis(scope: Scope) -> tuple[int, int, int]:
    """Bucket width (a day up to 92 days, else a week), the aligned start, and the number of buckets."""
    width = DAY_MS if scope.window.span <= 92 * DAY_MS else WEEK_MS
    start = scope.window.from_ms // width * width
    return width, start, max(1, math.ceil((scope.window.to_ms - start) / width))


def series(scope: Scope, sites: DataFrame) -> DataFrame:
    """visitors and identified people of every site of ``sites`` (site_id, privacy_mode), every UTC-aligned bucket present.

    People are null on strict sites, where they are not measured. One row per visitor, person and bucket, then one per
    visitor or person and bucket: two folds instead of two distinct counts, which would read every event three times.
    """
    width, start, count = series_axis(scope)
    placed = scope.rows(filtered=False).withColumn("bucket", bucket_of("ts", start, width))
    pairs = placed.select("site_id", "bucket", "visitor_id", "identity").distinct()
    named = F.explode(F.array(F.struct(F.lit("v").alias("kind"), F.col("visitor_id").alias("who")), F.struct(F.lit("i").alias("kind"), F.col("identity").alias("who"))))
    known = pairs.select("site_id", "bucket", named.alias("x")).select("site_id", "bucket", "x.*").where("kind = 'v' OR who <> ''").distinct()
    counted = known.groupBy("site_id", "bucket").agg(count_when(F.col("kind") == "v").alias("visitors"), count_when(F.col("kind") == "i").alias("users"))
    held = counted.groupBy("site_id").agg(
        F.map_from_entries(F.collect_list(F.struct("bucket", F.struct("visitors", "users")))).alias("held")
    )
    listed = sites.select("site_id", "privacy_mode").join(held, "site_id", "left")
    axis = listed.select("site_id", "privacy_mode", "held", F.explode(F.sequence(F.lit(0), F.lit(count - 1)).cast("array<long>")).alias("bucket"))
    point = F.try_element_at("held", F.col("bucket"))
    return axis.select(
        "site_id",
        "bucket",
        F.coalesce(point.getField("visitors"), F.lit(0).cast("long")).alias("visitors"),
        F.when(F.col("privacy_mode") != "strict", F.coalesce(point.getField("users"), F.lit(0).cast("long"))).alias("users"),
    )


def _platform() -> Column:
    browser = F.col("browser")
    return (
        F.when(browser == "iOS app", "ios")
        .when(browser == "Android app", "android")
        .when((browser == "App") | F.lower(browser).endswith(" app"), "app")
        .otherwise("web")
    )


def platforms(scope: Scope) -> DataFrame:
    """visitors per platform, read from the browser bucket."""
    rows = scope.rows(filtered=False).withColumn("platform", _platform())
    return rows.groupBy("site_id", "platform").agg(distinct("visitor_id").alias("visitors"))


def _by_visitor(scope: Scope) -> DataFrame:
    """F30, signups and F35 of the portfolio, in one fold per visitor."""
    earlier, now = scope.window.previous(), scope.window.contains()
    rows = scope.at(scope.window.joined(earlier)).rows(filtered=False).withColumn("_platform", _platform())
    on = {f"{p}_visitors": F.max(F.when(now & (F.col("_platform") == p), 1).otherwise(0)) for p in PLATFORMS}
    folded = rows.groupBy("site_id", "visitor_id").agg(
        F.max(F.when(now, 1).otherwise(0)).alias("visitors"),
        F.max(F.when(now, 0).otherwise(1)).alias("prev_visitors"),
        count_when(now & is_pageview()).alias("pageviews"),
        count_when(now & (F.col("name") == "signup")).alias("signups"),
        *[flag.alias(name) for name, flag in on.items()],
    )
    summed = ["visitors", "prev_visitors", "pageviews", "signups", *on]
    return folded.groupBy("site_id").agg(*[F.sum(c).cast("long").alias(c) for c in summed])


def _by_person(scope: Scope) -> DataFrame:
    """F31 and the paying people of the portfolio, in one fold per person."""
    paid = F.col("plan").isNotNull() & ~F.col("plan").isin(lifecycle.FREE_PLANS)
    columns = lifecycle.accounting_columns(scope.window.from_ms)
    return lifecycle.people_states(scope).groupBy("site_id").agg(*columns, count_when(paid).alias("paying"))


def portfolio(scope: Scope, sites: DataFrame) -> DataFrame:
    """one row per site of ``sites`` (site_id, privacy_mode); people columns are null on strict sites.

    Three scans: one fold per visitor, one per person, and the plan changes. Every part has one row per site already, so the
    joins move site-sized tables only.
    """
    joined = sites.select("site_id", "privacy_mode")
    for part in (_by_visitor(scope), _by_person(scope), moves(scope)):
        joined = joined.join(part, "site_id", "left")
    strict = F.col("privacy_mode") == "strict"
    measured = ["known", "active", "prev_active", "new_users", "resurrected", "churned"]
    counted = ["visitors", "pageviews", "prev_visitors", "signups", "became_paying", "stopped_paying", "paying"]
    counted += [f"{p}_visitors" for p in PLATFORMS]
    return joined.select(
        "site_id",
        *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in counted],
        *[F.when(~strict, F.coalesce(F.col(c), F.lit(0)).cast("long")).alias(c) for c in measured],
    )


def totals(rows: DataFrame) -> DataFrame:
    """sums over the sites of a portfolio."""
    summed = ["visitors", "prev_visitors", "active", "new_users", "churned", "signups", "became_paying", "paying"]
    return rows.agg(
        F.count(F.lit(1)).alias("sites"), *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in summed]
    )


def money_totals(scope: Scope, sites: DataFrame) -> DataFrame:
    """money over all sites, per currency."""
    known = currencies(scope).where(F.col("currency").isNotNull() & (F.col("currency") != ""))
    own = known.join(sites.select("site_id"), "site_id", "left_semi")
    per_site = own.withColumn("revenue", round_to(F.col("revenue"), 2))
    return per_site.groupBy("currency").agg(
        round_to(F.sum("revenue"), 2).alias("revenue"), F.sum("orders").cast("long").alias("orders")
    )
