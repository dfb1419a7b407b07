"""Time series (E1 to E3), their dense axis (E74) and the aligned previous period."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footlog.functions.values import bucket_of, count_when, distinct, per_visitor, percent, ratio, round_to
from footlog.model import DAY_MS, HOUR_MS, MINUTE_MS, WEEK_MS, Scope, Window, WindowError, is_event, is_pageview
from footlog.operators.scalars import session_facts, span_seconds

MAX_POINTS = 400
GRANULARITIES = {"minute": MINUTE_MS, "hour": HOUR_MS, "day": DAY_MS, "week": WEEK_MS}


def bucket_width(window: Window, granularity: str | None = None) -> int:
    """Bucket size from the window's length, or as asked; a request for too many points is refused."""
    if granularity is not None:
        if granularity not in GRANULARITIES:
            raise WindowError(f'unknown granularity "{granularity}"')
        width = GRANULARITIES[granularity]
        if math.ceil(window.span / width) > MAX_POINTS:
            raise WindowError(f"more than {MAX_POINTS} {granularity} buckets: pick a coarser granularity")
        return width
    for longest, width in ((2 * HOUR_MS, MINUTE_MS), (3 * DAY_MS, HOUR_MS), (90 * DAY_MS, DAY_MS)):
        if window.span <= longest:
            return width
    return WEEK_MS


def traffic(scope: Scope, width: int) -> DataFrame:
    """Views, visitors, sessions and custom events per bucket."""
    placed = scope.rows().withColumn("bucket", bucket_of("ts", scope.window.from_ms, width))
    folded = per_visitor(placed, ["site_id", "bucket"], {"views": count_when(is_pageview()), "events": count_when(is_event())})
    return folded.groupBy("site_id", "bucket").agg(
        F.sum("views").cast("long").alias("views"),
        F.count(F.lit(1)).alias("visitors"),
        F.sum("sessions").cast("long").alias("sessions"),
        F.sum("events").cast("long").alias("events"),
    )


def session_quality(scope: Scope, width: int) -> DataFrame:
    """Sessions by the bucket they start in, with bounce rate, duration and depth."""
    started = session_facts(scope.rows()).withColumn("bucket", bucket_of("start_ts", scope.window.from_ms, width))
    views = F.col("pageviews")
    return started.groupBy("site_id", "bucket").agg(
        F.count(F.lit(1)).alias("sessions"),
        percent(count_when(views == 1), count_when(views > 0)).alias("bounce_rate"),
        round_to(F.avg(span_seconds())).alias("duration"),
        ratio(F.sum(views), F.count(F.lit(1)), 2).alias("pages_per_session"),
    )


def errors(scope: Scope, width: int) -> DataFrame:
    """Script errors and the sessions they hit."""
    hit = scope.rows().where("name = 'error'").withColumn("bucket", bucket_of("ts", scope.window.from_ms, width))
    return hit.groupBy("site_id", "bucket").agg(
        F.count(F.lit(1)).alias("errors"), distinct("session_id").alias("sessions")
    )


# Per series: its builder, the columns an empty bucket counts as 0 and those it leaves null.
SERIES = {
    "timeseries": (traffic, ["views", "visitors", "sessions", "events"], []),
    "timeseries.sessions": (session_quality, ["sessions"], ["bounce_rate", "duration", "pages_per_session"]),
    "errors.series": (errors, ["errors", "sessions"], []),
}


def dense(
    scope: Scope, sparse: DataFrame, width: int, counts: list[str], ratios: list[str], max_points: int | None = None
) -> DataFrame:
    """Every bucket of the axis; a count is 0 where nothing happened, a ratio stays null."""
    points = max(1, math.ceil(scope.window.span / width))
    if max_points is not None:
        points = min(max_points, points)
    columns = counts + ratios
    # At most ``points`` rows per site are gathered, so the group is bounded.
    near = sparse.where((F.col("bucket") >= 0) & (F.col("bucket") < points))
    gathered = scope.per_site(near, F.collect_list(F.struct("bucket", F.struct(*columns).alias("v"))).alias("held"))
    axis = gathered.select(
        "site_id", F.map_from_entries("held").alias("held"), F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("bucket")
    ).select("site_id", F.col("bucket").cast("long").alias("bucket"), F.try_element_at("held", F.col("bucket").cast("long")).alias("v"))
    return axis.select(
        "site_id",
        "bucket",
        (F.col("bucket") * F.lit(width) + F.lit(scope.window.from_ms)).alias("ts"),
        *[F.coalesce(F.col(f"v.{c}"), F.lit(0)).alias(c) for c in counts],
        *[F.col(f"v.{c}").alias(c) for c in ratios],
    )


def series(scope: Scope, metric: str, granularity: str | None = None, max_points: int | None = None) -> DataFrame:
    """A dense series by metric id."""
    build, counts, ratios = SERIES[metric]
    width = bucket_width(scope.window, granularity)
    return dense(scope, build(scope, width), width, counts, ratios, max_points)


def series_with_previous(scope: Scope, metric: str, granularity: str | None = None) -> DataFrame:
    """The series beside the same buckets of the previous period."""
    _, counts, ratios = SERIES[metric]
    current = series(scope, metric, granularity)
    earlier = series(scope.at(scope.window.previous()), metric, granularity)
    renamed = earlier.select("site_id", "bucket", *[F.col(c).alias(f"previous_{c}") for c in counts + ratios])
    return current.join(renamed, ["site_id", "bucket"], "left")
