"""Where sessions come from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footlog.functions.values import count_when, distinct, flag, in_order
from footlog.model import Scope, is_event, is_pageview
from footlog.operators.ordered import top_per

_FIRST = "country region region_name city lat lon browser os device channel source referrer_host".split()


def coverage(scope: Scope) -> DataFrame:
    """how many sessions carry each level of location."""
    levels = {
        "with_country": F.col("country") != "",
        "with_region": F.col("region") != "",
        "with_city": F.col("city") != "",
        "with_coords": F.col("lat").isNotNull(),
    }
    folded = scope.rows().groupBy("site_id", "session_id").agg(*[flag(c).alias(n) for n, c in levels.items()])
    return scope.per_site(
        folded,
        F.count(F.lit(1)).alias("sessions"),
        *[F.coalesce(F.sum(n), F.lit(0)).cast("long").alias(n) for n in levels],
    )


def countries(scope: Scope) -> DataFrame:
    """sessions by country, all of them."""
    return scope.rows().where("country <> ''").groupBy("site_id", "country").agg(distinct("session_id").alias("sessions"))


def regions(scope: Scope, limit: int | None = None) -> DataFrame:
    """sessions by subdivision."""
    grouped = scope.rows().where("region <> ''").groupBy("site_id", "region").agg(
        F.max("region_name").alias("region_name"), distinct("session_id").alias("sessions")
    )
    return top_per(grouped, limit, [F.desc("sessions"), F.asc("region")])


def points(scope: Scope, limit: int | None = None) -> DataFrame:
    """sessions by 0.1 degree cell."""
    grouped = scope.rows().where("lat IS NOT NULL AND lon IS NOT NULL").groupBy("site_id", "lat", "lon").agg(
        F.max("city").alias("city"), F.max("country").alias("country"), distinct("session_id").alias("sessions")
    )
    return top_per(grouped, limit, [F.desc("sessions"), F.asc("lat"), F.asc("lon")])


def sessions(scope: Scope, limit: int | None = None) -> DataFrame:
    """the latest sessions with the place they started in, first and last path of any event."""
    grouped = scope.rows().groupBy("site_id", "session_id").agg(
        F.min("ts").alias("started"),
        F.max("ts").alias("ended"),
        count_when(is_pageview()).alias("pageviews"),
        count_when(is_event()).alias("events"),
        F.min_by(F.struct(*_FIRST, "path"), in_order()).alias("_first"),
        F.max_by("path", in_order()).alias("exit"),
    )
    page = top_per(grouped, limit, [F.desc("started"), F.asc("session_id")])
    return page.select(
        "site_id", "session_id", "started", "ended", "pageviews", "events",
        *[F.col(f"_first.{c}").alias(c) for c in _FIRST], F.col("_first.path").alias("entry"), "exit",
    )


def with_country_names(rows: DataFrame, countries_table: DataFrame) -> DataFrame:
    """add country names and centroids from a table (code, name, lat, lon); unknown codes stay."""
    named = countries_table.select(
        F.upper("code").alias("_code"),
        F.col("name").alias("country_name"),
        F.col("lat").alias("country_lat"),
        F.col("lon").alias("country_lon"),
    )
    joined = rows.join(named, F.upper("country") == F.col("_code"), "left").drop("_code")
    return joined.withColumn("country_name", F.coalesce("country_name", "country"))


def report(scope: Scope, countries_table: DataFrame | None = None) -> dict[str, DataFrame]:
    """every geo table by id."""
    by_country = countries(scope)
    if countries_table is not None:
        by_country = with_country_names(by_country, countries_table)
    return {
        "geo.coverage": coverage(scope),
        "geo.countries": by_country,
        "geo.regions": regions(scope),
        "geo.points": points(scope),
        "geo.sessions": sessions(scope),
    }
