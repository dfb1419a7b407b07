"""Revenue, one currency at a time."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footlog.functions.values import bucket_of, count_when, in_order, number, percent, prop, ratio, round_to
from footlog.functions.values import per_visitor as folded
from footlog.model import MINUTE_MS, Scope
from footlog.operators.ordered import top_per
from footlog.sources.session_days import of_sessions

ACQUISITION = ["channel", "source", "utm_campaign"]
DIMENSIONS = [*ACQUISITION, "name", "path", "country", "device"]


class RevenueError(ValueError):
    """A revenue report that cannot be made as asked."""


def payments(scope: Scope, audience: str = "human") -> DataFrame:
    """Events that carry an amount, with ``amount`` and ``currency`` read out."""
    paid = scope.rows(audience).where(prop("revenue").isNotNull())
    return paid.withColumn("amount", number("revenue")).withColumn("currency", prop("currency"))


def _checked(currency: str | None) -> None:
    if currency is not None and not re.fullmatch(r"[A-Z]{3}", currency):
        raise RevenueError("currency must be a three-letter ISO 4217 code, e.g. USD")


def _sum() -> Column:
    return round_to(F.sum("amount"), 4).alias("revenue")


def _one_currency(rows: DataFrame, scope: Scope, currency: str | None) -> DataFrame:
    """Rows of the named currency, else of each site's largest; never summed across currencies."""
    _checked(currency)
    if currency is not None:
        return rows.where(F.col("currency") == currency)
    return rows.join(default_currency(scope), ["site_id", "currency"])


def currencies(scope: Scope) -> DataFrame:
    """revenue and orders per currency."""
    return payments(scope).groupBy("site_id", "currency").agg(_sum(), F.count(F.lit(1)).alias("orders"))


def default_currency(scope: Scope) -> DataFrame:
    """each site's currency with the most revenue."""
    return top_per(currencies(scope), 1, [F.desc("revenue"), F.asc("currency")]).select("site_id", "currency")


def totals(scope: Scope, currency: str | None = None) -> DataFrame:
    """revenue, orders and paying sessions now and before, in one pass over both windows.

    A named currency has a row for every site with people in these windows, all zero where nothing was sold in it.
    """
    _checked(currency)
    both = scope.at(scope.window.joined(scope.window.previous()))
    now = scope.window.contains()
    paid = payments(both)
    if currency is not None:
        # One row per session, with or without payments: a site without sales stays.
        mine = prop("revenue").isNotNull() & F.coalesce(prop("currency") == currency, F.lit(False))
        paid = both.rows().withColumn("amount", F.when(mine, number("revenue"))).withColumn("currency", F.lit(currency))
        now, before = mine & now, mine & ~now
    else:
        before = ~now
    # One row per paying session keeps the distinct count out of the final sums.
    folded = paid.groupBy("site_id", "currency", "session_id").agg(
        F.sum(F.when(now, F.col("amount"))).alias("a"),
        count_when(now).alias("an"),
        F.sum(F.when(before, F.col("amount"))).alias("b"),
        count_when(before).alias("bn"),
    )
    table = folded.groupBy("site_id", "currency").agg(
        round_to(F.coalesce(F.sum("a"), F.lit(0.0)), 4).alias("revenue"),
        F.sum("an").cast("long").alias("orders"),
        count_when(F.col("an") > 0).alias("sessions"),
        round_to(F.coalesce(F.sum("b"), F.lit(0.0)), 2).alias("previous_revenue"),
        F.sum("bn").cast("long").alias("previous_orders"),
        count_when(F.col("bn") > 0).alias("previous_sessions"),
    )
    if currency is not None:
        return table
    return top_per(table.where(F.col("orders") > 0), 1, [F.desc("revenue"), F.asc("currency")])


def per_visitor(scope: Scope, currency: str | None = None) -> DataFrame:
    """order value, revenue per visitor and conversion; null on an empty base."""
    people = scope.per_site(
        folded(scope.rows(), ["site_id"], {}),
        F.count(F.lit(1)).alias("visitors"),
        F.coalesce(F.sum("sessions"), F.lit(0)).cast("long").alias("all_sessions"),
    )
    paid = totals(scope, currency)
    money = round_to(F.coalesce(F.col("revenue"), F.lit(0.0)), 2)
    known = F.col("currency").isNotNull()
    return people.join(paid, "site_id", "left").select(
        "site_id",
        "currency",
        "visitors",
        F.col("all_sessions").alias("sessions"),
        ratio(money, F.when(F.col("orders") > 0, F.col("orders")), 2).alias("average_order_value"),
        F.when(known, ratio(money, F.col("visitors"), 2)).alias("revenue_per_visitor"),
        F.when(known, percent(F.coalesce(paid["sessions"], F.lit(0)), F.col("all_sessions"), 2)).alias("conversion_rate"),
    )


def _first_touch(scope: Scope, spent: DataFrame, by: str) -> DataFrame:
    """Where each paying session came from: its first event, in the side table or among all events of these sessions."""
    sessions = scope.site_sessions()
    if sessions is not None:
        return of_sessions(sessions, spent).select("site_id", "session_id", F.col(f"first.{by}").alias("g"))
    mine = scope.site_events().join(spent.select("site_id", "session_id"), ["site_id", "session_id"], "left_semi")
    return mine.groupBy("site_id", "session_id").agg(F.min_by(by, in_order()).alias("g"))


def breakdown(scope: Scope, by: str = "channel", currency: str | None = None, limit: int | None = 50) -> DataFrame:
    """revenue by where the session came from (its first event ever) or by the payment's own attributes."""
    if by not in DIMENSIONS:
        raise RevenueError(f'cannot break revenue down by "{by}"')
    paid = _one_currency(payments(scope), scope, currency)
    if by in ACQUISITION:
        # Both sides are folded to one row per session before they meet.
        spent = paid.groupBy("site_id", "currency", "session_id").agg(F.sum("amount").alias("amount"), F.count(F.lit(1)).alias("n"))
        first = _first_touch(scope, spent, by)
        rows = spent.join(first, ["site_id", "session_id"])
    else:
        rows = paid.select("site_id", "currency", "amount", F.lit(1).alias("n"), F.col(by).alias("g"))
    grouped = rows.groupBy("site_id", "currency", "g").agg(_sum(), F.sum("n").cast("long").alias("orders"))
    return top_per(grouped, limit, [F.desc("revenue"), F.asc("g")])


def over_time(scope: Scope, width: int, currency: str | None = None) -> DataFrame:
    """revenue per bucket."""
    paid = _one_currency(payments(scope), scope, currency)
    placed = paid.withColumn("bucket", bucket_of("ts", scope.window.from_ms, max(MINUTE_MS, width)))
    return placed.groupBy("site_id", "currency", "bucket").agg(_sum(), F.count(F.lit(1)).alias("orders"))


def agent_revenue(scope: Scope, currency: str | None = None) -> DataFrame:
    """revenue of verified agent sessions, in the people's currency; never added to people's revenue."""
    paid = _one_currency(payments(scope, "agent"), scope, currency)
    return paid.groupBy("site_id", "currency").agg(_sum(), F.count(F.lit(1)).alias("orders"))


def rejected(scope: Scope) -> DataFrame:
    """amounts refused at intake, by reason, of every audience."""
    rows = scope.rows("everyone").withColumn("reason", prop("_revenue_rejected")).where(F.col("reason").isNotNull())
    return rows.groupBy("site_id", "reason").agg(F.count(F.lit(1)).alias("events"))
