"""User lifecycle: growth accounting, plans, one-and-done, privacy check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footlog.functions.values import (
    bucket_of, count_when, day_of, distinct, in_order, number, percent, prop, ratio,
)
from footlog.model import DAY_MS, MINUTE_MS, Scope
from footlog.operators.ordered import top_per, with_neighbour
from footlog.sources.people_days import taken_in, visits_until_end

ONE_AND_DONE_DAYS = 7
# Plans that do not pay, and the lifecycle events counted on their own.
FREE_PLANS = ["free", "trial", "none", "cancelled", "canceled", "expired", "inactive"]
LIFECYCLE_EVENTS = ["signup", "login", "logout"]
PERSON = ["site_id", "identity"]


def identified(scope: Scope, until_only: bool = True) -> DataFrame:
    """Events of identified people; filters do not apply to people reports."""
    return scope.rows(until_only=until_only, filtered=False).where(F.col("identity") != "")


def seen(scope: Scope, *moments: int) -> DataFrame:
    """When people were seen until the window's end, as ``ts``: of every visit and day the first event if the scope has a ledger.

    A row then stands for a visit's events of one day between two of the ``moments``; without a ledger for one event.
    """
    if scope.people is None:
        return identified(scope).select(*PERSON, "ts")
    return visits_until_end(scope, *moments).where(taken_in(scope)).select(*PERSON, F.col("first_ts").alias("ts"))


def people_flags(scope: Scope) -> DataFrame:
    """One row per person: first time seen, and active now or in the previous window."""
    earlier = scope.window.previous()
    return seen(scope, earlier.from_ms, scope.window.from_ms).groupBy(*PERSON).agg(
        F.min("ts").alias("first_ts"),
        F.max(F.when(scope.window.contains(), 1).otherwise(0)).alias("cur"),
        F.max(F.when(earlier.contains(), 1).otherwise(0)).alias("prev"),
    )


def people_states(scope: Scope) -> DataFrame:
    """``people_flags`` and the latest ``plan`` of each person, null without any, in one fold."""
    earlier = scope.window.previous()
    if scope.people is None:
        planned = F.when(F.col("plan").isNotNull(), F.struct("ts", "ingest_seq", "plan"))
        rows = identified(scope).select(*PERSON, "ts", "ingest_seq", prop("plan").alias("plan")).withColumn("planned", planned)
    else:
        held = visits_until_end(scope, earlier.from_ms, scope.window.from_ms).where(taken_in(scope))
        rows = held.select(*PERSON, F.col("first_ts").alias("ts"), "planned")
    return rows.groupBy(*PERSON).agg(
        F.min("ts").alias("first_ts"),
        F.max(F.when(scope.window.contains(), 1).otherwise(0)).alias("cur"),
        F.max(F.when(earlier.contains(), 1).otherwise(0)).alias("prev"),
        F.max("planned").getField("plan").alias("plan"),
    )


def accounting_columns(from_ms: int) -> list[Column]:
    cur, prev, new = F.col("cur") == 1, F.col("prev") == 1, F.col("first_ts") >= from_ms
    return [
        F.count(F.lit(1)).alias("known"),
        count_when(cur).alias("active"),
        count_when(prev).alias("prev_active"),
        count_when(cur & new).alias("new_users"),
        count_when(cur & prev).alias("retained"),
        count_when(cur & ~prev & ~new).alias("resurrected"),
        count_when(~cur & prev).alias("churned"),
    ]


def accounting(scope: Scope) -> DataFrame:
    """F16: who stayed, came, came back and left; rates are null on an empty base."""
    counts = scope.per_site(people_flags(scope), *accounting_columns(scope.window.from_ms))
    gained = F.col("new_users") + F.col("resurrected")
    return counts.select(
        "*",
        gained.alias("gained"),
        F.col("churned").alias("lost"),
        (gained - F.col("churned")).alias("net"),
        ratio(gained, F.col("churned"), 2).alias("quick_ratio"),
        percent(F.col("retained"), F.col("prev_active")).alias("retained_rate"),
    )


def one_and_done(scope: Scope) -> DataFrame:
    """people with a full week to come back who were active on one UTC day only."""
    cutoff = scope.window.to_ms - ONE_AND_DONE_DAYS * DAY_MS
    days = seen(scope).groupBy(*PERSON, day_of().alias("day")).agg(F.min("ts").alias("day_first"))
    people = days.groupBy(*PERSON).agg(F.min("day_first").alias("first_ts"), F.count(F.lit(1)).alias("days"))
    eligible = people.where((F.col("first_ts") >= scope.window.from_ms) & (F.col("first_ts") < cutoff))
    once, all_ = count_when(F.col("days") == 1), F.count(F.lit(1))
    return scope.per_site(
        eligible, all_.alias("eligible"), F.coalesce(once, F.lit(0)).alias("one_day"), percent(once, all_).alias("rate")
    )


def lifecycle_events(scope: Scope) -> DataFrame:
    """signups, logins and logouts, with the identified people behind them."""
    rows = scope.rows(filtered=False).where(F.col("name").isin(LIFECYCLE_EVENTS))
    return rows.groupBy("site_id", "name").agg(
        F.count(F.lit(1)).alias("events"), distinct("identity", F.col("identity") != "").alias("users")
    )


def plan_events(scope: Scope) -> DataFrame:
    narrow = identified(scope).select(*PERSON, "ts", "ingest_seq", prop("plan").alias("plan"))
    return narrow.where(F.col("plan").isNotNull())


def latest_plans(scope: Scope) -> DataFrame:
    """One row per person who ever carried a plan: the latest one."""
    if scope.people is not None:
        return last_planned(scope).select(*PERSON, "plan")
    return plan_events(scope).groupBy(*PERSON).agg(F.max_by("plan", in_order()).alias("plan"))


def last_planned(scope: Scope, *moments: int, before: int | None = None) -> DataFrame:
    """Each person's latest plan event in the ledger, until the window's end or ``before`` one of the ``moments``."""
    rows = visits_until_end(scope, *moments).where(taken_in(scope) & F.col("planned").isNotNull())
    if before is not None:
        rows = rows.where(F.col("first_ts") < before)
    return rows.groupBy(*PERSON).agg(F.max("planned").alias("p")).select(*PERSON, "p.ts", "p.ingest_seq", "p.plan")


def plan_history(scope: Scope) -> DataFrame:
    """Plan events until the window's end; with a ledger the window's own and, of each person, the last one before it."""
    if scope.people is None:
        return plan_events(scope)
    start = scope.window.from_ms
    own = scope.rows(filtered=False).where(F.col("identity") != "").select(*PERSON, "ts", "ingest_seq", prop("plan").alias("plan"))
    return own.where(F.col("plan").isNotNull()).unionByName(last_planned(scope, start, before=start))


def plans(scope: Scope, limit: int | None = 20) -> DataFrame:
    """people by current plan."""
    grouped = latest_plans(scope).groupBy("site_id", "plan").agg(F.count(F.lit(1)).alias("users"))
    return top_per(grouped, limit, [F.desc("users"), F.asc("plan")])


def plan_moves(scope: Scope) -> DataFrame:
    """Plan events of the window that crossed between free and paid, with the direction."""
    linked = with_neighbour(plan_history(scope), PERSON, {"before": "plan"}, ahead=False, width_ms=DAY_MS)
    free, was_free = F.col("plan").isin(FREE_PLANS), F.col("before").isin(FREE_PLANS)
    move = F.when(~free & (F.col("before").isNull() | was_free), "became_paying").when(
        free & F.col("before").isNotNull() & ~was_free, "stopped_paying"
    )
    return linked.where(F.col("ts") >= scope.window.from_ms).withColumn("move", move).where(F.col("move").isNotNull())


def plan_changes(scope: Scope) -> DataFrame:
    """people who became paying or stopped, by the plan they moved to."""
    return plan_moves(scope).groupBy("site_id", "move", "plan").agg(distinct("identity").alias("users"))


def active_series(scope: Scope, width: int) -> DataFrame:
    """identified people active per bucket."""
    bucket = bucket_of("ts", scope.window.from_ms, max(MINUTE_MS, width))
    placed = identified(scope, until_only=False).withColumn("bucket", bucket)
    return placed.groupBy("site_id", "bucket").agg(distinct("identity").alias("active"))


def new_series(scope: Scope, width: int) -> DataFrame:
    """people by the bucket they were first seen in."""
    firsts = seen(scope).groupBy(*PERSON).agg(F.min("ts").alias("first_ts"))
    bucket = bucket_of("first_ts", scope.window.from_ms, max(MINUTE_MS, width))
    fresh = firsts.where(F.col("first_ts") >= scope.window.from_ms).withColumn("bucket", bucket)
    return fresh.groupBy("site_id", "bucket").agg(F.count(F.lit(1)).alias("new_users"))


def privacy_check(scope: Scope) -> DataFrame:
    """raw ids, personal properties removed and plans rejected in the window."""
    rows = scope.rows("everyone", filtered=False)
    raw = F.coalesce(prop("_id_raw").isin("true", "1"), F.lit(False))
    return scope.per_site(
        rows,
        F.coalesce(count_when(raw), F.lit(0)).alias("raw_ids"),
        F.coalesce(F.sum(number("_pii_dropped")), F.lit(0)).cast("long").alias("pii_dropped"),
        F.coalesce(count_when(prop("_plan_rejected").isNotNull()), F.lit(0)).alias("plan_rejected"),
    )


def data_from(scope: Scope) -> DataFrame:
    """the oldest identified event, of any audience; null without one."""
    if scope.people is not None:
        return scope.per_site(scope.site_people().visits, F.min("first_ts").alias("data_from"))
    return scope.per_site(scope.site_events().where(F.col("identity") != ""), F.min("ts").alias("data_from"))
