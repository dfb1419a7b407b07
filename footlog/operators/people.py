"""People over all time: status, actions, plans and one person in detail."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footlog.functions.aliases import person_alias
from footlog.functions.values import count_when, day_of, prop
from footlog.model import DAY_MS, Scope, audience, is_action, is_pageview
from footlog.operators.lifecycle import PERSON
from footlog.operators.ordered import top_per
from footlog.sources.people_days import ACTION, VISIT, action_rows, once

SEGMENTS = ["all", "returning", "one_time", "signed_up_only"]
SORTS = {"last_active": "last_ts", "joined": "first_ts", "actions": "actions", "active_days": "days", "visits": "visits"}


class PeopleError(ValueError):
    """A people list that cannot be made as asked."""


def _own(scope: Scope) -> DataFrame:
    return scope.site_events().where((F.col("identity") != "") & audience("human"))


def _visits(scope: Scope) -> DataFrame:
    """The ledger's visits of people over all history, each append once; people reports ignore the strict audience."""
    return once(scope.site_people().visits, VISIT).where(F.col("who").isin("strict", "suspect"))


def _person_days(scope: Scope) -> DataFrame:
    """Times, actions and latest plan of each person, visit and day; from the ledger where the scope has one."""
    if scope.people is not None:
        return _visits(scope).select(
            *PERSON, "session_id", "day", F.col("first_ts").alias("lo"), F.col("last_ts").alias("hi"), F.col("actions").alias("acts"), "planned"
        )
    plan = prop("plan")
    return _own(scope).groupBy(*PERSON, "session_id", day_of().alias("day")).agg(
        F.min("ts").alias("lo"),
        F.max("ts").alias("hi"),
        count_when(is_action()).alias("acts"),
        F.max(F.when(plan.isNotNull(), F.struct("ts", "ingest_seq", plan.alias("plan")))).alias("planned"),
    )


def people(scope: Scope) -> DataFrame:
    """One row per identified person over all history; the scope's window does not apply."""
    # Folded to (person, session, day) first: the distinct counts then run over few rows.
    grouped = _person_days(scope).groupBy(*PERSON).agg(
        F.min("lo").alias("first_ts"),
        F.max("hi").alias("last_ts"),
        F.countDistinct("day").alias("days"),
        F.countDistinct("session_id").alias("visits"),
        F.sum("acts").cast("long").alias("actions"),
        F.max("planned").alias("planned"),
    )
    status = F.when(F.col("days") >= 2, "returning").when(F.col("actions") > 0, "one_time").otherwise("signed_up_only")
    return grouped.select(
        *PERSON, status.alias("status"), "actions", "days", "visits", "first_ts", "last_ts", F.col("planned.plan").alias("plan")
    )


def picked_people(scope: Scope, segment: str = "all", plan: str = "", ids: tuple[str, ...] = ()) -> DataFrame:
    """the people of a segment, a plan and named ids."""
    if segment not in SEGMENTS:
        raise PeopleError(f"segment must be one of {', '.join(SEGMENTS)}")
    rows = people(scope)
    if segment != "all":
        rows = rows.where(F.col("status") == segment)
    if plan:
        rows = rows.where(F.col("plan") == plan.lower())
    if ids:
        rows = rows.where(F.col("identity").isin(list(ids)))
    return rows


def list_people(
    scope: Scope,
    segment: str = "all",
    sort: str = "last_active",
    plan: str = "",
    ids: tuple[str, ...] = (),
    limit: int | None = 50,
    offset: int = 0,
) -> DataFrame:
    """one page of people per site."""
    if sort not in SORTS:
        raise PeopleError(f"sort must be one of {', '.join(SORTS)}")
    order = [F.desc(SORTS[sort]), F.asc("identity")]
    page = top_per(picked_people(scope, segment, plan, ids), limit, order, offset=max(0, offset))
    return page.withColumn("alias", person_alias(F.col("identity")))


def count_people(scope: Scope, segment: str = "all", plan: str = "", ids: tuple[str, ...] = ()) -> DataFrame:
    """F24 total: how many people the pages hold."""
    return scope.per_site(picked_people(scope, segment, plan, ids), F.count(F.lit(1)).alias("total"))


def summary(scope: Scope, now_ms: int) -> DataFrame:
    """people by status, recently active, and new."""
    status, week, month = F.col("status"), now_ms - 7 * DAY_MS, now_ms - 30 * DAY_MS
    counts = {
        "returning": status == "returning",
        "one_time": status == "one_time",
        "signed_up_only": status == "signed_up_only",
        "active_7d": F.col("last_ts") >= week,
        "active_30d": F.col("last_ts") >= month,
        "new_30d": F.col("first_ts") >= month,
        "new_30d_returned": (F.col("first_ts") >= month) & (F.col("days") >= 2),
    }
    named = [F.coalesce(count_when(c), F.lit(0)).alias(name) for name, c in counts.items()]
    return scope.per_site(people(scope), F.count(F.lit(1)).alias("known"), *named)


def _daily_actions(scope: Scope) -> DataFrame:
    """Actions of each person, day and name; from the ledger where the scope has one."""
    if scope.people is not None:
        return once(scope.site_people().actions, ACTION)
    return action_rows(scope.site_events())


def top_actions(scope: Scope, page: DataFrame | None = None, limit: int | None = 3) -> DataFrame:
    """the most frequent actions of each person (of a page of people, when given)."""
    daily = _daily_actions(scope)
    if page is not None:
        daily = daily.join(page.select(*PERSON), PERSON, "left_semi")
    acts = daily.groupBy(*PERSON, "name").agg(F.sum("n").cast("long").alias("n"))
    return top_per(acts, limit, [F.desc("n"), F.asc("name")], PERSON)


def by_plan(scope: Scope, limit: int | None = 20) -> DataFrame:
    """people by the latest plan they carried."""
    planned = people(scope).where(F.col("plan").isNotNull())
    return top_per(planned.groupBy("site_id", "plan").agg(F.count(F.lit(1)).alias("users")), limit, [F.desc("users"), F.asc("plan")])


def actions_by_day(scope: Scope, identity: str | None = None, days: int = 14) -> DataFrame:
    """actions per day and name over each person's newest active days."""
    acts = _daily_actions(scope)
    if identity:
        acts = acts.where(F.col("identity") == identity)
    named = acts.groupBy(*PERSON, "day", "name").agg(F.sum("n").cast("long").alias("n"))
    # Days are ranked on their own; names, which clients choose, are never gathered in a list.
    daily = named.groupBy(*PERSON, "day").agg(F.sum("n").cast("long").alias("total"))
    newest = top_per(daily, days, [F.desc("day")], PERSON)
    placed = newest.join(named, [*PERSON, "day"])
    return placed.select(*PERSON, (F.unix_date("day").cast("long") * DAY_MS).alias("day"), "total", "name", "n")


def latest_visits(scope: Scope, identity: str | None = None, limit: int | None = 10) -> DataFrame:
    """each person's latest visits."""
    if scope.people is not None:
        own = _visits(scope)
        started, ended, pages, actions = F.min("first_ts"), F.max("last_ts"), F.sum("pages"), F.sum("actions")
    else:
        own = _own(scope)
        started, ended, pages, actions = F.min("ts"), F.max("ts"), count_when(is_pageview()), count_when(is_action())
    if identity:
        own = own.where(F.col("identity") == identity)
    visits = own.groupBy(*PERSON, "session_id").agg(
        started.alias("started"), ended.alias("ended"), pages.cast("long").alias("pages"), actions.cast("long").alias("actions")
    )
    return top_per(visits, limit, [F.desc("started"), F.asc("session_id")], PERSON)
