"""Journeys, goals and ordered funnels.

All three look at sessions in order. None gathers a session's rows in one place: rows are folded inside
time slices first, and only the bounded slice summaries of a session meet.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from footlog.functions.values import PROPERTY_KEY, count_when, distinct, flag, percent, prop_text
from footlog.model import HOUR_MS, MINUTE_MS, Scope, is_event, is_pageview
from footlog.operators.filters import FilterError
from footlog.operators.ordered import SLICE, slice_of, top_per

MAX_STEPS = 8


# Journeys


def session_paths(views: DataFrame, steps: int, slice_ms: int = HOUR_MS) -> DataFrame:
    """The first ``steps`` pages of each session with consecutive repeats collapsed, as an array."""
    sliced = views.select("site_id", "session_id", "path", "ts", "ingest_seq", slice_of(slice_ms).alias(SLICE))
    group = ["site_id", "session_id", SLICE]
    in_slice = W.partitionBy(*group).orderBy("ts", "ingest_seq")
    before = F.lag("path").over(in_slice)
    moves = sliced.withColumn("_prev", before).where(F.col("_prev").isNull() | (F.col("_prev") != F.col("path")))
    numbered = moves.withColumn("_rn", F.row_number().over(in_slice)).where(F.col("_rn") <= steps)
    # At most ``steps`` rows per slice, then one short array per slice of a session.
    pieces = numbered.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("_rn", "path"))).alias("_moves"))
    whole = pieces.groupBy("site_id", "session_id").agg(
        F.sort_array(F.collect_list(F.struct(SLICE, F.col("_moves.path").alias("paths")))).alias("_slices")
    )

    def joined(done: Column, piece: Column) -> Column:
        added = piece.getField("paths")
        repeats = (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1)) == F.get(added, F.lit(0)))
        fresh = F.when(repeats, F.slice(added, 2, steps)).otherwise(added)
        # A full prefix stays as it is, so its last page is never needed again.
        return F.when(F.size(done) >= steps, done).otherwise(F.slice(F.concat(done, fresh), 1, steps))

    empty = F.array().cast("array<string>")
    return whole.select("site_id", "session_id", F.aggregate("_slices", empty, joined).alias("pages"))


def journeys(
    scope: Scope, steps: int = 4, limit: int | None = 20, step_filters: tuple[str | None, ...] = (), slice_ms: int = HOUR_MS
) -> DataFrame:
    """whole page journeys, most common first; short sessions keep empty later steps."""
    if steps < 2:
        raise ValueError("a journey has at least two steps")
    names = [f"p{i + 1}" for i in range(steps)]
    paths = session_paths(scope.rows().where(is_pageview()), steps, slice_ms)
    flat = paths.select("site_id", *[F.get("pages", F.lit(i)).alias(n) for i, n in enumerate(names)])
    for name, wanted in zip(names, step_filters, strict=False):
        wanted = (wanted or "").strip()
        if len(wanted) > 200:
            raise FilterError(f"step {name[1:]} filter is too long")
        if "*" in wanted:
            pattern = ".*".join(re.escape(part) for part in wanted.split("*"))
            flat = flat.where(F.col(name).rlike(f"(?is)^{pattern}$"))
        elif wanted:
            flat = flat.where(F.col(name) == wanted)
    grouped = flat.groupBy("site_id", *names).agg(F.count(F.lit(1)).alias("sessions"))
    return top_per(grouped, limit, [F.desc("sessions"), *[F.asc(n) for n in names]])


def journey_base(scope: Scope) -> DataFrame:
    """F10 total: sessions with at least one pageview in the window."""
    return scope.per_site(scope.rows().where(is_pageview()), distinct("session_id").alias("total_sessions"))


# Goals


class GoalError(ValueError):
    """A goal that cannot be measured."""


@dataclass(frozen=True)
class Goal:
    """A page path (``*`` is one segment, ``**`` the rest) or an event, optionally with one property value."""

    type: str
    value: str
    prop_key: str = ""
    prop_value: str = ""

    def __post_init__(self) -> None:
        if self.type not in ("page", "event"):
            raise GoalError('goal type must be "page" or "event"')
        if not self.value.strip() or len(self.value) > 200:
            raise GoalError("a goal needs a value of at most 200 characters")
        if self.type == "page" and not self.value.startswith("/"):
            raise GoalError("a page goal is a path starting with /")
        if self.prop_key and not re.match(PROPERTY_KEY, self.prop_key):
            raise GoalError("property name may use letters, digits, _ and -")

    def condition(self) -> Column:
        if self.type == "page":
            path = F.col("path")
            return is_pageview() & (path.rlike(path_pattern(self.value)) if "*" in self.value else path == self.value)
        hit = is_event() & (F.col("name") == self.value)
        return hit & (prop_text(self.prop_key) == self.prop_value) if self.prop_key else hit


def path_pattern(pattern: str) -> str:
    """An anchored expression: ``**`` crosses segments, ``*`` stays within one."""
    spans = (("[^/]*".join(re.escape(part) for part in span.split("*"))) for span in pattern.split("**"))
    return "^" + ".*".join(spans) + "$"


def goal(scope: Scope, target: Goal) -> DataFrame:
    """sessions that reached the goal, all sessions, and the rate (null without sessions)."""
    reached = scope.rows().groupBy("site_id", "session_id").agg(flag(target.condition()).alias("hit"))
    done, all_ = F.sum("hit").cast("long"), F.count(F.lit(1))
    return scope.per_site(
        reached, F.coalesce(done, F.lit(0)).alias("conversions"), all_.alias("sessions"), percent(done, all_).alias("rate")
    )


def goal_paths(scope: Scope, target: Goal) -> DataFrame:
    """The concrete paths a wildcard goal matches."""
    return scope.site_events().where(target.condition()).select("site_id", "path").distinct()


# Funnels


class FunnelError(ValueError):
    """A funnel that cannot be measured."""


@dataclass(frozen=True)
class Step:
    type: str
    value: str
    label: str = ""

    def __post_init__(self) -> None:
        if self.type not in ("page", "event"):
            raise FunnelError('a step is of type "page" or "event"')
        if not self.value.strip() or len(self.value) > 200:
            raise FunnelError("a step needs a value of at most 200 characters")

    def condition(self) -> Column:
        if self.type == "page":
            return is_pageview() & (F.col("path") == self.value)
        return is_event() & (F.col("name") == self.value)


# The funnel a site starts with.
DEFAULT_STEPS = {
    "shopify": (
        Step("event", "checkout_started", "Started checkout"),
        Step("event", "checkout_address", "Entered address"),
        Step("event", "checkout_shipping", "Chose shipping"),
        Step("event", "checkout_payment", "Entered payment details"),
        Step("event", "checkout_completed", "Purchased"),
    ),
    "generic": (
        Step("page", "/", "Home page"),
        Step("event", "cta_click", "Clicked the CTA"),
        Step("event", "signup", "Signed up"),
    ),
}


def default_steps(vertical: str = "generic") -> tuple[Step, ...]:
    return DEFAULT_STEPS["shopify" if vertical == "shopify" else "generic"]


def reached_steps(rows: DataFrame, steps: tuple[Step, ...], slice_ms: int = MINUTE_MS) -> DataFrame:
    """How many steps each session completed: step i is its earliest match at or after step i - 1.

    An event is a bit mask of the steps it matches. A slice of events is a small function from "steps
    done before" to "steps done after"; slices of a session are then composed in time order.
    """
    k = len(steps)
    mask = sum((F.when(s.condition(), 1 << i).otherwise(0) for i, s in enumerate(steps)), F.lit(0)).cast("int")
    matching = rows.select("site_id", "session_id", "ts", mask.alias("mask")).where("mask > 0")
    # The set of (time, mask) in one slice has at most slice_ms times the number of masks members.
    slices = matching.withColumn(SLICE, slice_of(slice_ms)).groupBy("site_id", "session_id", SLICE)
    marks = slices.agg(F.sort_array(F.collect_set(F.struct("ts", "mask"))).alias("marks"))
    # Steps gained from state s by mask m: the run of ones at the bottom of m >> s.
    ones = F.array(*[F.lit(next(b for b in range(k + 1) if not (m >> b) & 1)) for m in range(1 << k)])

    def advance(state: Column, mark: Column) -> Column:
        # Marks of one instant count together, whatever order they arrived in.
        same = state.getField("ts") == mark.getField("ts")
        held = F.when(same, state.getField("mask").bitwiseOR(mark.getField("mask"))).otherwise(mark.getField("mask"))
        # The shift runs through division: the number of done steps is data.
        rest = F.floor(held / F.pow(F.lit(2.0), state.getField("done"))).cast("int")
        gained = F.get(ones, rest)
        return F.struct(mark.getField("ts").alias("ts"), held.alias("mask"), (state.getField("done") + gained).alias("done"))

    def run_from(start: int) -> Column:
        zero = F.struct(F.lit(-1).cast("long").alias("ts"), F.lit(0).alias("mask"), F.lit(start).alias("done"))
        return F.aggregate("marks", zero, advance, lambda state: state.getField("done"))

    moves = marks.select("site_id", "session_id", SLICE, F.array(*[run_from(s) for s in range(k)], F.lit(k)).alias("to"))
    ordered = moves.groupBy("site_id", "session_id").agg(F.sort_array(F.collect_list(F.struct(SLICE, "to"))).alias("path"))
    done = F.aggregate("path", F.lit(0), lambda state, piece: F.get(piece.getField("to"), state))
    return ordered.select("site_id", "session_id", done.alias("done"))


def funnel(scope: Scope, steps: tuple[Step, ...] | None = None, audience: str = "human") -> DataFrame:
    """one row per step with sessions, step rate, total rate and drop; the largest drop is marked."""
    steps = steps or default_steps()
    if not 2 <= len(steps) <= MAX_STEPS:
        raise FunnelError(f"a funnel takes 2 to {MAX_STEPS} steps")
    reached = reached_steps(scope.rows(audience), steps)
    counts = scope.per_site(reached, F.array(*[count_when(F.col("done") > i) for i in range(len(steps))]).alias("n"))
    return funnel_rows(counts, steps)


def funnel_rows(counts: DataFrame, steps: tuple[Step, ...]) -> DataFrame:
    """Rates and drops from the per-site array ``n`` of sessions per step."""
    n = [F.coalesce(F.get("n", F.lit(i)), F.lit(0)) for i in range(len(steps))]
    drops = [F.lit(0).cast("long")] + [F.greatest(n[i - 1] - n[i], F.lit(0).cast("long")) for i in range(1, len(steps))]
    worst = F.array_position(F.array(*drops), F.array_max(F.array(*drops))) - 1
    rows = []
    for i, step in enumerate(steps):
        back = F.lit(100.0) if i == 0 else F.coalesce(percent(n[i], n[i - 1]), F.lit(0.0))
        rows.append(
            F.struct(
                F.lit(i).alias("step"),
                F.lit(step.type).alias("type"),
                F.lit(step.value).alias("value"),
                F.lit(step.label or step.value).alias("label"),
                n[i].alias("sessions"),
                back.alias("step_rate"),
                F.coalesce(percent(n[i], n[0]), F.lit(0.0)).alias("total_rate"),
                drops[i].alias("dropped"),
                ((drops[i] > 0) & (worst == i)).alias("worst"),
            )
        )
    return counts.select("site_id", F.explode(F.array(*rows)).alias("s")).select("site_id", "s.*")
