"""Single-number metrics (E4 to E10 and the other scalars): one row per site."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footlog.functions.values import count_when, distinct, flag, number, percent, ratio, round_to
from footlog.model import LIVE_MS, SUSPECT_SCORE, Scope, is_pageview
from footlog.sources import distinct_days

SIGNUP_EVENTS = "name IN ('signup', 'waitlist', 'conversion')"  # fixed values
CAMPAIGN_SITES = ("landing", "generic")


@dataclass(frozen=True)
class Scalar:
    """``counts`` is what is counted: rows, or distinct sessions or visitors."""

    counts: str
    where: str = "true"
    who: str = "human"
    unit: str = "count"
    verticals: tuple[str, ...] | None = None


SCALARS = {
    "visitors.unique": Scalar("visitors"),
    "sessions.total": Scalar("sessions"),
    "pageviews.total": Scalar("rows", "type = 'pageview'"),
    "ai.sessions": Scalar("sessions", "channel = 'ai'"),
    "ai.crawler.hits": Scalar("rows", "bot_kind = 'ai-crawler'", "everyone"),
    "bots.suspected": Scalar("visitors", f"bot_score >= {SUSPECT_SCORE}"),
    "agent.sessions": Scalar("sessions", who="agent"),
    "agent.pageviews": Scalar("rows", "type = 'pageview'", "agent"),
    "agents.verified": Scalar("rows", "agent_trust = 'verified'", "everyone"),
    "agents.claimed": Scalar("rows", "agent_trust = 'claimed'", "everyone"),
    "errors.total": Scalar("rows", "name = 'error'"),
    "cta.clicks": Scalar("rows", "name = 'cta_click'", verticals=CAMPAIGN_SITES),
    "rage.clicks": Scalar("rows", "name = 'rage_click'", verticals=CAMPAIGN_SITES),
    "signups.total": Scalar("rows", SIGNUP_EVENTS, verticals=CAMPAIGN_SITES),
}
_COUNTED = {"sessions": "session_id", "visitors": "visitor_id"}


def counted(scope: Scope, metric: str) -> DataFrame:
    """A plain count: events, sessions or visitors meeting one condition."""
    if scope.distincts is not None and not scope.filters and metric in distinct_days.METRICS:
        return distinct_days.counted(scope, metric)
    spec = SCALARS[metric]
    rows = scope.rows(spec.who).where(spec.where)
    value = F.count(F.lit(1)) if spec.counts == "rows" else distinct(_COUNTED[spec.counts])
    return scope.per_site(rows, value.alias("value"))


def live_visitors(scope: Scope, now_ms: int) -> DataFrame:
    """Visitors of the last five minutes; the window has no upper end."""
    from footlog.operators.filters import apply_filters

    recent = scope.site_events().where(scope.since(now_ms - LIVE_MS) & scope.who())
    recent = apply_filters(recent, scope.site_events(), scope.filters)
    return scope.per_site(recent, distinct("visitor_id").alias("value"))


def session_facts(rows: DataFrame) -> DataFrame:
    """One row per session: first and last time and pageviews."""
    return rows.groupBy("site_id", "session_id").agg(
        F.min("ts").alias("start_ts"),
        F.max("ts").alias("end_ts"),
        count_when(is_pageview()).alias("pageviews"),
    )


def span_seconds() -> Column:
    return (F.col("end_ts") - F.col("start_ts")) / 1000.0


def bounce_rate(scope: Scope) -> DataFrame:
    """Sessions with one pageview among sessions with any; 0 with no session."""
    viewed = scope.rows().where(is_pageview()).groupBy("site_id", "session_id").agg(F.count(F.lit(1)).alias("views"))
    value = percent(count_when(F.col("views") == 1), F.count(F.lit(1)))
    return scope.per_site(viewed, F.coalesce(value, F.lit(0.0)).alias("value"))


def visit_duration(scope: Scope) -> DataFrame:
    """Mean session length in whole seconds; a single-event session lasts 0."""
    value = round_to(F.avg(span_seconds()))
    return scope.per_site(session_facts(scope.rows()), F.coalesce(value, F.lit(0.0)).alias("value"))


def views_per_session(scope: Scope) -> DataFrame:
    """E10."""
    value = ratio(F.sum("pageviews"), F.count(F.lit(1)), 2)
    return scope.per_site(session_facts(scope.rows()), F.coalesce(value, F.lit(0.0)).alias("value"))


def cta_conversion(scope: Scope) -> DataFrame:
    """Share of sessions with a call-to-action click."""
    clicked = scope.rows().groupBy("site_id", "session_id").agg(flag(F.col("name") == "cta_click").alias("clicked"))
    value = percent(F.sum("clicked"), F.count(F.lit(1)))
    return scope.per_site(clicked, F.coalesce(value, F.lit(0.0)).alias("value"))


def scroll_depth(scope: Scope) -> DataFrame:
    """Mean scrolled percent; 0 when none was reported."""
    value = round_to(F.avg(number("percent")), 1)
    return scope.per_site(scope.rows().where("name = 'scroll'"), F.coalesce(value, F.lit(0.0)).alias("value"))


DERIVED = {
    "bounce.rate": (bounce_rate, "percent", None),
    "visit.duration": (visit_duration, "seconds", None),
    "views.per_session": (views_per_session, "ratio", None),
    "cta.conversion": (cta_conversion, "percent", CAMPAIGN_SITES),
    "scroll.depth": (scroll_depth, "percent", CAMPAIGN_SITES),
}


def scalar(scope: Scope, metric: str) -> DataFrame:
    """Any scalar metric by id."""
    return DERIVED[metric][0](scope) if metric in DERIVED else counted(scope, metric)
