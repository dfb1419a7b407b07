"""Ranked tables (the E rows that list values): one group per site and value."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footlog.functions.values import bucket_of, distinct, in_order, number, per_visitor, prop, round_to
from footlog.model import DAY_MS, HOUR_MS, Scope, is_pageview
from footlog.operators.ordered import top_per, with_neighbour
from footlog.operators.scalars import CAMPAIGN_SITES, SIGNUP_EVENTS
from footlog.sources import vital_days

PAGEVIEWS = "type = 'pageview'"


@dataclass(frozen=True)
class Breakdown:
    """``by`` maps output names to columns (``props.x`` reads a property); ``show`` maps names to measures."""

    by: dict[str, str]
    show: dict[str, str]
    where: str = "true"
    limit: int | None = 100
    who: str = "human"
    order: tuple[str, ...] = ()
    ties: tuple[str, ...] = ()
    verticals: tuple[str, ...] | None = None

    def keys(self) -> list[Column]:
        return [
            (prop(source[6:]) if source.startswith("props.") else F.col(source)).alias(name)
            for name, source in self.by.items()
        ]

    def ranking(self) -> list[Column]:
        first = list(self.order) or [next(iter(self.show))]
        ties = [t for t in self.ties] + [k for k in self.by if k not in self.ties]
        return [F.desc(m) for m in first] + [F.asc(k) for k in ties]


def _by(column: str, where: str = "true", limit: int | None = 100) -> Breakdown:
    return Breakdown({column: column}, {"sessions": "sessions"}, where, limit)


def _known(column: str, limit: int = 100) -> Breakdown:
    return _by(column, f"{column} <> ''", limit)


def _viewed(column: str, where: str) -> Breakdown:
    return Breakdown({column: column}, {"views": "rows", "sessions": "sessions"}, where)


BREAKDOWNS: dict[str, Breakdown] = {
    "channels.sessions": _by("channel", limit=None),
    "ai.sources": _by("source", "channel = 'ai'", None),
    "ai.landing_pages": _by("path", f"channel = 'ai' AND {PAGEVIEWS}", 10),
    "ai.crawler.pages": Breakdown(
        {"path": "path", "bot_name": "bot_name"}, {"hits": "rows"}, "bot_kind = 'ai-crawler'", 10, "everyone"
    ),
    "pages.top": _viewed("path", PAGEVIEWS),
    "titles.top": _viewed("title", f"{PAGEVIEWS} AND title <> ''"),
    "hostnames.top": _viewed("hostname", f"{PAGEVIEWS} AND hostname <> ''"),
    "referrers.top": _known("referrer_host"),
    "events.top": Breakdown({"name": "name"}, {"count": "rows", "sessions": "sessions"}, "type = 'event'"),
    "outbound.links": Breakdown(
        {"host": "props.host"}, {"clicks": "rows", "sessions": "sessions"}, "name = 'outbound_click'"
    ),
    "downloads.files": Breakdown(
        {"file": "props.file"}, {"downloads": "rows", "sessions": "sessions"}, "name = 'file_download'"
    ),
    "devices.sessions": _by("device", limit=None),
    "browsers.sessions": _by("browser", limit=50),
    "os.sessions": _by("os", limit=50),
    "screens.sessions": _known("screen"),
    "languages.sessions": _known("lang"),
    "countries.sessions": _known("country", 250),
    "regions.sessions": Breakdown(
        {"region": "region"},
        {"sessions": "sessions", "region_name": "region_name", "country": "country"},
        "region <> ''",
    ),
    "cities.sessions": Breakdown({"city": "city"}, {"sessions": "sessions", "country": "country"}, "city <> ''"),
    "utm.campaigns": Breakdown(
        {"source": "utm_source", "medium": "utm_medium", "campaign": "utm_campaign"},
        {"sessions": "sessions"},
        "utm_source <> '' OR utm_campaign <> ''",
        15,
        ties=("campaign",),
    ),
    **{f"utm.{part}": _known(f"utm_{part}") for part in ("source", "medium", "campaign", "term", "content")},
    "bots.signal_rules": Breakdown(
        {"signals": "bot_signals", "score": "bot_score"},
        {"events": "rows", "visitors": "visitors"},
        "bot_signals <> ''",
        15,
        "unbotted",
    ),
    "agent.operators": Breakdown(
        {"operator": "agent_signer"}, {"sessions": "sessions", "events": "rows"}, limit=10, who="agent"
    ),
    "agent.pages": Breakdown({"path": "path"}, {"views": "rows", "sessions": "sessions"}, PAGEVIEWS, 10, "agent"),
    "agent.events": Breakdown({"name": "name"}, {"count": "rows"}, "type = 'event'", 10, "agent"),
    "agents.by_signer": Breakdown(
        {"signer": "agent_signer", "agent": "bot_name"},
        {"hits": "rows", "pages": "pages"},
        "agent_trust = 'verified' AND agent_signer <> ''",
        15,
        "everyone",
    ),
    "agents.unverified_bots": Breakdown(
        {"agent": "bot_name", "kind": "bot_kind"}, {"hits": "rows"}, "agent_trust = 'claimed'", 15, "everyone"
    ),
    "errors.top": Breakdown(
        {"message": "props.message", "path": "props.path"},
        {"hits": "rows", "sessions": "sessions"},
        "name = 'error'",
        10,
    ),
    "errors.groups": Breakdown(
        {"message": "props.message", "source": "props.source", "line": "props.line"},
        {"hits": "rows", "sessions": "sessions", "pages": "pages", "first_seen": "first", "last_seen": "last"},
        "name = 'error'",
        order=("sessions", "hits"),
    ),
    "errors.browsers": Breakdown({"browser": "browser", "os": "os"}, {"hits": "rows"}, "name = 'error'", 8),
    "form.abandon_fields": Breakdown(
        {"field": "props.field"}, {"abandons": "rows"}, "name = 'form_abandon'", 10, verticals=CAMPAIGN_SITES
    ),
    "signups.by_channel": Breakdown(
        {"channel": "channel"}, {"signups": "rows"}, SIGNUP_EVENTS, None, verticals=CAMPAIGN_SITES
    ),
}


def ranked(scope: Scope, spec: Breakdown) -> DataFrame:
    rows = scope.rows(spec.who).where(spec.where)
    read = [c for c in spec.keys()]
    used = {"sessions": "session_id", "visitors": "visitor_id", "pages": "path", "first": "ts", "last": "ts"}
    # Keys are renamed before grouping so a property named like a column groups by the property.
    inputs = {used.get(kind, kind) for kind in spec.show.values() if kind != "rows"}
    narrow = rows.select("site_id", *read, *[F.col(c).alias(f"_{c}") for c in sorted(inputs)])
    counted = [used[kind] for kind in spec.show.values() if kind in ("sessions", "visitors", "pages")]
    if len(counted) > 1:
        # Rows that agree on all counted columns are folded before they are counted distinct several times.
        edges = {"first": F.min("_ts").alias("_first"), "last": F.max("_ts").alias("_last")}
        kept = [edges[kind] for kind in edges if kind in spec.show.values()]
        folded = narrow.groupBy("site_id", *spec.by, *[f"_{c}" for c in counted]).agg(F.count(F.lit(1)).alias("_rows"), *kept)
        over = {"rows": lambda _: F.sum("_rows").cast("long"), "first": lambda _: F.min("_first"), "last": lambda _: F.max("_last")}
        aggregates = [over.get(kind, lambda k: F.countDistinct(f"_{used[k]}"))(kind).alias(name) for name, kind in spec.show.items()]
        return top_per(folded.groupBy("site_id", *spec.by).agg(*aggregates), spec.limit, spec.ranking())
    aggregates = [_over(kind, used.get(kind, kind)).alias(name) for name, kind in spec.show.items()]
    grouped = narrow.groupBy("site_id", *spec.by).agg(*aggregates)
    return top_per(grouped, spec.limit, spec.ranking())


def _over(kind: str, column: str) -> Column:
    if kind == "rows":
        return F.count(F.lit(1))
    held = F.col(f"_{column}")
    if kind in ("sessions", "visitors", "pages"):
        return F.countDistinct(held)
    return F.min(held) if kind == "first" else F.max(held)


def breakdown(scope: Scope, metric: str, **limit: int | None) -> DataFrame:
    """Any ranked metric by id; ``limit=None`` gives every row, without it the metric's own number."""
    if metric in SPECIAL:
        return SPECIAL[metric](scope, **limit)
    return ranked(scope, replace(BREAKDOWNS[metric], **limit))


def pages_detail(scope: Scope, limit: int = 200) -> DataFrame:
    """Views, sessions, visitors, mean seconds to the next pageview, exits."""
    views = scope.rows().where(is_pageview())
    narrow = views.select("site_id", "session_id", "visitor_id", "path", "ts", "ingest_seq")
    linked = with_neighbour(narrow, ["site_id", "session_id"], {"next_ts": "ts"}, ahead=True)
    spent = (F.col("next_ts") - F.col("ts")) / 1000.0
    exits = F.sum(F.when(F.col("next_ts").isNull(), 1).otherwise(0))
    folded = per_visitor(linked, ["site_id", "path"], {"views": F.count(F.lit(1)), "spent": F.sum(spent), "timed": F.count(spent), "exits": exits})
    grouped = folded.groupBy("site_id", "path").agg(
        F.sum("views").cast("long").alias("views"),
        F.sum("sessions").cast("long").alias("sessions"),
        F.count(F.lit(1)).alias("visitors"),
        round_to(F.sum("spent") / F.nullif(F.sum("timed"), F.lit(0))).alias("avg_time"),
        F.sum("exits").cast("long").alias("exits"),
    )
    return top_per(grouped, limit, [F.desc("views"), F.asc("path")])


def edge_pages(scope: Scope, first: bool, limit: int = 100) -> DataFrame:
    """Path of each session's first or last pageview inside the window."""
    pick = F.min_by if first else F.max_by
    edges = scope.rows().where(is_pageview()).groupBy("site_id", "session_id").agg(pick("path", in_order()).alias("path"))
    grouped = edges.groupBy("site_id", "path").agg(F.count(F.lit(1)).alias("sessions"))
    return top_per(grouped, limit, [F.desc("sessions"), F.asc("path")])


def weekhour(scope: Scope, offset_minutes: int = 0) -> DataFrame:
    """Sessions by weekday (0 = Sunday) and hour on the viewer's clock."""
    shift = max(-14 * 60, min(14 * 60, round(offset_minutes))) * 60_000
    local = F.col("ts") + F.lit(shift)
    day = bucket_of(local, 0, DAY_MS)
    # 1970-01-01 was a Thursday.
    placed = scope.rows().select(
        "site_id",
        "session_id",
        F.pmod(day + 4, F.lit(7)).cast("int").alias("dow"),
        F.pmod(bucket_of(local, 0, HOUR_MS), F.lit(24)).cast("int").alias("hour"),
    )
    return placed.groupBy("site_id", "dow", "hour").agg(distinct("session_id").alias("sessions"))


def slow_pages(scope: Scope, min_samples: int = 3, limit: int = 10) -> DataFrame:
    """Pages by mean largest contentful paint."""
    if vital_days.usable(scope):
        held = vital_days.counts(scope, [scope.window], "slow").withColumnRenamed("g", "path")
        measures = round_to(F.sum("total") / F.sum("n")), F.sum("n")
    else:
        timed = scope.rows().where("name = 'web_vitals'").select("site_id", "path", number("lcp").alias("value"))
        held, measures = timed.where(F.col("value").isNotNull()), (round_to(F.avg("value")), F.count(F.lit(1)))
    grouped = held.groupBy("site_id", "path").agg(measures[0].alias("lcp"), measures[1].alias("samples"))
    return top_per(grouped.where(F.col("samples") >= min_samples), limit, [F.desc("lcp"), F.asc("path")])


def _vitals(scope: Scope) -> DataFrame:
    from footlog.operators.vitals import bundle_p75

    return bundle_p75(scope)


SPECIAL = {
    "pages.detail": pages_detail,
    "entry.pages": lambda scope, **limit: edge_pages(scope, True, **limit),
    "exit.pages": lambda scope, **limit: edge_pages(scope, False, **limit),
    "heatmap.weekhour": weekhour,
    "vitals.slow_pages": slow_pages,
    "vitals.p75": _vitals,
}

# query_stats: what may be broken down ad hoc.
STAT_DIMENSIONS = (
    "path title hostname channel source referrer_host country region city device browser os lang screen "
    "utm_source utm_medium utm_campaign utm_term utm_content tag event"
).split()
STAT_METRICS = ["visitors", "sessions", "pageviews", "events"]


def stats(scope: Scope, metric: str = "visitors", by: str | None = None, limit: int | None = 10) -> DataFrame:
    """One metric, optionally by a dimension or by UTC day."""
    if metric not in STAT_METRICS:
        raise ValueError(f"metric must be one of {', '.join(STAT_METRICS)}")
    if by not in (None, "day") and by not in STAT_DIMENSIONS:
        raise ValueError(f"cannot break down by {by}")
    kinds = {"visitors": distinct("visitor_id"), "sessions": distinct("session_id")}
    of_type = "pageview" if metric == "pageviews" else "event"
    value = kinds.get(metric, F.sum(F.when(F.col("type") == of_type, 1).otherwise(0)).cast("long")).alias("value")
    rows = scope.rows()
    if by is None:
        return scope.per_site(rows, value)
    if by == "day":
        day = F.date_format(F.date_from_unix_date(bucket_of("ts", 0, DAY_MS).cast("int")), "yyyy-MM-dd")
        return rows.withColumn("day", day).groupBy("site_id", "day").agg(value)
    if by == "event":
        rows = rows.where("type = 'event'").withColumn("event", F.col("name"))
    return top_per(rows.groupBy("site_id", by).agg(value), limit, [F.desc("value"), F.asc(by)])


def segment_change(
    scope: Scope,
    metric: str = "visitors",
    dimensions: tuple[str, ...] = ("channel", "source", "path", "country", "device", "browser"),
    limit: int | None = None,
) -> DataFrame:
    """One metric per segment value, this window against the previous one, largest change first."""
    earlier = scope.window.previous()
    rows = scope.at(scope.window.joined(earlier)).rows()
    column = {"visitors": "visitor_id", "sessions": "session_id"}.get(metric)
    now = F.when(scope.window.contains(), 1).otherwise(0)
    if column is None:
        rows = rows.where(F.col("type") == ("pageview" if metric == "pageviews" else "event"))
        counts = [F.sum("a").cast("long").alias("a"), F.sum("b").cast("long").alias("b")]
    else:
        counts = [F.max("a").alias("a"), F.max("b").alias("b")]
    counted = [column] if column else []
    # Fold rows that agree on every dimension before they are spread over the dimensions.
    rows = rows.withColumn("a", now).withColumn("b", 1 - now)
    folded = rows.groupBy("site_id", *dimensions, *counted).agg(*counts)
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("k"), F.col(d).alias("v")) for d in dimensions]))
    spread = folded.select("site_id", *counted, "a", "b", pairs.alias("s")).select(
        "site_id", *counted, "a", "b", F.col("s.k").alias("dimension"), F.col("s.v").alias("segment")
    )
    keys = ["site_id", "dimension", "segment"]
    if column:
        spread = spread.groupBy(*keys, column).agg(*counts)
    out = spread.groupBy(*keys).agg(F.sum("a").cast("long").alias("value"), F.sum("b").cast("long").alias("previous"))
    out = out.withColumn("change", F.col("value") - F.col("previous"))
    if limit is None:
        return out
    return top_per(out, limit, [F.desc(F.abs("change")), F.asc("dimension"), F.asc("segment")])
