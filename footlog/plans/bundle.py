"""The metric bundle (E70), period comparison (E72) and named packs of metrics."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footlog.functions.values import count_when, number, percent, round_to
from footlog.model import Scope, Window
from footlog.operators.breakdowns import BREAKDOWNS, SPECIAL, breakdown
from footlog.operators.scalars import DERIVED, SCALARS
from footlog.operators.series import SERIES, series
from footlog.sources import distinct_days

PACKS = {
    "overview": [
        "visitors.unique", "sessions.total", "pageviews.total", "bounce.rate", "visit.duration", "views.per_session",
        "channels.sessions", "pages.top", "referrers.top", "entry.pages", "exit.pages",
    ],
    "ai_traffic": [
        "ai.sessions", "ai.sources", "ai.landing_pages", "ai.crawler.hits", "ai.crawler.pages", "sessions.total",
    ],
    "web_vitals": ["vitals.p75", "vitals.slow_pages"],
    "errors": ["errors.total", "errors.top", "errors.browsers"],
}


def metrics_for(vertical: str = "generic") -> list[str]:
    """Metric ids that make sense for a kind of site."""
    limits = {m: s.verticals for m, s in SCALARS.items()} | {m: d[2] for m, d in DERIVED.items()}
    limits |= {m: b.verticals for m, b in BREAKDOWNS.items()} | dict.fromkeys([*SPECIAL, *SERIES])
    return [m for m, verticals in limits.items() if verticals is None or vertical in verticals]


def scalar_table(scope: Scope, compare: Window | None = None, only: Iterable[str] | None = None) -> DataFrame:
    """Every scalar of the scope, and of the comparison window, as rows (site_id, metric, value, ...).

    One aggregation per session and one per visitor fold the events map-side; all metrics of both
    windows are conditional sums over those, so no metric adds a scan and no distinct multiplies rows. Where the scope has
    bitmaps and only metrics made of them are asked for, no event is read but on days that a window cuts.
    """
    windows = {"value": scope.window} | ({"previous": compare} if compare else {})
    wanted = [m for m in [*SCALARS, *DERIVED] if only is None or m in set(only)]
    if scope.distincts is not None and not scope.filters and set(wanted) <= set(distinct_days.METRICS):
        return _tidied(distinct_days.counts(scope, windows, wanted), wanted, windows)
    read = scope.at(scope.window.joined(compare)) if compare else scope
    rows = read.rows("everyone")

    session_parts: list[Column] = []
    visitor_parts: list[Column] = []
    finals: list[Column] = []
    visitor_finals: list[Column] = []
    for tag, window in windows.items():
        inside = window.contains()
        human = inside & scope.who()
        for metric in wanted:
            name = f"{metric}|{tag}".replace(".", "_")
            if metric in SCALARS:
                spec = SCALARS[metric]
                hit = inside & scope.who(spec.who) & F.expr(spec.where)
                if spec.counts == "visitors":
                    visitor_parts.append(F.max(F.when(hit, 1).otherwise(0)).alias(name))
                    visitor_finals.append(F.sum(f"`{name}`").cast("double").alias(name))
                else:
                    fold = F.sum if spec.counts == "rows" else F.max
                    session_parts.append(fold(F.when(hit, 1).otherwise(0)).alias(name))
                    finals.append(F.sum(f"`{name}`").cast("double").alias(name))
        viewed, any_, lo, hi = (F.col(f"_{part}_{tag}") for part in ("views", "any", "lo", "hi"))
        clicked, depth, scrolls = (F.col(f"_{part}_{tag}") for part in ("cta", "depth", "scrolls"))
        percent_read = F.when(human & F.expr("name = 'scroll'"), number("percent"))
        session_parts += [
            count_when(human & F.expr("type = 'pageview'")).alias(f"_views_{tag}"),
            F.max(F.when(human, 1).otherwise(0)).alias(f"_any_{tag}"),
            F.min(F.when(human, F.col("ts"))).alias(f"_lo_{tag}"),
            F.max(F.when(human, F.col("ts"))).alias(f"_hi_{tag}"),
            F.max(F.when(human & F.expr("name = 'cta_click'"), 1).otherwise(0)).alias(f"_cta_{tag}"),
            F.sum(percent_read).alias(f"_depth_{tag}"),
            F.count(percent_read).alias(f"_scrolls_{tag}"),
        ]
        sessions = F.sum(any_)
        derived = {
            "bounce.rate": percent(count_when(viewed == 1), count_when(viewed > 0)),
            "visit.duration": round_to(F.avg((hi - lo) / 1000.0)),
            "views.per_session": F.when(sessions > 0, round_to(F.sum(viewed) / sessions, 2)),
            "cta.conversion": percent(F.sum(clicked), sessions),
            "scroll.depth": F.when(F.sum(scrolls) > 0, round_to(F.sum(depth) / F.sum(scrolls), 1)),
        }
        finals += [
            F.coalesce(derived[m], F.lit(0.0)).alias(f"{m}|{tag}".replace(".", "_")) for m in wanted if m in derived
        ]

    by_session = rows.groupBy("site_id", "session_id").agg(*session_parts)
    wide = scope.per_site(by_session, *finals)
    if visitor_parts:
        by_visitor = rows.groupBy("site_id", "visitor_id").agg(*visitor_parts)
        wide = wide.join(scope.per_site(by_visitor, *visitor_finals), "site_id")
    return _tidied(wide, wanted, windows)


def _tidied(wide: DataFrame, wanted: list[str], windows: dict[str, Window]) -> DataFrame:
    """One row per site and metric of columns ``metric|tag``; with changes where there is a comparison window."""
    entries = [
        F.struct(
            F.lit(metric).alias("metric"),
            *[F.coalesce(F.col(f"`{metric.replace('.', '_')}|{tag}`").cast("double"), F.lit(0.0)).alias(tag) for tag in windows],
        )
        for metric in wanted
    ]
    tidy = wide.select("site_id", F.explode(F.array(*entries)).alias("m")).select("site_id", "m.*")
    return with_deltas(tidy) if "previous" in windows else tidy


def with_deltas(table: DataFrame) -> DataFrame:
    """Absolute and relative change; relative is null on a previous value of 0."""
    change = F.col("value") - F.col("previous")
    return table.withColumn("delta_abs", round_to(change, 1)).withColumn(
        "delta_pct", F.when(F.col("previous") != 0, round_to(change / F.col("previous") * 100, 1))
    )


def build_bundle(
    scope: Scope,
    compare: Window | None = None,
    vertical: str = "generic",
    only: Iterable[str] | None = None,
    granularity: str | None = None,
    offset_minutes: int = 0,
) -> dict[str, DataFrame]:
    """Lazy results by metric id; all scalars share the entry ``scalars``."""
    ids = [m for m in metrics_for(vertical) if only is None or m in set(only)]
    out: dict[str, DataFrame] = {}
    scalars = [m for m in ids if m in SCALARS or m in DERIVED]
    if scalars:
        out["scalars"] = scalar_table(scope, compare, scalars)
    for metric in ids:
        if metric in SERIES:
            out[metric] = series(scope, metric, granularity)
        elif metric == "heatmap.weekhour":
            out[metric] = SPECIAL[metric](scope) if not offset_minutes else _weekhour(scope, offset_minutes)
        elif metric in BREAKDOWNS or metric in SPECIAL:
            out[metric] = breakdown(scope, metric)
    return out


def _weekhour(scope: Scope, offset_minutes: int) -> DataFrame:
    from footlog.operators.breakdowns import weekhour

    return weekhour(scope, offset_minutes)


def pack(scope: Scope, name: str, compare: Window | None = None) -> dict[str, DataFrame]:
    """One of the named packs."""
    return build_bundle(scope, compare, only=PACKS[name])


def tidy_rows(results: dict[str, DataFrame]) -> DataFrame:
    """A bundle as one long table (site_id, metric, dim_key, measure, value)."""
    parts = []
    for metric, table in results.items():
        if metric == "scalars":
            part = table.select("site_id", "metric", F.lit("").alias("dim_key"), F.lit("value").alias("measure"), "value")
        else:
            numeric = [f.name for f in table.schema if f.dataType.typeName() in ("long", "double", "integer")]
            labels = [c for c in table.columns if c not in numeric and c != "site_id"]
            key = F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("")) for c in labels])
            each = F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in numeric]))
            part = table.select("site_id", F.lit(metric).alias("metric"), key.alias("dim_key"), each.alias("m")).select(
                "site_id", "metric", "dim_key", "m.measure", "m.value"
            )
        parts.append(part)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def realtime(scope: Scope, now_ms: int, limit: int = 10) -> DataFrame:
    """E77 realtime: people of the last five minutes in total, by page and by channel."""
    from footlog.model import LIVE_MS, is_pageview
    from footlog.operators.ordered import top_per

    recent = scope.site_events().where(scope.since(now_ms - LIVE_MS) & scope.who())
    page = F.when(is_pageview(), F.col("path"))
    views = F.array(
        F.struct(F.lit("all").alias("list"), F.lit("").alias("value")),
        F.struct(F.lit("page").alias("list"), page.alias("value")),
        F.struct(F.lit("channel").alias("list"), F.col("channel").alias("value")),
    )
    spread = recent.select("site_id", "visitor_id", F.explode(views).alias("v")).select("site_id", "visitor_id", "v.*")
    grouped = spread.where(F.col("value").isNotNull()).groupBy("site_id", "list", "value").agg(
        F.countDistinct("visitor_id").alias("visitors")
    )
    return top_per(grouped, limit, [F.desc("visitors"), F.asc("value")], ["site_id", "list"])
