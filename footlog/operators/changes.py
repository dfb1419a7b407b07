"""What is worth telling about a period (E79): rows, not prose."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footlog.model import Scope, Window
from footlog.operators.breakdowns import BREAKDOWNS, ranked
from footlog.operators.scalars import DERIVED, SCALARS
from footlog.operators.series import series
from footlog.plans.bundle import scalar_table

# Thresholds of significance and of the advice rules.
MIN_BASE, MIN_DELTA_PCT = 20, 15
PEAK_FACTOR, PEAK_BUCKETS = 1.5, 3
HIGH_BOUNCE, LOW_CTA = 70, 5
HEADLINE = ["visitors.unique", "sessions.total", "pageviews.total"]
_COLUMNS = ["site_id", "kind", "metric", "detail", "value", "previous", "delta_pct"]


def _line(kind: str, metric: Column | str, value: Column, detail: Column | None = None, when: Column | None = None, **more: Column) -> Column:
    """One output row as a struct, or null when its condition does not hold."""
    none = F.lit(None).cast("double")
    made = F.struct(
        F.lit(kind).alias("kind"),
        (metric if isinstance(metric, Column) else F.lit(metric)).alias("metric"),
        F.coalesce(detail if detail is not None else F.lit(""), F.lit("")).alias("detail"),
        value.cast("double").alias("value"),
        more.get("previous", none).cast("double").alias("previous"),
        more.get("delta", none).cast("double").alias("delta_pct"),
    )
    return made if when is None else F.when(when, made)


def _rows(table: DataFrame, *lines: Column) -> DataFrame:
    spread = table.select("site_id", F.explode(F.array_compact(F.array(*lines))).alias("l"))
    return spread.select("site_id", "l.*")


def _leader(scope: Scope, metric: str, value: str, detail: str) -> DataFrame:
    """The first row of a ranked metric per site."""
    top = ranked(scope, replace(BREAKDOWNS[metric], limit=1))
    return top.select("site_id", F.col(detail).alias(f"{value}_of"), F.col(value))


def change_lines(scope: Scope, compare: Window | None = None) -> DataFrame:
    """Headline, significant changes, the busiest bucket, AI traffic, campaign figures and rule-driven advice."""
    compare = compare or scope.window.previous()
    table = scalar_table(scope, compare)
    units = {m: s.unit for m, s in SCALARS.items()} | {m: d[1] for m, d in DERIVED.items()}
    counted = F.col("metric").isin([m for m, unit in units.items() if unit == "count"])
    told = F.col("previous") >= MIN_BASE
    first = F.col("metric") == "visitors.unique"
    value, previous, delta = F.col("value"), F.col("previous"), F.col("delta_pct")
    headline = _line(
        "headline", F.col("metric"), value, when=F.col("metric").isin(HEADLINE),
        previous=F.when(first & told, previous), delta=F.when(first & told, delta),
    )
    moved = ~first & (F.abs(delta) >= MIN_DELTA_PCT) & (~counted | told)
    change = _line("change", F.col("metric"), value, when=moved, previous=previous, delta=delta)

    peaks = series(scope, "timeseries").groupBy("site_id").agg(
        F.max(F.struct("views", (-F.col("bucket")).alias("early"), "ts")).alias("peak"),
        F.avg("views").alias("mean"),
        F.count(F.lit(1)).alias("buckets"),
    )
    busy = (F.col("buckets") >= PEAK_BUCKETS) & (F.col("peak.views") > 0) & (F.col("peak.views") >= F.col("mean") * PEAK_FACTOR)
    peak = _line("peak", "timeseries", F.col("peak.views"), F.col("peak.ts").cast("string"), when=busy, previous=F.col("mean"))

    wanted = ["ai.sessions", "ai.crawler.hits", "sessions.total", "cta.conversion", "signups.total", "rage.clicks", "bounce.rate"]
    named = {m: m.replace(".", "_") for m in wanted}
    wide = table.groupBy("site_id").agg(*[F.max(F.when(F.col("metric") == m, value)).alias(n) for m, n in named.items()])
    for leader in (
        _leader(scope, "ai.sources", "sessions", "source"),
        _leader(scope, "ai.crawler.pages", "hits", "path"),
        _leader(scope, "form.abandon_fields", "abandons", "field"),
    ):
        wide = wide.join(leader, "site_id", "left")
    ai, hits, total = F.col("ai_sessions"), F.col("ai_crawler_hits"), F.col("sessions_total")
    field = F.col("abandons_of")
    lines = [
        _line("ai", "ai.sessions", ai, F.col("sessions_of"), ai > 0, delta=F.when(total > 0, ai / total * 100)),
        _line("ai", "ai.crawler.hits", hits, F.col("hits_of"), hits > 0),
        _line("funnel", "cta.conversion", F.col("cta_conversion")),
        _line("funnel", "signups.total", F.col("signups_total")),
        _line("funnel", "form.abandon_fields", F.col("abandons"), field, F.col("abandons") > 0),
        _line("quality", "rage.clicks", F.col("rage_clicks"), when=F.col("rage_clicks") > 0),
        _line("action", "bounce.rate", F.col("bounce_rate"), when=F.col("bounce_rate") >= HIGH_BOUNCE),
        _line("action", "cta.conversion", F.col("cta_conversion"), when=F.col("cta_conversion") < LOW_CTA),
        _line("action", "form.abandon_fields", F.col("abandons"), field, F.col("abandons").isNotNull()),
        _line("action", "ai.crawler.hits", hits, when=(hits > 0) & (ai == 0)),
    ]
    parts = [_rows(table, headline, change), _rows(peaks, peak), _rows(wide, *lines)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select(*_COLUMNS)
