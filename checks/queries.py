"""The registered queries: one entry per operator, each over the whole of the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.sample_view import distinct_table, event_table, long_visits, people_table, session_table, vital_table
from footlog.model import DAY_MS, HOUR_MS, Scope, Window
from footlog.operators import (
    breakdowns, explore, filters, geo, lifecycle, paths, people, portfolio, retention, revenue, scalars, series, vitals,
)
from footlog.operators.filters import Filter
from footlog.operators.paths import Goal, Step
from footlog.plans import bundle
from footlog.sources import distinct_days

Query = Callable[[SparkSession, str], DataFrame]

FULL = Window(1_704_067_200_000, 1_706_659_200_000)
LATE = Window(1_705_363_200_000, 1_706_659_200_000)  # its previous window holds the other half
MIDDLE = Window(1_705_294_800_000, 1_705_467_600_000)  # two days from five o'clock on
NOW = 1_706_659_200_000
LIVE_NOW = 1_704_067_200_000 + 300_000  # five minutes reach back to the first event


def scope(spark: SparkSession, sf_dir: str, window: Window = FULL, **options) -> Scope:
    return Scope(event_table(spark, sf_dir), window, sessions=session_table(spark, sf_dir), **options)


def on(operator: Callable[..., DataFrame], *args, window: Window = FULL, filters: tuple = (), **options) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return operator(scope(spark, sf_dir, window, filters=filters), *args, **options)

    return run


def on_ledger(operator: Callable[..., DataFrame], *args, window: Window = FULL, **options) -> Query:
    """Reports on people from the ledger; events are read only of the window and of days it cuts."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return operator(scope(spark, sf_dir, window, people=people_table(spark, sf_dir)), *args, **options)

    return run


def on_bits(operator: Callable[..., DataFrame], *args, window: Window = FULL, **options) -> Query:
    """Counts of visitors and sessions from day bitmaps; events are read only of days the windows cut."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return operator(scope(spark, sf_dir, window, distincts=distinct_table(spark, sf_dir)), *args, **options)

    return run


def on_counts(operator: Callable[..., DataFrame], *args, window: Window = FULL, **options) -> Query:
    """Vitals from stored value counts; events are read only of days the windows cut."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return operator(scope(spark, sf_dir, window, vitals=vital_table(spark, sf_dir)), *args, **options)

    return run


def on_long(operator: Callable[..., DataFrame], *args, filters: tuple = (), **options) -> Query:
    """Over visits of up to three days, in a window of two days: whole visits reach beyond it."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        events, sessions = long_visits(spark, sf_dir)
        return operator(Scope(events, MIDDLE, filters=filters, sessions=sessions), *args, **options)

    return run


def packed(name: str) -> Query:
    return lambda spark, sf_dir: bundle.tidy_rows(bundle.pack(scope(spark, sf_dir), name))


SCALAR_KEYS = {
    "e05_visitors_unique": "visitors.unique",
    "e06_sessions_total": "sessions.total",
    "e07_pageviews_total": "pageviews.total",
    "e08_bounce_rate": "bounce.rate",
    "e09_visit_duration": "visit.duration",
    "e10_views_per_session": "views.per_session",
    "e12_ai_sessions": "ai.sessions",
    "e15_ai_crawler_hits": "ai.crawler.hits",
    "e42_bots_suspected": "bots.suspected",
    "e44_agent_sessions": "agent.sessions",
    "e45_agent_pageviews": "agent.pageviews",
    "e49_agents_verified": "agents.verified",
    "e50_agents_claimed": "agents.claimed",
    "e55_errors_total": "errors.total",
    "e59_cta_clicks": "cta.clicks",
    "e60_cta_conversion": "cta.conversion",
    "e62_scroll_depth": "scroll.depth",
    "e63_rage_clicks": "rage.clicks",
    "e64_signups_total": "signups.total",
}
BREAKDOWN_KEYS = {
    "e11_channels_sessions": "channels.sessions",
    "e13_ai_sources": "ai.sources",
    "e14_ai_landing_pages": "ai.landing_pages",
    "e16_ai_crawler_pages": "ai.crawler.pages",
    "e17_pages_top": "pages.top",
    "e18_titles_top": "titles.top",
    "e19_hostnames_top": "hostnames.top",
    "e20_pages_detail": "pages.detail",
    "e21_referrers_top": "referrers.top",
    "e22_events_top": "events.top",
    "e23_outbound_links": "outbound.links",
    "e24_downloads_files": "downloads.files",
    "e25_devices_sessions": "devices.sessions",
    "e26_browsers_sessions": "browsers.sessions",
    "e27_os_sessions": "os.sessions",
    "e28_screens_sessions": "screens.sessions",
    "e29_languages_sessions": "languages.sessions",
    "e30_countries_sessions": "countries.sessions",
    "e31_regions_sessions": "regions.sessions",
    "e32_cities_sessions": "cities.sessions",
    "e33_entry_pages": "entry.pages",
    "e34_exit_pages": "exit.pages",
    "e35_utm_campaigns": "utm.campaigns",
    "e36_utm_source": "utm.source",
    "e37_utm_medium": "utm.medium",
    "e38_utm_campaign": "utm.campaign",
    "e39_utm_term": "utm.term",
    "e40_utm_content": "utm.content",
    "e41_heatmap_weekhour": "heatmap.weekhour",
    "e43_bots_signal_rules": "bots.signal_rules",
    "e46_agent_operators": "agent.operators",
    "e47_agent_pages": "agent.pages",
    "e48_agent_events": "agent.events",
    "e51_agents_by_signer": "agents.by_signer",
    "e52_agents_unverified_bots": "agents.unverified_bots",
    "e53_vitals_p75": "vitals.p75",
    "e54_vitals_slow_pages": "vitals.slow_pages",
    "e56_errors_top": "errors.top",
    "e57_errors_groups": "errors.groups",
    "e58_errors_browsers": "errors.browsers",
    "e61_form_abandon_fields": "form.abandon_fields",
    "e65_signups_by_channel": "signups.by_channel",
}


BITMAP_METRICS = list(distinct_days.METRICS)
FROM_BITMAPS = ["e05_visitors_unique", "e06_sessions_total", "e42_bots_suspected", "e44_agent_sessions"]


def bundle_queries() -> dict[str, Query]:
    out: dict[str, Query] = {
        "e01_timeseries": on(series.traffic, DAY_MS),
        "e02_timeseries_sessions": on(series.session_quality, DAY_MS),
        "e03_errors_series": on(series.errors, DAY_MS),
        "e04_live_visitors": on(scalars.live_visitors, LIVE_NOW),
    }
    out |= {key: on(scalars.scalar, metric) for key, metric in SCALAR_KEYS.items()}
    out |= {f"{key}_bitmaps": on_bits(scalars.scalar, SCALAR_KEYS[key]) for key in FROM_BITMAPS}
    out |= {key: on(breakdowns.breakdown, metric) for key, metric in BREAKDOWN_KEYS.items()}
    out |= {
        "e70_bundle_scalars": on(bundle.scalar_table),
        "e72_period_comparison": on(bundle.scalar_table, LATE.previous(), window=LATE),
        "e72_unique_comparison_bitmaps": on_bits(bundle.scalar_table, LATE.previous(), BITMAP_METRICS, window=LATE),
        "e72_unique_comparison_cut_days": on_bits(bundle.scalar_table, MIDDLE.previous(), BITMAP_METRICS, window=MIDDLE),
        "e74_series_fill": on(series.series, "timeseries.sessions", "day"),
        "e75_series_previous": on(series.series_with_previous, "timeseries", "day", window=LATE),
        "e76_query_stats": on(breakdowns.stats, "sessions", "event", limit=100),
        "e76_query_stats_day": on(breakdowns.stats, "visitors", "day"),
        "e77_realtime": on(bundle.realtime, LIVE_NOW),
        "e77_pack_overview": packed("overview"),
        "e77_pack_ai_traffic": packed("ai_traffic"),
        "e77_pack_web_vitals": packed("web_vitals"),
        "e77_pack_errors": packed("errors"),
        "e78_segment_change": on(breakdowns.segment_change, window=LATE),
        "f44_vitals_overview": on(vitals.overview, window=LATE),
        "f45_vitals_by_path": on(vitals.by_dimension, "path"),
        "f46_vitals_series": on(vitals.over_time, DAY_MS),
        "e53_vitals_p75_counts": on_counts(vitals.bundle_p75),
        "e54_vitals_slow_pages_counts": on_counts(breakdowns.slow_pages),
        "f44_vitals_overview_counts": on_counts(vitals.overview, window=MIDDLE),
        "f45_vitals_by_path_counts": on_counts(vitals.by_dimension, "path"),
        "f46_vitals_series_counts": on_counts(vitals.over_time, DAY_MS),
    }
    return out


WIDE_STEPS = (Step("page", "/"), Step("event", "error"), Step("event", "error"), Step("event", "purchase"))

AGENT_STEPS = (Step("page", "/p/3"), Step("event", "error"))


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sites of the view; the last one is in strict privacy mode."""
    mode = F.when(F.col("site_id") == "s2", "strict").otherwise("standard").alias("privacy_mode")
    return event_table(spark, sf_dir).select("site_id").distinct().select("site_id", mode)


def with_quiet_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sites and one more that has had no event yet."""
    return sites(spark, sf_dir).unionByName(spark.range(1).select(F.lit("s9").alias("site_id"), F.lit("standard").alias("privacy_mode")))


# ISO 3166 codes of nations and the middle of each, in degrees.
NATIONS = {
    "ALGERIA": ("DZ", 28.0, 3.0), "ARGENTINA": ("AR", -34.0, -64.0), "BRAZIL": ("BR", -10.0, -55.0), "CANADA": ("CA", 60.0, -95.0),
    "CHINA": ("CN", 35.0, 105.0), "EGYPT": ("EG", 27.0, 30.0), "ETHIOPIA": ("ET", 8.0, 38.0), "FRANCE": ("FR", 46.0, 2.0),
    "GERMANY": ("DE", 51.0, 9.0), "INDIA": ("IN", 20.0, 77.0), "INDONESIA": ("ID", -5.0, 120.0), "IRAN": ("IR", 32.0, 53.0),
    "IRAQ": ("IQ", 33.0, 44.0), "JAPAN": ("JP", 36.0, 138.0), "JORDAN": ("JO", 31.0, 36.0), "KENYA": ("KE", 1.0, 38.0),
    "MOROCCO": ("MA", 32.0, -5.0), "MOZAMBIQUE": ("MZ", -18.25, 35.0), "PERU": ("PE", -10.0, -76.0), "ROMANIA": ("RO", 46.0, 25.0),
    "RUSSIA": ("RU", 60.0, 100.0), "SAUDI ARABIA": ("SA", 25.0, 45.0), "UNITED KINGDOM": ("GB", 54.0, -2.0),
    "UNITED STATES": ("US", 38.0, -97.0), "VIETNAM": ("VN", 16.0, 106.0),
}


def nation_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A country table of the nations there are, with their codes and middles; a country that is no nation has no row."""
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet")
    known = spark.createDataFrame([(n, *row) for n, row in NATIONS.items()], "n_name string, code string, lat double, lon double")
    return nations.join(known, "n_name").select("code", F.initcap(F.lower("n_name")).alias("name"), "lat", "lon")


def report_queries() -> dict[str, Query]:
    de = (Filter("country", "DE"), Filter("browser", "Safari", "is_not"))

    def events(operator: Callable[..., DataFrame], *args, **options) -> Query:
        return lambda spark, sf_dir: operator(event_table(spark, sf_dir), *args, **options)

    def assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
        return portfolio.portfolio(scope(spark, sf_dir, LATE), sites(spark, sf_dir))

    return {
        "d01_audiences": audiences,
        "d02_row_filter": on(breakdowns.breakdown, "channels.sessions", filters=de),
        "d03_property_filter": on(breakdowns.breakdown, "events.top", filters=(Filter("prop:tier", "t1"),)),
        "d04_session_event_filter": on(breakdowns.breakdown, "pages.top", filters=(Filter("event", "purchase"),)),
        "d05_entry_exit_filter": on(
            breakdowns.stats, "sessions", "channel", filters=(Filter("entry_page", "/"), Filter("exit_page", "/p/1", "is_not"))
        ),
        "d06_is_not": on(breakdowns.stats, "events", "device", filters=(Filter("os", "iOS", "is_not"),)),
        "d07_like": on(
            breakdowns.stats,
            "sessions",
            "referrer_host",
            filters=(
                Filter("referrer_host", "GOOGLE", "contains"),
                Filter("path", "/P/", "starts_with"),
                Filter("browser", "app", "not_contains"),
            ),
        ),
        "d08_regex": on(
            breakdowns.stats, "sessions", "path", filters=(Filter("path", "^/p/[1-3]$", "regex"), Filter("source", "oo", "not_regex"))
        ),
        "d08_matched_values": on(filters.matched_values, Filter("path", "^/p/[1-3]$", "regex")),
        "d09_filtered_comparison": on(bundle.scalar_table, LATE.previous(), window=LATE, filters=de),
        "d11_suggestions": on(filters.suggestions, "path", "p/"),
        "d11_property_suggestions": on(filters.suggestions, "prop:currency"),
        "f01_sessions": on(explore.list_sessions, limit=200, window=LATE, filters=(Filter("path", "/p/3"),)),
        "f01_sessions_over_days": on_long(explore.list_sessions, limit=None, filters=(Filter("path", "/p/3"),)),
        "d04_event_filter_over_days": on_long(breakdowns.breakdown, "pages.top", filters=(Filter("event", "purchase"),)),
        "d05_entry_exit_over_days": on_long(
            breakdowns.stats, "sessions", "channel", filters=(Filter("entry_page", "/"), Filter("exit_page", "/p/1", "is_not"))
        ),
        "f40_first_touch_over_days": on_long(revenue.breakdown, "channel"),
        "f01_sessions_total": on(explore.count_sessions, window=LATE, filters=(Filter("path", "/p/3"),)),
        "f02_timelines": events(explore.timelines, limit=2000),
        "f03_users": on(explore.list_users, limit=200),
        "f03_visitors": on(explore.list_users, "anonymous", limit=200),
        "f03_users_total": on(explore.count_users),
        "f04_profiles": events(explore.profiles),
        "f05_traits": events(explore.traits),
        "f06_event_properties": on(explore.event_properties, limit=500),
        "f07_event_series": on(explore.event_series, DAY_MS),
        "f08_event_log": on(explore.event_log),
        "f09_error_occurrences": on(explore.error_occurrences, "E1", "/a1.js", 1),
        "f10_journeys": on(paths.journeys, 4, 100),
        "f10_journeys_filtered": on(paths.journeys, 3, 100, ("/p/*", None, "/p/2")),
        "f10_journeys_total": on(paths.journey_base),
        "f12_goal_page": on(paths.goal, Goal("page", "/p/*")),
        "f12_goal_event": on(paths.goal, Goal("event", "purchase", "currency", "USD")),
        "f12_goal_paths": on(paths.goal_paths, Goal("page", "/**")),
        "f13_funnel": on(paths.funnel),
        "f13_funnel_repeats": on(paths.funnel, WIDE_STEPS),
        "f13_funnel_agents": on(paths.funnel, AGENT_STEPS, "agent"),
        "f13_funnel_filtered": on(paths.funnel, WIDE_STEPS, filters=(Filter("device", "mobile"),)),
        "f15_retention": on(retention.cohort_cells),
        "f15_retention_curve": lambda spark, sf_dir: retention.curve(retention.cohort_cells(scope(spark, sf_dir))),
        "f15_availability": lambda spark, sf_dir: retention.availability(scope(spark, sf_dir), sites(spark, sf_dir)),
        "f16_accounting": on(lifecycle.accounting, window=LATE),
        "f17_one_and_done": on(lifecycle.one_and_done, window=LATE),
        "f18_lifecycle_events": on(lifecycle.lifecycle_events),
        "f19_plans": on(lifecycle.plans),
        "f20_plan_changes": on(lifecycle.plan_changes, window=LATE),
        "f21_active_series": on(lifecycle.active_series, DAY_MS),
        "f21_new_series": on(lifecycle.new_series, DAY_MS),
        "f22_privacy_check": on(lifecycle.privacy_check),
        "f23_data_from": on(lifecycle.data_from),
        "f24_people": on(people.list_people, limit=100),
        "f24_people_segment": on(people.list_people, "returning", "actions", "pro", limit=100),
        "f24_people_total": on(people.count_people, "returning"),
        "f25_people_summary": on(people.summary, NOW),
        "f26_top_actions": on(people.top_actions),
        "f27_people_by_plan": on(people.by_plan),
        "f28_actions_by_day": on(people.actions_by_day),
        "f28_latest_visits": on(people.latest_visits),
        "f16_accounting_ledger": on_ledger(lifecycle.accounting, window=MIDDLE),
        "f17_one_and_done_ledger": on_ledger(lifecycle.one_and_done, window=LATE),
        "f19_plans_ledger": on_ledger(lifecycle.plans),
        "f20_plan_changes_ledger": on_ledger(lifecycle.plan_changes, window=MIDDLE),
        "f21_new_series_ledger": on_ledger(lifecycle.new_series, HOUR_MS, window=MIDDLE),
        "f23_data_from_ledger": on_ledger(lifecycle.data_from),
        "f24_people_ledger": on_ledger(people.list_people, limit=100),
        "f25_people_summary_ledger": on_ledger(people.summary, NOW),
        "f26_top_actions_ledger": on_ledger(people.top_actions),
        "f27_people_by_plan_ledger": on_ledger(people.by_plan),
        "f28_actions_by_day_ledger": on_ledger(people.actions_by_day),
        "f28_latest_visits_ledger": on_ledger(people.latest_visits),
        "f30_portfolio_traffic": on(portfolio.traffic, window=LATE),
        "f31_portfolio_people": on(portfolio.people, window=LATE),
        "f32_portfolio_signups": on(portfolio.signups, window=LATE),
        "f32_portfolio_moves": on(portfolio.moves, window=LATE),
        "f32_portfolio_paying": on(portfolio.paying, window=LATE),
        "f33_portfolio_revenue": on(portfolio.revenue, window=LATE),
        "f34_portfolio_series": lambda spark, sf_dir: portfolio.series(scope(spark, sf_dir), sites(spark, sf_dir)),
        "f34_portfolio_sites": lambda spark, sf_dir: portfolio.series(scope(spark, sf_dir, LATE), with_quiet_site(spark, sf_dir)),
        "f35_portfolio_platforms": on(portfolio.platforms),
        "f36_portfolio": assembled,
        "f36_portfolio_totals": lambda spark, sf_dir: portfolio.totals(assembled(spark, sf_dir)),
        "f36_portfolio_money": lambda spark, sf_dir: portfolio.money_totals(scope(spark, sf_dir), sites(spark, sf_dir)),
        "f37_revenue_currencies": on(revenue.currencies),
        "f38_revenue_totals": on(revenue.totals, window=LATE),
        "f38_revenue_no_sales": on(revenue.totals, "GBP", window=LATE),
        "f39_revenue_per_visitor": on(revenue.per_visitor),
        "f39_revenue_no_sales": on(revenue.per_visitor, "GBP"),
        "f39_revenue_named": on(revenue.per_visitor, "EUR"),
        "f40_revenue_by_channel": on(revenue.breakdown, "channel"),
        "f40_revenue_by_path": on(revenue.breakdown, "path", "USD"),
        "f41_revenue_series": on(revenue.over_time, DAY_MS),
        "f42_agent_revenue": on(revenue.agent_revenue),
        "f43_revenue_rejected": on(revenue.rejected),
        "f47_geo_coverage": on(geo.coverage),
        "f48_geo_countries": on(geo.countries),
        "f48_geo_regions": on(geo.regions, limit=5000),
        "f49_geo_points": on(geo.points, limit=5000),
        "f50_geo_sessions": on(geo.sessions, limit=5000),
        "f51_geo_report": lambda spark, sf_dir: geo.report(scope(spark, sf_dir), nation_codes(spark, sf_dir))["geo.countries"],
    }


def audiences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and sessions of each audience."""
    from footlog.model import AUDIENCES, audience

    rows = event_table(spark, sf_dir)
    labels = F.array_compact(F.array(*[F.when(audience(name), F.lit(name)) for name in AUDIENCES]))
    spread = rows.select("site_id", "session_id", F.explode(labels).alias("audience"))
    return spread.groupBy("site_id", "audience").agg(
        F.count(F.lit(1)).alias("events"), F.countDistinct("session_id").alias("sessions")
    )


def all_queries() -> dict[str, Query]:
    return bundle_queries() | report_queries()
