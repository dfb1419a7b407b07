"""Sessions, users and single events in detail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footlog.functions.values import bucket_of, count_when, distinct, in_order, prop
from footlog.model import AUDIENCES, MINUTE_MS, Scope, Window, is_event, is_pageview
from footlog.operators.filters import keep_sessions, row_predicate
from footlog.operators.ordered import top_per
from footlog.sources.session_days import of_sessions

SESSION_ATTRIBUTES = (
    "visitor_id country browser os device screen lang channel source referrer_host"
).split()
TIMELINE_COLUMNS = (
    "id ts type name path query title hostname referrer_host channel source props country browser os device "
    "screen lang identity visitor_id utm_source utm_medium utm_campaign"
).split()


def _hit(scope: Scope, identity: str | None = None, visitor: str | None = None) -> Column:
    condition = scope.window.contains() & scope.who() & row_predicate(scope.filters)
    if identity:
        condition = condition & (F.col("identity") == identity)
    if visitor:
        condition = condition & (F.col("visitor_id") == visitor)
    return condition


def session_rows(scope: Scope, identity: str | None = None, visitor: str | None = None, longest_ms: int | None = None) -> DataFrame:
    """Whole sessions the scope selects: filters pick sessions, then every event of them counts.

    Sessions have no length limit in the data. With the scope's side table their facts are folded from it, and the only
    scan of events is the window's. Without it the events of the selected sessions are looked up in all history;
    ``longest_ms`` is a promise about the data that lets that scan prune to the window's surroundings.
    """
    # The window's sessions are found in its own days; only theirs are grouped.
    mine = scope.site_events().where(scope.inside() & _hit(scope, identity, visitor)).select("site_id", "session_id").distinct()
    sessions = scope.site_sessions()
    if sessions is not None:
        found = of_sessions(sessions, mine)
        grouped = found.withColumns({"_first": F.col("first"), "entry_page": F.col("entry.path"), "exit_page": F.col("leave.path")})
    else:
        events = scope.site_events()
        if longest_ms is not None:
            around = Window(scope.window.from_ms - longest_ms, scope.window.to_ms + longest_ms)
            events = events.where(scope.at(around).inside())
        viewed = F.when(is_pageview(), in_order())
        grouped = (
            events.join(mine, ["site_id", "session_id"], "left_semi")
            .groupBy("site_id", "session_id")
            .agg(
                F.min_by(F.struct(*SESSION_ATTRIBUTES), in_order()).alias("_first"),
                F.max("identity").alias("identity"),
                F.min("ts").alias("started"),
                F.max("ts").alias("ended"),
                count_when(is_pageview()).alias("pageviews"),
                count_when(is_event()).alias("events"),
                F.min_by("path", viewed).alias("entry_page"),
                F.max_by("path", viewed).alias("exit_page"),
            )
        )
    whole = scope.session_events() if any(f.field == "event" for f in scope.filters) else scope.site_events()
    picked = keep_sessions(grouped, whole, scope.filters, sessions)
    duration = F.floor((F.col("ended") - F.col("started")) / 1000).cast("long").alias("duration")
    attributes = [F.col(f"_first.{c}").alias(c) for c in SESSION_ATTRIBUTES]
    return picked.select(
        "site_id", "session_id", *attributes, "identity", "started", "ended", duration, "pageviews", "events", "entry_page", "exit_page"
    )


def list_sessions(
    scope: Scope, identity: str | None = None, visitor: str | None = None, limit: int | None = 50, offset: int = 0, **options
) -> DataFrame:
    """sessions, most recent first."""
    order = [F.desc("started"), F.asc("session_id")]
    return top_per(session_rows(scope, identity, visitor, **options), limit, order, offset=max(0, offset))


def count_sessions(scope: Scope, identity: str | None = None, visitor: str | None = None) -> DataFrame:
    """F1 total: sessions with a matching event in the window."""
    rows = scope.rows()
    if identity:
        rows = rows.where(F.col("identity") == identity)
    if visitor:
        rows = rows.where(F.col("visitor_id") == visitor)
    return scope.per_site(rows, distinct("session_id").alias("n"))


def timelines(events: DataFrame, site: str | None = None, session: str | None = None, limit: int | None = None) -> DataFrame:
    """every event of each session (of one, when named), numbered in order."""
    own = events
    if site is not None:
        own = own.where(F.col("site_id") == site)
    if session is not None:
        own = own.where(F.col("session_id") == session)
        ordered = own.orderBy("ts", "ingest_seq")
        return (ordered if limit is None else ordered.limit(limit)).select("site_id", "session_id", *TIMELINE_COLUMNS)
    narrow = own.select("site_id", "session_id", *TIMELINE_COLUMNS, "ingest_seq")
    return top_per(narrow, limit, [F.asc("ts"), F.asc("ingest_seq")], ["site_id", "session_id"]).drop("ingest_seq")


def _user_key(kind: str) -> tuple[str, Column]:
    if kind == "anonymous":
        return "visitor_id", F.col("identity") == ""
    return "identity", F.col("identity") != ""


def list_users(scope: Scope, kind: str = "identified", limit: int | None = 50, offset: int = 0) -> DataFrame:
    """people or daily visitors with their latest place and device; here filters do trim rows."""
    key, known = _user_key(kind)
    latest = F.max_by(F.struct("country", "device", "browser", "os"), in_order())
    grouped = (
        scope.rows()
        .where(known)
        .groupBy("site_id", F.col(key).alias("id"))
        .agg(
            distinct("session_id").alias("sessions"),
            count_when(is_pageview()).alias("pageviews"),
            count_when(is_event()).alias("events"),
            F.min("ts").alias("first_seen"),
            F.max("ts").alias("last_seen"),
            latest.alias("_latest"),
        )
    )
    page = top_per(grouped, limit, [F.desc("last_seen"), F.asc("id")], offset=max(0, offset))
    return page.select(*[c for c in page.columns if c != "_latest"], "_latest.*")


def count_users(scope: Scope, kind: str = "identified") -> DataFrame:
    key, known = _user_key(kind)
    return scope.per_site(scope.rows().where(known), distinct(key).alias("n"))


def profiles(events: DataFrame, identity: str | None = None) -> DataFrame:
    """all-time summary of identified users (of one, when named)."""
    own = events.where((F.col("identity") != "") & F.expr(AUDIENCES["human"]))
    if identity:
        own = own.where(F.col("identity") == identity)
    return own.groupBy("site_id", "identity").agg(
        distinct("session_id").alias("sessions"),
        count_when(is_pageview()).alias("pageviews"),
        count_when(is_event()).alias("events"),
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
    )


def exploded_props(rows: DataFrame, *kept: str) -> DataFrame:
    """One row per property, internal keys (leading underscore) left out."""
    spread = rows.select(*kept, F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))
    return spread.where(~F.col("key").startswith("_"))


def traits(events: DataFrame, identity: str | None = None, newest: int | None = None) -> DataFrame:
    """latest value of each trait over a user's ``identify`` events (the ``newest`` ones, if given)."""
    calls = events.where((F.col("name") == "identify") & (F.col("identity") != ""))
    if identity:
        calls = calls.where(F.col("identity") == identity)
    narrow = calls.select("site_id", "identity", "ts", "ingest_seq", "props")
    recent = top_per(narrow, newest, [F.desc("ts"), F.desc("ingest_seq")], ["site_id", "identity"])
    # Nested values start a JSON object or array; traits are scalars.
    scalars = exploded_props(recent, "site_id", "identity", "ts", "ingest_seq").where(
        F.col("value").isNull() | ~F.col("value").rlike(r"^[\[{]")
    )
    newest_value = F.max_by("value", in_order()).alias("value")
    return scalars.groupBy("site_id", "identity", "key").agg(newest_value)


def event_properties(scope: Scope, name: str | None = None, limit: int | None = None) -> DataFrame:
    """how often each property value occurs, per event name (of one, when named)."""
    rows = scope.rows().where(is_event())
    if name:
        rows = rows.where(F.col("name") == name)
    grouped = exploded_props(rows, "site_id", "name", "session_id").groupBy("site_id", "name", "key", "value").agg(
        F.count(F.lit(1)).alias("count"), distinct("session_id").alias("sessions")
    )
    return top_per(grouped, limit, [F.asc("key"), F.desc("count"), F.asc("value")], ["site_id", "name"])


def event_series(scope: Scope, width: int, name: str | None = None) -> DataFrame:
    """occurrences and sessions of an event per bucket."""
    rows = scope.rows().where(is_event())
    if name:
        rows = rows.where(F.col("name") == name)
    placed = rows.withColumn("bucket", bucket_of("ts", scope.window.from_ms, max(MINUTE_MS, width)))
    return placed.groupBy("site_id", "name", "bucket").agg(
        F.count(F.lit(1)).alias("count"), distinct("session_id").alias("sessions")
    )


def event_log(scope: Scope, name: str | None = None, limit: int | None = 100) -> DataFrame:
    """F8: the newest occurrences of an event."""
    rows = scope.rows().where(is_event())
    if name:
        rows = rows.where(F.col("name") == name)
    shown = "site_id name ts path session_id props country browser os device ingest_seq".split()
    newest = top_per(rows.select(*shown), limit, [F.desc("ts"), F.desc("ingest_seq")], ["site_id", "name"])
    return newest.drop("ingest_seq")


def error_occurrences(
    scope: Scope, message: str | None, source: str | None, line: int | str | None, limit: int | None = 200
) -> DataFrame:
    """occurrences of one error group, newest first; null matches a missing value."""
    wanted = {"message": message, "source": source, "line": None if line is None else str(line)}
    rows = scope.rows().where("name = 'error'")
    for key, value in wanted.items():
        rows = rows.where(prop(key).eqNullSafe(F.lit(value)))
    shown = "site_id ts path session_id browser os device country ingest_seq".split()
    return top_per(rows.select(*shown), limit, [F.desc("ts"), F.desc("ingest_seq")]).drop("ingest_seq")
