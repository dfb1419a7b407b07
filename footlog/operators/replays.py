"""Recordings of visits (C4, C5, F55 to F57): which are made, how chunks group, lists and playback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footlog.functions.aliases import recording_name
from footlog.functions.clients import BOT, client
from footlog.functions.identity import short_hash
from footlog.functions.stages import dropped, staged
from footlog.model import DAY_MS, HOUR_MS, MINUTE_MS, SESSION_GAP_MS, Window
from footlog.operators.ordered import as_of, reached, sessionize, top_per
from footlog.session import scratch
from footlog.sources.recordings import CHUNK_KEYS, CLICK, ERROR, GAP, INPUT, NAVIGATION, RETENTION_DAYS, SNAPSHOT

MAX_MINUTES = 30
VISIT = ["site_id", "visitor_id"]
#: Longer than any run of chunks.
FOREVER_MS = 1 << 60


def selected(requests: DataFrame, sites: DataFrame, settings: DataFrame) -> DataFrame:
    """Whether each visit is recorded, and why not; fails closed. Sampling follows the visitor's hash."""
    joined = requests.join(sites.select("site_id", "privacy_mode"), "site_id", "left").join(
        settings.select("site_id", "enabled", "sample_rate"), "site_id", "left"
    )
    refused = F.coalesce(F.try_element_at("headers", F.lit("dnt")) == "1", F.lit(False)) | F.coalesce(
        F.try_element_at("headers", F.lit("sec-gpc")) == "1", F.lit(False)
    )
    rate = F.coalesce("sample_rate", F.lit(1.0))
    share = F.conv(F.substring("visitor_id", 1, 8), 16, 10).cast("double") / F.lit(float(2**32))
    sampled = (rate >= 1) | ((rate > 0) & (share < rate))
    reason = (
        F.when(F.col("privacy_mode").isNull(), "site_unknown")
        .when(F.col("privacy_mode") == "strict", "strict_privacy_mode")
        .when(~F.coalesce("enabled", F.lit(False)), "replay_disabled")
        .when(refused, "do_not_track")
        .when(~sampled, "not_sampled")
        .otherwise("")
    )
    return joined.select(*requests.columns, (reason == "").alias("record"), reason.alias("reason"))


def chunk_facts(events: DataFrame) -> DataFrame:
    """One row per landed chunk that held any event; a chunk sent again counts once.

    Events are dealt out by chunk once, for the dropping of repeated ones and for the sums; only snapshots take their arguments along.
    """
    first = F.min_by(F.struct("args"), F.when(F.col("type") == SNAPSHOT, F.col("pos")))
    codes = {"clicks": [CLICK], "inputs": [INPUT], "errors": [ERROR], "gaps": [GAP], "pages": [SNAPSHOT, NAVIGATION]}
    slim = events.withColumn("args", F.when(F.col("type") == SNAPSHOT, F.col("args")))
    once = slim.repartition(*CHUNK_KEYS).dropDuplicates([*CHUNK_KEYS, "pos"])
    return once.groupBy(*CHUNK_KEYS).agg(
        F.min("ts").alias("ts"),
        F.max("bytes").alias("bytes"),
        F.max("t").alias("t_last"),
        F.count(F.lit(1)).alias("events"),
        *[F.sum(F.when(F.col("type").isin(of), 1).otherwise(0)).cast("long").alias(n) for n, of in codes.items()],
        first.alias("_snap"),
        F.min("user_agent").alias("user_agent"),
        F.min("country").alias("country"),
    )


def recorded_chunks(chunks: DataFrame, settings: DataFrame, gap_ms: int = SESSION_GAP_MS, staging: str | None = None) -> DataFrame:
    """C4: chunks with the recording they belong to: ``recording_from`` (arrival of its first chunk) and ``started_at``.

    A recording is open while its last chunk is at most the gap old, and takes chunks up to the site's time
    limit; later chunks are refused until the gap has passed, then a new recording begins.

    A run without such a gap that is longer than one recording is cut without walking it: every arrival points to the one
    that would begin the next recording, and the beginnings are what is reached from the run's first arrival by doubled
    pointers. The steps are stored in ``staging``, a folder all executors share, or below spark.checkpoint.dir.
    """
    limits = settings.select("site_id", (F.col("max_minutes").cast("long") * MINUTE_MS).alias("_limit"))
    runs = sessionize(chunks, VISIT, gap_ms).drop("session_no").withColumnRenamed("session_start", "_run")
    runs = runs.join(limits, "site_id", "left").withColumn("_limit", F.coalesce("_limit", F.lit(MAX_MINUTES * MINUTE_MS)).cast("long"))
    began = F.col("ts") - F.least("t_last", "_limit")
    run = [*VISIT, "_run"]
    spans = runs.groupBy(*run).agg(
        F.min_by(began, F.struct("ts", "page_load", "seq")).alias("_begun"), F.max("ts").alias("_end"), F.max("_limit").alias("_cap")
    )
    over = F.col("_end") - F.col("_begun") > F.col("_cap")
    whole = spans.where(~over).select(*run, F.struct(F.col("_run").alias("since"), F.col("_begun").alias("started")).alias("_mine"))
    short = runs.join(whole, run)
    long = runs.join(spans.where(over).select(*run, "_cap"), run)
    begun = _recordings_of_runs(long, run, began, gap_ms, staging)
    inside = as_of(long.drop("_cap"), begun, run, "_part", "_part", FOREVER_MS, gap_ms).where(F.col("ts") <= F.col("_part.until"))
    cut = inside.withColumn("_mine", F.struct("_part.since", "_part.started")).drop("_part")
    named = short.unionByName(cut).withColumns({"recording_from": F.col("_mine.since"), "started_at": F.col("_mine.started")})
    ident = F.expr(short_hash("concat_ws('|', 'replay', site_id, visitor_id, cast(recording_from as string))"))
    return named.withColumn("replay_id", ident).drop("_run", "_limit", "_mine")


def _recordings_of_runs(long: DataFrame, run: list[str], began: Column, gap_ms: int, staging: str | None) -> DataFrame:
    """The recordings of runs longer than one: (run, ts, _part), by the arrival that begins each."""

    folder = staging or scratch(long.sparkSession, "recordings")

    def cut(frame: DataFrame, name: str) -> DataFrame:
        frame.write.mode("overwrite").parquet(f"{folder}/{name}")
        return frame.sparkSession.read.schema(frame.schema).parquet(f"{folder}/{name}")

    first = F.min_by(began, F.struct("page_load", "seq"))
    arrivals = cut(long.groupBy(*run, "ts").agg(first.alias("started"), F.max("_cap").alias("_cap")), "arrivals")
    at = arrivals.select(*run, "ts", F.col("ts").alias("_at"))
    # The last arrival a recording that begins here may take, and the first one after the silence that follows it.
    asked = arrivals.select(*run, F.col("ts").alias("at"), "started", (F.col("started") + F.col("_cap")).alias("ts"))
    until = as_of(asked, at, run, "_at", "until", FOREVER_MS, gap_ms).drop("ts")
    back = at.withColumn("ts", -F.col("ts"))  # time turned round: the latest before is the earliest after
    onward = as_of(until.withColumn("ts", -(F.col("until") + gap_ms + 1)), back, run, "_at", "to", FOREVER_MS, gap_ms)
    pointers = cut(onward.select(*run, "at", "started", "until", "to"), "pointers")
    jumps = pointers.where("to IS NOT NULL").select(*run, "at", "to")
    # A recording and the silence after it take more than the gap, which bounds their number in the longest run.
    longest = pointers.groupBy(*run).agg((F.max("at") - F.min("at")).alias("span")).agg(F.max("span").alias("span")).first()["span"] or 0
    starts = pointers.groupBy(*run).agg(F.min("at").alias("at"))
    found = reached(starts, jumps, run, (longest // gap_ms).bit_length(), cut)
    part = F.struct(F.col("at").alias("since"), "started", "until").alias("_part")
    return pointers.join(found, [*run, "at"]).select(*run, F.col("at").alias("ts"), part)


def recordings(chunks: DataFrame, sessions: DataFrame) -> DataFrame:
    """C4: one row per recording with its counters, place and device, linked to the visit it shows.

    ``chunks`` comes from ``recorded_chunks``; ``sessions`` are analytics events (site_id, visitor_id, ts, session_id).
    """
    linked = as_of(chunks, sessions.select(*VISIT, "ts", "session_id"), VISIT, "session_id", "_session", SESSION_GAP_MS)
    order = F.struct("ts", "page_load", "seq")
    sums = ["events", "pages", "clicks", "inputs", "errors", "gaps", "bytes"]
    rows = linked.groupBy("site_id", "replay_id", "visitor_id").agg(
        F.min("started_at").alias("started_at"),
        F.max("ts").alias("last_at"),
        F.count(F.lit(1)).alias("chunks"),
        *[F.sum(c).cast("long").alias(c) for c in sums],
        F.min_by(F.struct("_snap", "user_agent", "country"), order).alias("_first"),
        F.coalesce(F.min_by("_session", F.when(F.col("_session").isNotNull(), order)), F.lit("")).alias("session_id"),
    )
    opened = rows.withColumns(
        {
            "entry_path": F.coalesce(F.get("_first._snap.args", F.lit(3)), F.lit("")),
            "viewport": F.coalesce(F.concat_ws("x", F.get("_first._snap.args", F.lit(1)), F.get("_first._snap.args", F.lit(2))), F.lit("")),
            "country": F.substring(F.upper(F.coalesce("_first.country", F.lit(""))), 1, 2),
            "user_agent": F.col("_first.user_agent"),
        }
    )
    seen = staged(opened, *BOT, *client(), {"device": "_device"})
    return dropped(seen).drop("user_agent").withColumn("name", recording_name(F.col("visitor_id")))


def newest(rows: DataFrame, window: Window, limit: int | None = None) -> DataFrame:
    """Recordings of a window, all of them or the newest per site."""
    inside = rows.where(window.contains("started_at"))
    return top_per(inside, limit, [F.desc("started_at"), F.asc("replay_id")])


def picked_replays(
    rows: DataFrame,
    settings: DataFrame,
    window: Window,
    now_ms: int,
    min_duration_ms: int = 0,
    min_pages: int = 0,
    errors_only: bool = False,
    equal: dict[str, str] | None = None,
) -> DataFrame:
    """the recordings asked for; past its retention a recording is gone even before it is purged.

    ``equal`` narrows by country, device, browser or session_id.
    """
    days = F.coalesce("retention_days", F.lit(RETENTION_DAYS)).cast("long")
    kept = rows.where(window.contains("started_at")).join(settings.select("site_id", "retention_days"), "site_id", "left")
    kept = kept.where(F.col("started_at") >= F.lit(now_ms) - days * DAY_MS).drop("retention_days")
    kept = kept.where((F.col("last_at") - F.col("started_at") >= min_duration_ms) & (F.col("pages") >= min_pages))
    if errors_only:
        kept = kept.where(F.col("errors") > 0)
    for column, value in (equal or {}).items():
        if column not in ("country", "device", "browser", "session_id"):
            raise ValueError(f'cannot filter recordings by "{column}"')
        kept = kept.where(F.col(column) == value)
    return kept


def list_replays(
    rows: DataFrame, settings: DataFrame, window: Window, now_ms: int, limit: int | None = 50, offset: int = 0, **picked
) -> DataFrame:
    """recordings, newest first."""
    kept = picked_replays(rows, settings, window, now_ms, **picked)
    return top_per(kept, limit, [F.desc("started_at"), F.asc("replay_id")], offset=max(0, offset))


def count_replays(rows: DataFrame, settings: DataFrame, window: Window, now_ms: int, **picked) -> DataFrame:
    """F55 total: how many recordings the pages hold."""
    return picked_replays(rows, settings, window, now_ms, **picked).groupBy("site_id").agg(F.count(F.lit(1)).alias("total"))


def clock(events: DataFrame) -> DataFrame:
    """per page load its offset on the server's clock, and when its recording starts and ends.

    Each chunk pins its page load to the clock; the earliest estimate has the least network delay in it.
    """
    loads = ["site_id", "replay_id", "page_load"]
    chunks = events.groupBy(*loads, "seq").agg(F.min("ts").alias("ts"), F.max("t").alias("t_hi"), F.min("t").alias("t_lo"))
    pinned = chunks.groupBy(*loads).agg(F.min(F.col("ts") - F.col("t_hi")).alias("offset"), F.min("t_lo").alias("lo"), F.max("t_hi").alias("hi"))
    spans = pinned.groupBy("site_id", "replay_id").agg(
        F.min(F.col("offset") + F.col("lo")).alias("start_ts"), F.max(F.col("offset") + F.col("hi")).alias("end_ts")
    )
    return pinned.select(*loads, "offset").join(spans, ["site_id", "replay_id"])


def playback(events: DataFrame) -> DataFrame:
    """every recorded event on its recording's own clock (``at`` is ms since the start)."""
    timed = events.join(clock(events), ["site_id", "replay_id", "page_load"])
    at = F.col("offset") + F.col("t") - F.col("start_ts")
    return timed.select("site_id", "replay_id", "page_load", "seq", "pos", at.alias("at"), "type", "args")


def markers(events: DataFrame, recorded: DataFrame, analytics: DataFrame, limit: int | None = None) -> DataFrame:
    """the visit's analytics events around each recording, on its clock; exit summaries are left out.

    A range join: both sides meet on (site, session, hour), so an event is compared only with recordings of its hour.
    """
    margin = 5_000
    spans = clock(events).select("site_id", "replay_id", "start_ts", "end_ts").distinct()
    shown = spans.join(recorded.where("session_id <> ''").select("site_id", "replay_id", "session_id"), ["site_id", "replay_id"])
    hours = F.sequence(
        F.floor((F.col("start_ts") - margin) / HOUR_MS).cast("long"), F.floor((F.col("end_ts") + margin) / HOUR_MS).cast("long")
    )
    spread = shown.withColumn("_hour", F.explode(hours))
    told = analytics.where("name NOT IN ('web_vitals', 'scroll')").select(
        "site_id", "session_id", "ts", "ingest_seq", "type", "name", "path", F.floor(F.col("ts") / HOUR_MS).cast("long").alias("_hour")
    )
    met = spread.join(told, ["site_id", "session_id", "_hour"]).where(
        (F.col("ts") >= F.col("start_ts") - margin) & (F.col("ts") <= F.col("end_ts") + margin)
    )
    page = F.col("type") == "pageview"
    kind = F.when(page, "pageview").when(F.col("name") == "error", "error").otherwise("event")
    marked = met.select(
        "site_id", "replay_id", "ts", "ingest_seq",
        F.greatest(F.lit(0).cast("long"), F.col("ts") - F.col("start_ts")).alias("t"),
        kind.alias("kind"),
        F.when(page, F.col("path")).otherwise(F.concat_ws(" · ", "name", "path")).alias("label"),
    )
    return top_per(marked, limit, [F.asc("ts"), F.asc("ingest_seq")], ["site_id", "replay_id"]).drop("ts", "ingest_seq")
