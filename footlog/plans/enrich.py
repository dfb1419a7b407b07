"""Raw requests to stored events (B1 to B24, C1): one job of column stages and one shuffle for sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footlog.functions import bodies, channels, clients, identity, places, privacy, urls
from footlog.functions.stages import dropped, staged
from footlog.model import DAY_MS, EVENT_SCHEMA, SESSION_GAP_MS
from footlog.operators.ordered import sessionize
from footlog.sources.event_table import new_events, with_defaults

# What a raw request carries: the body as text and what the server observed.
RAW_SCHEMA = (
    "request_id string, ingest_seq long, body string, received_at long, ip string, user_agent string, "
    "headers map<string,string>, host string, signature string, signer string"
)


def parse(raw: DataFrame) -> DataFrame:
    """The body read once; refused rows keep their reason, the rest their cleaned fields."""
    rows = staged(raw.withColumnRenamed("host", "server_host"), *bodies.PARSE, *bodies.REVENUE)
    return dropped(rows).drop(*[f"f_{name}" for name in bodies.LIMITS])


def admit(parsed: DataFrame, sites: DataFrame, allow_unknown: bool = False) -> DataFrame:
    """Look up the site (site_id, domain, privacy_mode) and honour opt-outs on strict sites."""
    known = sites.select("site_id", "domain", "privacy_mode", F.lit(True).alias("_known"))
    judged = staged(
        parsed.join(known, "site_id", "left"),
        {"strict": "coalesce(privacy_mode = 'strict', false)", "headers": "coalesce(headers, cast(map() as map<string,string>))"},
        {
            "reject_reason": f"""coalesce(reject_reason,
              CASE WHEN _known IS NULL AND {str(not allow_unknown).lower()} THEN 'site_unknown' END,
              CASE WHEN strict AND {privacy.OPTED_OUT} THEN 'do_not_track' END)"""
        },
    )
    return dropped(judged).drop("privacy_mode")


def protect(rows: DataFrame) -> DataFrame:
    """Policy of the site, personal properties, plan label, raw-id flag."""
    return dropped(staged(rows, *privacy.PROTECT))


def label(rows: DataFrame, secret: str, sdk: str = "footlog") -> DataFrame:
    """Who and what sent the event, where it came from, when."""
    seen = staged(
        rows,
        {"ts": "received_at - ago", "_fallback": "coalesce(nullif(domain, ''), nullif(server_host, ''), 'localhost')"},
        *clients.BOT,
        *clients.client(sdk),
        *clients.SIGNALS,
        *urls.SPLIT_URL,
        *urls.UTM,
        *urls.REFERRER_HOST,
        {"_own_host": "coalesce(nullif(domain, ''), _url_host)"},
        *channels.CLASSIFY,
        *places.LOCATE,
        *identity.NORMAL_IP,
        {
            "_placed": "NOT strict AND _country <> ''",
            "bot_kind": "_bot[0]",
            "bot_name": "_bot[1]",
            "visitor_id": identity.visitor_id(secret),
            "identity": identity.identity_hash(secret),
            "entries": bodies.added("entries", "_signal", "_verdict.signal"),
        },
    )
    own = {
        "id": "request_id",
        "name": "CASE WHEN type = 'pageview' THEN 'pageview' ELSE name END",
        "channel": "_verdict.channel",
        "source": "_verdict.source",
        "device": "CASE WHEN bot_kind <> '' THEN 'bot' ELSE _device END",
        "country": "CASE WHEN strict THEN '' ELSE _country END",
        "region": "CASE WHEN _placed AND startswith(_region, concat(_country, '-')) THEN substring(_region, 1, 6) ELSE '' END",
        "region_name": "CASE WHEN _placed THEN _region_name ELSE '' END",
        "city": "CASE WHEN _placed THEN _city ELSE '' END",
        "lat": "CASE WHEN _placed AND _paired THEN _lat END",
        "lon": "CASE WHEN _placed AND _paired THEN _lon END",
        "agent_trust": clients.TRUST,
        "agent_signer": "CASE WHEN signature = 'verified' THEN coalesce(signer, '') ELSE '' END",
        "props": bodies.PROPS,
    }
    kept = [c for c in EVENT_SCHEMA.fieldNames() if c not in own and c != "session_id"]
    return seen.select(*kept, *[F.expr(text).alias(name) for name, text in own.items()])


def enrich(
    raw: DataFrame, sites: DataFrame, secret: str, allow_unknown: bool = False, sdk: str = "footlog"
) -> tuple[DataFrame, DataFrame]:
    """Events without sessions, and refused requests with their reason. Stateless: also runs on a stream."""
    judged = admit(parse(raw), sites, allow_unknown)
    refused = judged.where(F.col("reject_reason").isNotNull()).select("request_id", "site_id", "received_at", "reject_reason")
    kept = judged.where(F.col("reject_reason").isNull())
    return label(protect(kept), secret, sdk), refused


SESSION_NAME = identity.short_hash("concat_ws('|', site_id, visitor_id, cast(session_start as string))")


def assign_sessions(events: DataFrame, gap_ms: int = SESSION_GAP_MS) -> DataFrame:
    """The session id of every event; a session ends after more than the gap without an event."""
    placed = sessionize(events, ["site_id", "visitor_id"], gap_ms)
    return placed.withColumn("session_id", F.expr(SESSION_NAME)).drop("session_start", "session_no")


def continue_sessions(fresh: DataFrame, stored: DataFrame, gap_ms: int = SESSION_GAP_MS) -> DataFrame:
    """C1 across runs: session ids of new events that go on from the stored ones.

    New and stored events of the same visitors are placed together. A visit that holds stored events keeps the id of the
    earliest of them, so neither a later nor a late event gives one visit two ids; stored rows are never renamed.
    """
    keys, columns = ["site_id", "visitor_id"], [c for c in fresh.columns if c != "session_id"]
    days = fresh.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).first()
    near = stored
    if days["lo"] is not None:
        # A visitor id is used for one UTC day; the gap may reach into the next.
        near = stored.where(F.col("ts").between(days["lo"] - DAY_MS, days["hi"] + DAY_MS))
        if "day" in stored.columns:
            first, last = (F.date_from_unix_date(F.lit(t // DAY_MS)) for t in (days["lo"] - DAY_MS, days["hi"] + DAY_MS))
            near = near.where(F.col("day").between(first, last))
    near = near.join(fresh.select(*keys).distinct(), keys, "left_semi")
    old = near.select(*columns, F.col("session_id").alias("_stored"))
    placed = sessionize(fresh.select(*columns, F.lit(None).cast("string").alias("_stored")).unionByName(old), keys, gap_ms)
    named = placed.where("_stored IS NOT NULL").groupBy(*keys, "session_no").agg(F.min_by("_stored", F.struct("ts", "ingest_seq")).alias("_kept"))
    mine = placed.where("_stored IS NULL").drop("_stored").join(named, [*keys, "session_no"], "left")
    return mine.withColumn("session_id", F.coalesce("_kept", F.expr(SESSION_NAME))).drop("session_start", "session_no", "_kept")


def ingest(
    raw: DataFrame, sites: DataFrame, secret: str, staging: str | None = None, stored: DataFrame | None = None, **options
) -> tuple[DataFrame, DataFrame]:
    """The whole batch job: events to store in table order, and refused requests.

    With ``stored``, the event table so far, ids already there are left out and visits go on from the stored ones.

    Sessions read the enriched events twice. With ``staging``, a folder all executors share, they are written
    there once instead of being enriched a second time, a lost executor costs no re-enrichment, and the session
    step is planned over plain columns. Name one for every real run.
    """
    events, refused = enrich(raw, sites, secret, **options)
    if staging is not None:
        events.write.mode("overwrite").parquet(staging)
        events = raw.sparkSession.read.schema(events.schema).parquet(staging)
    if stored is None:
        return assign_sessions(events).select(*EVENT_SCHEMA.fieldNames()), refused
    fresh = new_events(with_defaults(events), stored)
    return continue_sessions(fresh, stored).select(*EVENT_SCHEMA.fieldNames()), refused


def rejection_report(refused: DataFrame) -> DataFrame:
    """Refused requests by reason."""
    return refused.groupBy("reject_reason").agg(F.count(F.lit(1)).alias("requests"))


def classification_quality(predicted: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """Accuracy of channel and source, and precision and recall of the ``ai`` channel.

    ``labels`` holds ``want_channel``, ``want_source`` and ``want_bot`` beside the keys.
    """
    both = predicted.join(labels, keys)
    right = (F.col("channel") == F.col("want_channel")) & (F.col("source") == F.col("want_source"))
    right = right & (F.col("bot_kind") == F.col("want_bot"))
    said, is_ai = F.col("channel") == "ai", F.col("want_channel") == "ai"

    def count(condition: Column) -> Column:
        return F.sum(F.when(condition, 1).otherwise(0)).cast("long")

    sums = both.agg(
        F.count(F.lit(1)).alias("cases"),
        count(right).alias("correct"),
        count(said & is_ai).alias("ai_hits"),
        count(said).alias("ai_said"),
        count(is_ai).alias("ai_wanted"),
    )

    def share(part: str, whole: str) -> Column:
        return F.when(F.col(whole) > 0, F.col(part) / F.col(whole))

    return sums.select(
        "cases",
        "correct",
        share("correct", "cases").alias("accuracy"),
        share("ai_hits", "ai_said").alias("precision"),
        share("ai_hits", "ai_wanted").alias("recall"),
    )
