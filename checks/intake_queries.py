"""Registered queries of intake, sessions, recordings, change lines and the claim check."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import sample_requests as sample
from checks.sample_view import GAP_MS, event_table, shared_folder, spread, unsessioned
from footlog.functions import channels, privacy, urls
from footlog.functions.stages import staged
from footlog.functions.values import number, prop
from footlog.model import DAY_MS, EVENT_SCHEMA, SESSION_GAP_MS, Scope, Window
from footlog.operators import changes, claims, heatmap, replays
from footlog.operators.ordered import sessionize
from footlog.plans import enrich as job
from footlog.sources import beacons, csv_history, event_table as stored, recordings
from footlog.streaming import live
from footlog.streaming import sessions as stream

Query = Callable[[SparkSession, str], DataFrame]
FULL = Window(1_704_067_200_000, 1_706_659_200_000)
LATE = Window(1_705_363_200_000, 1_706_659_200_000)
NOW = FULL.to_ms
CLOCK = ((3_600_000, 24, 2), (60_000, 60, 2), (1_000, 60, 2), (1, 1_000, 3))


def counting(name: str) -> Column:
    return F.count(F.lit(1)).alias(name)


def enriched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return job.enrich(sample.requests(spark, sf_dir), sample.request_sites(spark, sf_dir), sample.SECRET)


def counted(*columns: str) -> Query:
    """Enriched events by some of their columns."""
    return lambda spark, sf_dir: enriched(spark, sf_dir)[0].groupBy(*columns).agg(counting("events"))


def reject_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return job.rejection_report(enriched(spark, sf_dir)[1])


def rejected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enriched(spark, sf_dir)[1].select("request_id", "reject_reason")


def revenue_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = enriched(spark, sf_dir)[0].where("name = 'purchase'")
    return rows.groupBy(prop("_revenue_rejected").alias("reason"), prop("currency").alias("currency"), number("revenue").alias("revenue")).agg(
        counting("events")
    )


def strict_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = enriched(spark, sf_dir)[0]

    def having(condition: str) -> Column:
        return F.sum(F.when(F.expr(condition), 1).otherwise(0)).cast("long")

    return rows.groupBy("site_id").agg(
        having("identity <> ''").alias("identified"),
        having("screen <> ''").alias("screens"),
        having("country <> ''").alias("placed"),
        having("referrer LIKE '%?%'").alias("referrer_queries"),
    )


def personal_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B6 at scale: words of every document that read as an e-mail address or phone number."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    words = docs.select("doc_id", F.explode(F.split("text", r"\s+")).alias("word"))
    hit = words.where(F.expr(privacy.personal_value("word")))
    return hit.groupBy("doc_id").agg(counting("personal"))


def page_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    stages = (
        {"_fallback": "'localhost'", "referrer": "url"}, *urls.SPLIT_URL, *urls.UTM, *urls.REFERRER_HOST,
        {"_own_host": "'shop.example'"}, *channels.CLASSIFY,
    )
    return staged(pages, *stages)


def page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_requests(spark, sf_dir).select("page_id", "path", "query", F.col("_url_host").alias("host"))


def page_campaigns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_requests(spark, sf_dir).select("page_id", "utm_source", "utm_medium", "referrer_host")


def page_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_requests(spark, sf_dir).select("page_id", "_verdict.channel", "_verdict.source", "_verdict.signal")


def request_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = enriched(spark, sf_dir)[0]
    return rows.groupBy("channel", "source", "referrer_host", prop("_signal").alias("signal")).agg(counting("events"))


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enriched(spark, sf_dir)[0].select(*[c for c in EVENT_SCHEMA.fieldNames() if c != "session_id"])


def ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enriched(spark, sf_dir)[0].select("id", "ts", "visitor_id", "identity")


def ip_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from footlog.functions.identity import NORMAL_IP

    rows = sample.requests(spark, sf_dir).select("request_id", "ip")
    return staged(rows, *NORMAL_IP).groupBy(F.col("_ip").alias("prefix")).agg(counting("requests"))


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every request beside its labelled case."""
    predicted = enriched(spark, sf_dir)[0].select("id", "channel", "source", "bot_kind")
    return job.classification_quality(predicted, sample.labels(spark, sf_dir), ["id"])


def ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    staging = f"{shared_folder(spark)}/footlog-{spark.sparkContext.applicationId}-{uuid.uuid4().hex[:8]}/enriched"
    events, _ = job.ingest(sample.requests(spark, sf_dir), sample.request_sites(spark, sf_dir), sample.SECRET, staging)
    return events.select("id", "session_id")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1 with the production gap, on the events of the view."""
    rows = sessionize(unsessioned(spark, sf_dir), ["site_id", "visitor_id"], SESSION_GAP_MS)
    return rows.select("id", "session_start", "session_no")


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view's events as a stream of arrivals, every tenth six hours late; visits by the slices the stream told."""
    columns = ["id", "ts", "ingest_seq", "site_id", "visitor_id"]
    arrived = F.col("ts") + F.when(F.col("ingest_seq") % 10 == 0, 6 * 3_600_000).otherwise(0)
    rows = unsessioned(spark, sf_dir).withColumn("batch", F.floor((arrived - FULL.from_ms) / F.lit(6 * DAY_MS)))

    def write(path: str) -> DataFrame:
        return streamed(rows, columns, path, lambda source: stream.session_slices(source, GAP_MS))

    named = stream.named_by_slices(rows, kept_table(spark, sf_dir, "stream_sessions", write), GAP_MS)
    return named.groupBy("site_id", "session_id").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), counting("events"))


def stream_visitors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view's events as the same stream of arrivals; visitors of every five minutes, minute by minute."""
    columns = ["ts", "site_id", "visitor_id", "bot_kind", "bot_score", "agent_trust"]
    arrived = F.col("ts") + F.when(F.col("ingest_seq") % 10 == 0, 6 * 3_600_000).otherwise(0)
    # A site's events of a day as twenty visitors', ten times as close, so that visitors come back within minutes.
    start = F.floor(F.col("ts") / DAY_MS).cast("long") * DAY_MS
    rows = unsessioned(spark, sf_dir).withColumns(
        {"batch": F.floor((arrived - FULL.from_ms) / F.lit(6 * DAY_MS)), "visitor_id": (F.col("ingest_seq") % 20).cast("string"), "ts": start + F.floor(F.col("ts") % DAY_MS / 10).cast("long")}
    )

    def write(path: str) -> DataFrame:
        return streamed(rows, columns, path, lambda source: live.live_panes(source, lateness="48 hours"))

    return live.live_counts(kept_table(spark, sf_dir, "stream_visitors", write))


def streamed(rows: DataFrame, columns: list[str], path: str, job: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The stored result of a job over the rows as a stream, batch by batch."""
    spark = rows.sparkSession
    for batch in range(6):  # written one after another, so that the source reads them in this order
        rows.where(F.col("batch") == batch).select(*columns).repartition(2).write.mode("append").parquet(f"{path}/arrivals")
    source = spark.readStream.schema(rows.select(*columns).schema).option("maxFilesPerTrigger", 2).parquet(f"{path}/arrivals")
    settings = {"spark.sql.streaming.stateStore.providerClass": stream.ROCKSDB, "spark.sql.shuffle.partitions": "4"}
    before = {key: spark.conf.get(key, None) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        writer = job(source).writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoint")
        writer.trigger(availableNow=True).start(f"{path}/told").awaitTermination()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    return spark.read.parquet(f"{path}/told")


def split_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: every document through CSV files, its texts' line breaks, commas and quotes in quoted fields; the files are read
    in ranges so short that most of them begin inside a field, many ranges a task."""

    def write(path: str) -> DataFrame:
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
        spaces = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
        docs.write.options(header=True, quoteAll=True, escape='"', **spaces).csv(f"{path}/export")
        exported = spark.read.format("binaryFile").load(f"{path}/export").agg(F.sum("length")).first()[0] or 0
        # Ranges are cut by the first setting and put together into tasks by the second.
        settings = {"spark.sql.files.maxPartitionBytes": str(128 << 10), "spark.sql.files.maxPartitionNum": str(64 + exported // (16 << 20))}
        before = {key: spark.conf.get(key, None) for key in settings}
        try:
            for key, value in settings.items():
                spark.conf.set(key, value)
            csv_history.read_csv(spark, f"{path}/export").write.parquet(f"{path}/rows")
        finally:
            for key, value in before.items():
                spark.conf.unset(key) if value is None else spark.conf.set(key, value)
        return spark.read.parquet(f"{path}/rows")

    return kept_table(spark, sf_dir, "split_csv", write).select("doc_id", "lang", F.sha2("text", 256).alias("text_sha256"))


def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: the stored table read through a window, per day partition."""
    rows = Scope(event_table(spark, sf_dir), LATE).rows("everyone")
    return rows.groupBy("site_id", F.date_format("day", "yyyy-MM-dd").alias("day")).agg(counting("events"))


def idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: everything arrives again, twice, while the first half is stored."""
    rows = unsessioned(spark, sf_dir)
    first = rows.where(FULL.contains() & (F.col("ts") < LATE.from_ms))
    fresh = stored.new_events(rows.unionByName(rows), first)
    return fresh.groupBy("site_id").agg(counting("added"), F.min("ts").alias("from_ts"))


def earliest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: every event arrives three times, later copies with another path; the first arrival is what stays."""
    rows = unsessioned(spark, sf_dir)
    later = [rows.withColumns({"ingest_seq": F.col("ingest_seq") + n, "path": F.lit("/late")}) for n in (10**9, 2 * 10**9)]
    fresh = stored.new_events(later[1].unionByName(rows).unionByName(later[0]), rows.where("false"))
    return fresh.groupBy("site_id", "path").agg(counting("added"), F.sum("ingest_seq").cast("long").alias("arrivals"))


def appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: the stored table after the first half was written and everything was appended on top, twice."""

    def write(path: str) -> DataFrame:
        rows = stored.with_defaults(unsessioned(spark, sf_dir)).select(*EVENT_SCHEMA.fieldNames())
        stored.write_events(rows.where(F.col("ts") < LATE.from_ms), path)
        for _ in range(2):
            stored.append_events(rows, path)
        return stored.read_events(spark, path)

    rows = kept_table(spark, sf_dir, "appended", write)
    return rows.groupBy("site_id").agg(counting("events"), F.min("ts").alias("from_ts"), F.max("ts").alias("to_ts"))


def removed_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored table after one of its two batches was removed."""

    def write(path: str) -> DataFrame:
        batch = F.when(F.col("device") == "desktop", "b1").otherwise("b2")
        tagged = stored.with_defaults(unsessioned(spark, sf_dir)).withColumn("props", F.to_json(F.struct(batch.alias("_import"))))
        stored.write_events(tagged.select(*EVENT_SCHEMA.fieldNames()), path)
        stored.remove_batch(spark, path, f"{path}-staging", "s0", "b1")
        return stored.read_events(spark, path)

    return kept_table(spark, sf_dir, "removed", write).groupBy("site_id").agg(counting("events"))


def two_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events in three runs, odd minutes first, then even ones in two halves: late rows and visits across runs.

    Each run is sessionized against what is stored by then; afterwards every visit of one run over everything is checked
    for its ids: they are those of stored events that belong to it.
    """

    def write(path: str) -> DataFrame:
        rows = stored.with_defaults(unsessioned(spark, sf_dir)).select(*EVENT_SCHEMA.fieldNames())
        odd = F.floor(F.col("ts") / 60_000) % 2 == 1
        job_rows = [rows.where(F.col("ts") < LATE.from_ms), rows.where((F.col("ts") >= LATE.from_ms) & odd), rows.where((F.col("ts") >= LATE.from_ms) & ~odd)]
        stored.write_events(rows.where("false"), path)
        for part in job_rows:
            named = job.continue_sessions(part, stored.read_events(spark, path).select(*EVENT_SCHEMA.fieldNames()))
            stored.write_events(named.select(*EVENT_SCHEMA.fieldNames()), path)
        return stored.read_events(spark, path)

    return kept_table(spark, sf_dir, "three_runs", write)


def session_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1 across runs: per site the visits of one run over everything, and how many ids of three runs they share.

    A visit never has more ids than runs stored parts of it apart, and no id spans two visits.
    """
    whole = sessionize(unsessioned(spark, sf_dir), ["site_id", "visitor_id"], SESSION_GAP_MS).select("id", "site_id", "visitor_id", "session_no")
    parts = two_runs(spark, sf_dir).select("id", "session_id").join(whole, "id")
    ids = parts.groupBy("site_id", "session_id").agg(F.countDistinct("visitor_id", "session_no").alias("visits"), counting("events"))
    return ids.groupBy("site_id").agg(F.sum("events").cast("long").alias("events"), F.max("visits").alias("visits_per_id"))


def landed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: request bodies parsed from their text, by site and type."""
    rows = job.parse(sample.requests(spark, sf_dir)).where("reject_reason IS NULL")
    return rows.groupBy("site_id", "type", "lang", "hostname").agg(counting("requests"))


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: one batch per site of every 60 arrivals in a row, now and then of 600, each opened again into its events."""
    raw = sample.requests(spark, sf_dir).where(F.expr("body LIKE '{%}'"))
    parts = [c for c in raw.columns if c not in ("request_id", "ingest_seq", "body")]
    site = F.coalesce(F.get_json_object("body", "$.site"), F.lit("none"))
    arrival = F.col("ingest_seq")
    run = F.when(F.floor(arrival / 600) % 20 == 0, F.floor(arrival / 600)).otherwise(1_000_000_000 + F.floor(arrival / 60))
    key = F.concat_ws("|", site, run.cast("string"))  # at most 600 arrivals
    grouped = raw.groupBy(key.alias("request_id")).agg(
        F.concat(F.lit('{"events":['), F.array_join(F.sort_array(F.collect_list("body")), ","), F.lit("]}")).alias("body"),
        F.min("ingest_seq").alias("ingest_seq"),
        *[F.min_by(c, "ingest_seq").alias(c) for c in parts],
    )
    single, refused = beacons.open_batches(grouped)
    opened = single.agg(counting("requests")).select(F.lit("opened").alias("outcome"), "requests")
    return opened.unionByName(refused.groupBy(F.col("reject_reason").alias("outcome")).agg(counting("requests")))


def exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view as an analytics export: visits and sessions are the export's own."""
    rows = spread(unsessioned(spark, sf_dir))
    # Spelled out in UTC, whatever the session's time zone.
    clock = [F.lpad(F.floor(F.col("ts") / unit % size).cast("string"), width, "0") for unit, size, width in CLOCK]
    date = F.date_format(F.date_from_unix_date(F.floor(F.col("ts") / 86_400_000).cast("int")), "yyyy-MM-dd")
    ts = F.concat(date, F.lit(" "), F.concat_ws(":", *clock[:3]), F.lit("."), clock[3])
    last = F.substring("id", -1, 1)
    return rows.select(
        F.when(last == "3", "").otherwise(F.col("id")).alias("event_id"),
        F.col("visitor_id").alias("session_id"),
        F.lit("").alias("visit_id"),
        F.when(last == "7", "yesterday").otherwise(ts).alias("created_at"),
        F.col("path").alias("url_path"),
        F.col("query").alias("url_query"),
        F.col("referrer_host").alias("referrer_domain"),
        F.when(F.col("type") == "pageview", "1").when(last == "9", "7").otherwise("2").alias("event_type"),
        F.when((F.col("type") == "event") & (last != "1"), F.col("name")).otherwise("").alias("event_name"),
        F.lower("browser").alias("browser"),
        F.col("os"),
        F.when(F.col("device") == "desktop", "laptop").otherwise(F.col("device")).alias("device"),
        F.col("country"),
        F.regexp_replace("region", "^[A-Z]{2}-", "").alias("region"),
        F.col("city"),
        F.col("hostname"),
        F.col("lang").alias("language"),
        F.col("screen"),
        F.col("title").alias("page_title"),
        F.col("utm_campaign"),
        F.col("tag"),
    )


def mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return csv_history.mapped(exported(spark, sf_dir), "imported", "example.com", "b1", LATE.from_ms)


def import_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mapped(spark, sf_dir)
    stored_before = rows.where(F.col("skip_reason").isNull() & (F.col("ts") < FULL.from_ms + 86_400_000))
    return csv_history.summary(rows, stored_before)


def imported(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = csv_history.importable(mapped(spark, sf_dir), mapped(spark, sf_dir).where("false"))
    return rows.groupBy("channel", "source", "browser", "os", "device", "region").agg(
        counting("events"), F.countDistinct("visitor_id").alias("visitors"), F.countDistinct("session_id").alias("sessions")
    )


def removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One batch of one site taken out of a table of two batches."""
    rows = unsessioned(spark, sf_dir)
    batch = F.when(F.col("device") == "desktop", "b1").otherwise("b2")
    tagged = rows.withColumn("props", F.to_json(F.struct(batch.alias("_import"))))
    return stored.without_batch(tagged, "s0", "b1").groupBy("site_id").agg(counting("events"))


def backfilled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file that lacks newer columns, read with their defaults."""
    old = unsessioned(spark, sf_dir).drop("bot_kind", "agent_trust", "agent_signer", "bot_score", "lat", "tag")
    full = stored.with_defaults(old)
    return full.groupBy("site_id", "bot_kind", "agent_trust", "agent_signer", "bot_score", "tag").agg(counting("events"), F.count("lat").alias("lats"))


_stored: dict[tuple[str, str, str], DataFrame] = {}


def kept_table(spark: SparkSession, sf_dir: str, name: str, write: Callable[[str], DataFrame]) -> DataFrame:
    """A table written once per application to the shared folder and read from then on."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _stored:
        _stored[key] = write(f"{shared_folder(spark)}/footlog-{key[0]}-{uuid.uuid4().hex[:8]}/{name}")
    return _stored[key]


def opened_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_table(spark, sf_dir, "chunks", lambda path: recordings.store_chunks(sample.chunks(spark, sf_dir), path))


def landed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recordings.accepted(opened_chunks(spark, sf_dir))


def refused_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample's chunks, some of them spoilt in each way a chunk is refused for."""
    n = F.col("seq") % 50
    spoilt = sample.chunks(spark, sf_dir).withColumns(
        {
            "page_load": F.when(n == 1, "").otherwise(F.col("page_load")),
            "gzip": n == 2,
            "body": F.when(n == 3, F.lit("[1, 2").cast("binary")).when(F.col("seq") % 2000 == 4, F.repeat(F.lit(" "), 1_000_001).cast("binary")).otherwise(F.col("body")),
        }
    )
    return recordings.refusals(recordings.open_chunks(spoilt))


def chunk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = landed_chunks(spark, sf_dir)
    return rows.groupBy("type").agg(counting("events"), F.sum(F.col("pos").cast("long")).alias("positions"), F.sum(F.size("args").cast("long")).alias("arguments"))


def replay_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recording settings of the sites; one site records half of its visitors, one keeps recordings shorter."""
    named = sample.request_sites(spark, sf_dir).select("site_id")
    site = F.col("site_id")
    return named.select(
        "site_id",
        F.lit(True).alias("enabled"),
        F.when(site == "s1", 0.5).otherwise(1.0).alias("sample_rate"),
        F.lit(30).alias("max_minutes"),
        F.when(site == "s0", 15).otherwise(30).alias("retention_days"),
    )


def chunk_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per chunk, kept: placing chunks in recordings reads it several times."""

    def write(path: str) -> DataFrame:
        facts = replays.chunk_facts(landed_chunks(spark, sf_dir))
        facts.write.parquet(path)
        return spark.read.schema(facts.schema).parquet(path)

    return kept_table(spark, sf_dir, "chunk_facts", write)


def dense_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4 with limits met: a site's events of a day as one visitor's chunks, in half the time, so that runs without a silence
    last for hours and are cut into many recordings. One site's limit is ten minutes."""
    day = F.floor(F.col("ts") / DAY_MS)
    chunks = unsessioned(spark, sf_dir).select(
        "site_id",
        F.concat(F.lit("day-"), day.cast("string")).alias("visitor_id"),
        F.lpad("id", 9, "0").alias("page_load"),
        F.lit(0).alias("seq"),
        (day * DAY_MS + F.floor((F.col("ts") % DAY_MS) / 2)).cast("long").alias("ts"),
        (F.col("ingest_seq") * 7919 % 60_000).alias("t_last"),
    )
    settings = replay_settings(spark, sf_dir).withColumn("max_minutes", F.when(F.col("site_id") == "s1", 10).otherwise(30))

    def write(path: str) -> DataFrame:
        replays.recorded_chunks(chunks, settings, staging=f"{path}-steps").write.parquet(path)
        return spark.read.parquet(path)

    placed = kept_table(spark, sf_dir, "dense_recordings", write)
    return placed.groupBy("site_id", "visitor_id", "recording_from", "started_at").agg(counting("chunks"), F.max("ts").alias("last_at"))


def recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with their recording, kept as well."""

    def write(path: str) -> DataFrame:
        placed = replays.recorded_chunks(chunk_table(spark, sf_dir), replay_settings(spark, sf_dir), staging=f"{path}-steps")
        placed.write.parquet(path)
        return spark.read.schema(placed.schema).parquet(path)

    return kept_table(spark, sf_dir, "recorded_chunks", write)


def replay_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = event_table(spark, sf_dir).select("site_id", "visitor_id", "ts", "session_id")
    return replays.recordings(recorded(spark, sf_dir), events)


RECORDING = (
    "site_id visitor_id started_at last_at chunks events pages clicks inputs errors gaps entry_path viewport country device session_id"
).split()


def replay_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay_table(spark, sf_dir).select(*RECORDING)


def replay_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = replay_table(spark, sf_dir).select("site_id", "replay_id", "started_at")
    kept, _ = recordings.purge(rows, rows.select("site_id", "replay_id"), replay_settings(spark, sf_dir), NOW)
    return kept.groupBy("site_id").agg(counting("kept"))


def purged_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10 on a stored table of its own: what is left of it, rows, chunks and days."""

    def write(path: str) -> DataFrame:
        recordings.store_chunks(sample.chunks(spark, sf_dir), path)
        recordings.purge_store(spark, path, f"{path}-staging", recorded(spark, sf_dir), replay_settings(spark, sf_dir), NOW)
        return recordings.read_chunks(spark, path)

    left = recordings.accepted(kept_table(spark, sf_dir, "purged_chunks", write))
    return left.groupBy("site_id").agg(counting("rows"), F.countDistinct("seq").alias("chunks"), F.countDistinct("day").alias("days"), F.min("day").alias("first_day"))


def replay_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = unsessioned(spark, sf_dir).select("site_id", "visitor_id", F.create_map(F.lit("dnt"), F.when(F.col("tag") == "v2", "0").otherwise("1")).alias("headers"))
    verdicts = replays.selected(asked, sample.request_sites(spark, sf_dir), replay_settings(spark, sf_dir))
    return verdicts.groupBy("site_id", "record", "reason").agg(counting("requests"))


def replay_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = replays.list_replays(
        replay_table(spark, sf_dir), replay_settings(spark, sf_dir), FULL, NOW, min_pages=1, errors_only=True, limit=200
    )
    return rows.select("site_id", "visitor_id", "name", "started_at", "errors")


def closer(rows: DataFrame) -> DataFrame:
    """The rows of a site's day as one visitor's, in half the time: recordings of many chunks, cut by limit and silence."""
    day = F.floor(F.col("ts") / DAY_MS).cast("long")
    return rows.withColumns({"visitor_id": F.concat(F.lit("day-"), day.cast("string")), "ts": day * DAY_MS + F.floor(F.col("ts") % DAY_MS / 2).cast("long")})


def close_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks that lie closer, with their recording, kept."""

    def write(path: str) -> DataFrame:
        facts = replays.chunk_facts(closer(landed_chunks(spark, sf_dir)))
        facts.write.parquet(f"{path}-facts")  # placing chunks in recordings reads them several times
        facts = spark.read.schema(facts.schema).parquet(f"{path}-facts")
        placed = replays.recorded_chunks(facts, replay_settings(spark, sf_dir), staging=f"{path}-steps")
        placed.write.parquet(path)
        return spark.read.schema(placed.schema).parquet(path)

    return kept_table(spark, sf_dir, "close_chunks", write)


def recorded_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of all recordings; those of refused chunks are in none."""
    placed = close_chunks(spark, sf_dir).select(*recordings.CHUNK_KEYS, "replay_id", "started_at")
    return closer(landed_chunks(spark, sf_dir)).join(placed, recordings.CHUNK_KEYS)


def heat(part: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = heatmap.heatmap(recorded_events(spark, sf_dir), points=8000, page_count=100)[part]
        return rows.select("site_id", "device", "path", "snap", "at") if part == "snapshot" else rows

    return run


def playback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replays.playback(recorded_events(spark, sf_dir)).select("site_id", "replay_id", "seq", "pos", "at", "type")


def markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = closer(event_table(spark, sf_dir).drop("day"))
    rows = replays.recordings(close_chunks(spark, sf_dir), events.select("site_id", "visitor_id", "ts", "session_id"))
    return replays.markers(recorded_events(spark, sf_dir), rows, events, limit=2000)


def change_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.change_lines(Scope(event_table(spark, sf_dir), LATE))


def claim_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E80 over every sentence of every document, each source measured by its documents' lengths."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text", "n_chars"))
    measured = docs.select("source", F.col("n_chars").cast("double").alias("value"))
    staging = f"{shared_folder(spark)}/footlog-{spark.sparkContext.applicationId}-{uuid.uuid4().hex[:8]}/sentences"
    rows = claims.check_claims(docs.select("doc_id", "source", "text"), measured, ["source", "doc_id"], ["source"], staging=staging)
    return rows.where("dropped").select("doc_id", "numbers", "causal")


def claim_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return claims.sentences(docs, ["doc_id"]).groupBy("doc_id").agg(counting("sentences"))


def intake_queries() -> dict[str, Query]:
    return {
        "a01_scan": scan,
        "a02_idempotent_append": idempotent,
        "a02_earliest": earliest,
        "a02_appended_table": appended,
        "a03_request_bodies": landed_files,
        "a04_batches": batches,
        "a05_import_summary": import_summary,
        "a05_imported_events": imported,
        "a05_split_csv": split_csv,
        "a06_remove_import": removed,
        "a06_removed_table": removed_table,
        "a08_backfill": backfilled,
        "a09_replay_landing": chunk_rows,
        "a09_refused_chunks": refused_chunks,
        "a10_replay_purge": replay_purge,
        "a10_purged_store": purged_store,
        "b01_rejected_rows": rejected_rows,
        "b03_revenue": revenue_outcomes,
        "b05_strict_policy": strict_policy,
        "b06_personal_words": personal_words,
        "b07_plans": lambda spark, sf_dir: enriched(spark, sf_dir)[0]
        .where("name = 'signup'")
        .groupBy(prop("plan").alias("plan"), prop("_plan_rejected").alias("reason"), prop("_pii_dropped").alias("dropped"))
        .agg(counting("events")),
        "b08_bots": counted("bot_kind", "bot_name"),
        "b09_clients": counted("device", "os", "browser"),
        "b10_signals": counted("bot_signals", "bot_score"),
        "b11_page_urls": page_urls,
        "b11_request_urls": counted("path", "query"),
        "b12_page_campaigns": page_campaigns,
        "b12_request_campaigns": counted("utm_source", "utm_medium", "utm_campaign"),
        "b14_page_channels": page_channels,
        "b14_request_channels": request_channels,
        "b16_places": counted("site_id", "country", "region", "region_name", "city", "lat", "lon"),
        "b17_ip_prefixes": ip_prefixes,
        "b18_ids": ids,
        "b22_trust": counted("bot_kind", "agent_trust", "agent_signer"),
        "b23_event_rows": event_rows,
        "b24_reject_reasons": reject_reasons,
        "b25_quality": quality,
        "c01_sessions": sessions,
        "c01_sessions_across_runs": session_runs,
        "c01_ingested_sessions": ingested,
        "c02_stream_sessions": stream_sessions,
        "c07_stream_visitors": stream_visitors,
        "c04_recordings": replay_rows,
        "c04_dense_recordings": dense_recordings,
        "c05_recording_selection": replay_selection,
        "e79_change_lines": change_lines,
        "e80_claim_check": claim_check,
        "e80_sentences": claim_counts,
        "f52_heatmap_points": heat("points"),
        "f53_scroll_reach": heat("reach"),
        "f54_heatmap_pages": heat("pages"),
        "f54_snapshots": heat("snapshot"),
        "f55_replay_list": replay_list,
        "f55_replay_total": lambda spark, sf_dir: replays.count_replays(
            replay_table(spark, sf_dir), replay_settings(spark, sf_dir), FULL, NOW, min_pages=1, errors_only=True
        ),
        "f54_truncation": lambda spark, sf_dir: heatmap.truncation(replay_table(spark, sf_dir), 300),
        "f56_playback": playback,
        "f57_markers": markers,
    }
