"""History exported by Umami as CSV (A5): visits become sessions, sessions become visitors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footlog.functions import channels, urls
from footlog.functions.identity import short_hash
from footlog.functions.stages import quoted, staged
from footlog.model import EVENT_SCHEMA
from footlog.sources.event_table import earliest, with_defaults
from footlog.sources.split_csv import read_csv

REQUIRED = ["event_id", "session_id", "created_at", "url_path", "event_type"]
READ = (
    "event_id session_id visit_id created_at url_path url_query referrer_domain referrer_path referrer_query page_title "
    "hostname event_type event_name browser os device screen language country region city utm_source utm_medium "
    "utm_campaign utm_content utm_term tag"
).split()
# Browser names of the export and ours.
BROWSERS = {
    "chrome": "Chrome", "chromium-webview": "Chrome", "crios": "Chrome", "edge-chromium": "Edge", "edge": "Edge",
    "edge-ios": "Edge", "firefox": "Firefox", "fxios": "Firefox", "safari": "Safari", "ios": "Safari",
    "ios-webview": "Safari", "opera": "Opera", "samsung": "Samsung Internet", "brave": "Brave", "vivaldi": "Vivaldi",
    "yandexbrowser": "Yandex", "facebook": "Facebook",
}


class ExportError(ValueError):
    """A file that is not such an export; nothing is written."""


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """The CSV with every column as text; quoted fields may hold commas, doubled quotes and newlines. A file is read by as
    many tasks as it has byte ranges."""
    return read_csv(spark, path)


def _checked(rows: DataFrame) -> DataFrame:
    named = {c.strip().lower(): c for c in rows.columns}
    missing = [c for c in REQUIRED if c not in named]
    if missing:
        plural = "s" if len(missing) > 1 else ""
        raise ExportError(f"this does not look like an export: missing column{plural} {', '.join(missing)}")
    return rows.select(
        *[(F.coalesce(F.trim(F.col(f"`{named[c]}`")), F.lit("")) if c in named else F.lit("")).alias(f"i_{c}") for c in READ]
    )


_TS = r"r'^(\d{4}-\d{2}-\d{2})[ T](\d{2}:\d{2}:\d{2})(?:\.(\d{1,6}))?(Z|[+-]\d{2}:?\d{2})?$'"


def _ts(group: int) -> str:
    return f"regexp_extract(i_created_at, {_TS}, {group})"


def mapped(rows: DataFrame, site: str, self_host: str, batch: str, stop_at: int | None = None) -> DataFrame:
    """Every row of the export as an event, with ``skip_reason`` null for the rows to keep.

    The number of rows has no limit here: the file is read in parts.
    """
    stop = "false" if stop_at is None else f"ts >= {stop_at}"
    browsers = ", ".join(f"{quoted(k)}, {quoted(v)}" for k, v in BROWSERS.items())
    stages = (
        {
            "_zone": rf"coalesce(nullif(regexp_replace({_ts(4)}, r'^([+-]\d{{2}})(\d{{2}})$', '$1:$2'), ''), 'Z')",
            "_frac": f"rpad(substring({_ts(3)}, 1, 3), 3, '0')",
            "query": r"regexp_replace(i_url_query, r'^\?', '')",
            "_os": "lower(i_os)",
            "_browser": "lower(i_browser)",
            "_device": "lower(i_device)",
            "_cc": "substring(upper(i_country), 1, 2)",
        },
        {
            "ts": f"unix_millis(try_cast(CASE WHEN {_ts(1)} <> '' THEN concat({_ts(1)}, 'T', {_ts(2)}, '.', _frac, _zone) END as timestamp))",
            "type": "CASE i_event_type WHEN '2' THEN 'event' WHEN '1' THEN 'pageview' END",
            "referrer": r"""CASE WHEN i_referrer_domain = '' THEN '' ELSE concat('https://', i_referrer_domain,
              CASE WHEN i_referrer_path = '' THEN '/' ELSE i_referrer_path END,
              CASE WHEN i_referrer_query = '' THEN '' ELSE concat('?', regexp_replace(i_referrer_query, r'^\?', '')) END) END""",
        },
        *urls.UTM,
        {f"utm_{p}": f"coalesce(nullif(lower(i_utm_{p}), ''), utm_{p})" for p in ("source", "medium", "campaign", "term", "content")},
        *urls.REFERRER_HOST,
        {"_own_host": quoted(self_host)},
        *channels.CLASSIFY,
        {
            "skip_reason": f"""CASE WHEN ts IS NULL THEN 'bad_timestamp' WHEN {stop} THEN 'overlaps_collected_data'
              WHEN i_event_id = '' OR i_session_id = '' THEN 'missing_id' WHEN type IS NULL THEN 'unknown_event_type'
              WHEN type = 'event' AND i_event_name = '' THEN 'event_without_name' END""",
            "name": "CASE WHEN type = 'event' THEN substring(i_event_name, 1, 80) ELSE 'pageview' END",
            "id": "concat('umami:', i_event_id)",
            "site_id": quoted(site),
            "visitor_id": short_hash(f"concat('umami-visitor:', {quoted(site)}, ':', i_session_id)"),
            "session_id": "concat('umami-', "
            + short_hash(f"concat('umami-visit:', {quoted(site)}, ':', coalesce(nullif(i_visit_id, ''), i_session_id))")
            + ")",
            "path": "substring(CASE WHEN i_url_path = '' THEN '/' ELSE i_url_path END, 1, 500)",
            "query": "substring(query, 1, 500)",
            "title": "substring(i_page_title, 1, 300)",
            "hostname": "substring(lower(i_hostname), 1, 200)",
            "referrer": "substring(referrer, 1, 500)",
            "channel": "_verdict.channel",
            "source": "_verdict.source",
            "device": """CASE WHEN _device IN ('mobile', 'tablet', 'desktop') THEN _device WHEN _device = 'laptop' THEN 'desktop'
              ELSE 'unknown' END""",
            "os": """CASE WHEN _os = '' THEN 'unknown' WHEN startswith(_os, 'mac') THEN 'macOS' WHEN startswith(_os, 'windows') THEN 'Windows'
              WHEN _os = 'ios' THEN 'iOS' WHEN startswith(_os, 'android') THEN 'Android'
              WHEN contains(_os, 'chrome os') OR _os = 'chromeos' THEN 'ChromeOS'
              WHEN contains(_os, 'linux') OR contains(_os, 'ubuntu') THEN 'Linux' ELSE i_os END""",
            "browser": f"""CASE WHEN _browser = '' THEN 'unknown'
              ELSE coalesce(try_element_at(map({browsers}), _browser), concat(upper(substring(_browser, 1, 1)), substring(_browser, 2))) END""",
            "screen": "substring(i_screen, 1, 20)",
            "lang": "substring(lower(i_language), 1, 20)",
            "country": "CASE WHEN _cc rlike '^[A-Z]{2}$' THEN _cc ELSE '' END",
            "region": """CASE WHEN _cc = '' OR i_region = '' THEN ''
              ELSE substring(upper(CASE WHEN contains(i_region, '-') THEN i_region ELSE concat(_cc, '-', i_region) END), 1, 10) END""",
            "city": "CASE WHEN _cc <> '' THEN substring(i_city, 1, 80) ELSE '' END",
            "tag": "substring(i_tag, 1, 60)",
            "props": f"to_json(named_struct('_import', {quoted(batch)}))",
            "ingest_seq": "xxhash64(i_event_id)",
        },
    )
    out = staged(_checked(rows), *stages)
    kept = [c for c in EVENT_SCHEMA.fieldNames() if c in out.columns]
    return out.select(*kept, "skip_reason")


def importable(flagged: DataFrame, existing: DataFrame) -> DataFrame:
    """The events to append: kept rows, each id once, not stored yet."""
    kept = earliest(flagged.where("skip_reason IS NULL").drop("skip_reason"), ["id"])
    return with_defaults(kept.join(existing.select("id"), "id", "left_anti")).select(*EVENT_SCHEMA.fieldNames())


def summary(flagged: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows by outcome, with the time range of what is imported; a repeated or stored id is ``already_imported``."""
    stored = existing.select("id").distinct().withColumn("_stored", F.lit(True))
    # One pass: skipped rows fold to their reason, the others to their id.
    kept = F.col("skip_reason").isNull()
    ids = flagged.groupBy("skip_reason", F.when(kept, F.col("id")).alias("id")).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("ts"))
    fresh = F.col("_stored").isNull()
    judged = ids.join(stored, "id", "left").select(
        F.explode(
            F.when(
                ~kept,
                F.array(F.struct(F.col("skip_reason").alias("outcome"), F.col("n").cast("int").alias("rows"), F.lit(None).cast("long").alias("ts"))),
            ).otherwise(F.array(
                F.struct(F.lit("imported").alias("outcome"), F.when(fresh, 1).otherwise(0).alias("rows"), F.when(fresh, F.col("ts")).alias("ts")),
                F.struct(
                    F.lit("already_imported").alias("outcome"),
                    (F.col("n") - F.when(fresh, 1).otherwise(0)).cast("int").alias("rows"),
                    F.lit(None).cast("long").alias("ts"),
                ),
            ))
        ).alias("o")
    ).select("o.*")
    counted = judged.groupBy("outcome").agg(
        F.sum("rows").cast("long").alias("rows"), F.min("ts").alias("from_ts"), F.max("ts").alias("to_ts")
    )
    return counted.where(F.col("rows") > 0)
