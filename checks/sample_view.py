"""The event table read out of the driver's tables: the same expressions for Spark and for the checks' SQL."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footlog.model import EVENT_SCHEMA
from footlog.operators.ordered import sessionize
from footlog.sources.event_table import append_events, read_events, with_defaults, write_events
from footlog.sources import distinct_days
from footlog.sources.distinct_days import DistinctDays
from footlog.sources.people_days import Ledger, people_days, read_people_days, write_people_days
from footlog.sources.session_days import read_session_days, session_days, write_session_days
from footlog.sources.vital_days import read_vital_days, vital_days, write_vital_days

GAP_MS = 21_600_000
MS_SPARK = "unix_millis(to_timestamp_ltz(concat(cast(ts as string), 'Z')))"
MS_DUCKDB = "epoch_us(ts) // 1000"

# The test view's column expressions.
COLUMNS_SQL = """
with raw as (
  select event_id, user_id, event_type, value, ts as ts_src, {MS} as ts,
         cast(replace(replace(props, '{"k": ', ''), '}', '') as int) as k
  from {EVENTS}
),
b as (
  select *, 's' || cast(user_id % 3 as string) as site_id,
         cast(floor(ts / 86400000) as bigint) as day,
         case event_type
           when 'view' then 'pageview'
           when 'click' then case k % 5 when 0 then 'web_vitals' when 1 then 'scroll' when 2 then 'outbound_click' when 3 then 'cta_click' else 'form_abandon' end
           when 'signup' then case k % 4 when 0 then 'plan' when 1 then 'login' when 2 then 'identify' else 'signup' end
           when 'error' then case when k % 7 = 0 then 'rage_click' else 'error' end
           else case when k % 6 = 0 then 'file_download' else 'purchase' end
         end as name
  from raw
),
c as (
  select cast(event_id as string) as id, event_id as ingest_seq, site_id, ts,
    md5('v|' || cast(day as string) || '|' || site_id || '|' || cast(user_id as string)) as visitor_id,
    case when k % 7 = 0 then '' else md5('i|' || site_id || '|' || cast(user_id as string) || '|' || cast(k % 10 as string)) end as identity,
    case when event_type = 'view' then 'pageview' else 'event' end as type, name,
    case when k % 8 = 0 then '/' else '/p/' || cast(k % 8 as string) end as path,
    case when k % 9 = 0 then '?utm_source=feed' else '' end as query,
    case when event_type = 'view' then 'Page ' || cast(k % 8 as string) else '' end as title,
    case when user_id % 7 = 0 then 'staging.example.com' else 'example.com' end as hostname,
    case k % 6 when 0 then '' when 1 then 'google.com' when 2 then 'chatgpt.com' when 3 then 'reddit.com' when 4 then 'blog.acme.dev' else 'mail.google.com' end as referrer_host,
    case k % 6 when 0 then 'direct' when 1 then 'search' when 2 then 'ai' when 3 then 'social' when 4 then 'referral' else 'email' end as channel,
    case k % 6 when 0 then '' when 1 then 'google' when 2 then 'chatgpt' when 3 then 'reddit' when 4 then 'blog.acme.dev' else 'gmail' end as source,
    case when k % 9 = 0 then 'feed' else '' end as utm_source,
    case when k % 9 = 0 then 'email' else '' end as utm_medium,
    case when k % 9 = 0 then 'c' || cast(k % 2 as string) else '' end as utm_campaign,
    case when k % 27 = 0 then 'shoes' else '' end as utm_term, case when k % 18 = 0 then 'top' else '' end as utm_content,
    case user_id % 3 when 0 then 'desktop' when 1 then 'mobile' else 'tablet' end as device,
    case user_id % 4 when 0 then 'Windows' when 1 then 'iOS' when 2 then 'macOS' else 'Android' end as os,
    case user_id % 5 when 0 then 'Chrome' when 1 then 'Safari' when 2 then 'Firefox' when 3 then 'iOS app' else 'Android app' end as browser,
    case when user_id % 6 = 0 then '' else cast(1000 + user_id % 6 * 100 as string) || 'x800' end as screen,
    case user_id % 4 when 0 then 'en-us' when 1 then 'de' when 2 then 'tr' else '' end as lang,
    case user_id % 5 when 0 then 'DE' when 1 then 'US' when 2 then 'TR' when 3 then 'FR' else '' end as country,
    case user_id % 5 when 0 then 'DE-BE' when 1 then 'US-TX' when 2 then 'TR-34' else '' end as region,
    case user_id % 5 when 0 then 'Berlin' when 1 then 'Texas' when 2 then 'Istanbul' else '' end as region_name,
    case user_id % 5 when 0 then 'Berlin' when 1 then 'Austin' when 2 then 'Istanbul' else '' end as city,
    case user_id % 5 when 0 then cast(52.5 as double) when 1 then cast(30.3 as double) when 2 then cast(41.0 as double) end as lat,
    case user_id % 5 when 0 then cast(13.4 as double) when 1 then cast(-97.7 as double) when 2 then cast(29.0 as double) end as lon,
    case when k % 2 = 0 then 'v2' else '' end as tag,
    case when k % 20 = 7 then 'ai-crawler' else '' end as bot_kind,
    case when k % 40 = 7 then 'GPTBot' when k % 40 = 27 then 'ClaudeBot' else '' end as bot_name,
    case when k % 20 = 7 then 'claimed' when k % 25 = 3 then 'verified' else 'human' end as agent_trust,
    case when k % 20 <> 7 and k % 25 = 3 then 'https://agent' || cast(k % 2 as string) || '.example' else '' end as agent_signer,
    case when k % 10 = 9 then 'no-accept-language,no-fetch-metadata' else '' end as bot_signals,
    case when k % 10 = 9 then 6 else 0 end as bot_score,
    case name
      when 'purchase' then case when k % 13 = 0 then '{"_revenue_rejected":"currency_missing"}' else '{"revenue":' || cast(value as string) || ',"currency":"' || case when user_id % 2 = 0 then 'USD' else 'EUR' end || '"}' end
      when 'plan' then '{"plan":"' || case k % 3 when 0 then 'free' when 1 then 'pro' else 'team' end || '"}'
      when 'web_vitals' then '{"lcp":' || cast(1000 + k * 37 as string) || case when k % 10 = 0 then '' else ',"inp":' || cast(40 + k as string) end || ',"cls":0.' || cast(10 + k % 90 as string) || ',"fcp":' || cast(500 + k * 11 as string) || '}'
      when 'error' then '{"message":"E' || cast(k % 5 as string) || '","source":"/a' || cast(k % 3 as string) || '.js","line":' || cast(k % 4 as string) || '}'
      when 'scroll' then '{"percent":' || cast(k as string) || '}'
      when 'outbound_click' then '{"host":"h' || cast(k % 4 as string) || '.example"}'
      when 'form_abandon' then '{"field":"f' || cast(k % 3 as string) || '"}'
      when 'file_download' then '{"file":"/d' || cast(k % 4 as string) || '.pdf"}'
      when 'identify' then '{"tier":"t' || cast(k % 3 as string) || '","_signal":"none"}'
      else '{}' end as props
  from b
)
"""

SESSIONS_SQL = """,
g as (
  select *, case when lag(ts) over (partition by site_id, visitor_id order by ts, ingest_seq) is null
              or ts - lag(ts) over (partition by site_id, visitor_id order by ts, ingest_seq) > {GAP} then 1 else 0 end as is_new
  from c
)
select g.*, visitor_id || '-' || cast(sum(is_new) over (partition by site_id, visitor_id order by ts, ingest_seq
         rows between unbounded preceding and current row) as string) as session_id
from g
"""


def duckdb_view(events: str = "events", gap_ms: int = GAP_MS) -> str:
    """The view as one SQL text for the checks."""
    text = COLUMNS_SQL + SESSIONS_SQL
    return text.replace("{MS}", MS_DUCKDB).replace("{EVENTS}", events).replace("{GAP}", str(gap_ms))


def spread(rows: DataFrame) -> DataFrame:
    """Deal rows out by their first column, so that the costly parsing after it does not follow the files' sizes."""
    return rows.repartition(F.col(rows.columns[0]))


def unsessioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view without sessions."""
    name = "sample_events_" + "".join(ch if ch.isalnum() else "_" for ch in sf_dir)
    spark.read.parquet(f"{sf_dir}/events.parquet").createOrReplaceTempView(name)
    return spark.sql(COLUMNS_SQL.replace("{MS}", MS_SPARK).replace("{EVENTS}", name) + "select * from c")


def sessioned(spark: SparkSession, sf_dir: str, gap_ms: int = GAP_MS) -> DataFrame:
    """The view with sessions assigned by the library."""
    placed = sessionize(unsessioned(spark, sf_dir), ["site_id", "visitor_id"], gap_ms)
    named = F.concat("visitor_id", F.lit("-"), F.col("session_no").cast("string"))
    return placed.withColumn("session_id", named).drop("session_no", "session_start")


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; one of our own only where that is unset, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="footlog-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


_tables: dict[tuple[str, str], DataFrame] = {}
_ledgers: dict[tuple[str, str], Ledger] = {}
_distincts: dict[tuple[str, str], DistinctDays] = {}


def event_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's events as a stored event table, written once per application in the library's layout.

    Every metric then reads what it would read in production: a partitioned, pruned, pushed-down scan.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _tables:
        path = f"{shared_folder(spark)}/footlog-{key[0]}-{uuid.uuid4().hex[:8]}/events"
        write_events(with_defaults(sessioned(spark, sf_dir)).select(*EVENT_SCHEMA.fieldNames()), path)
        _tables[key] = read_events(spark, path)
    return _tables[key]


def session_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The side table of session days of ``event_table``, written once per application."""
    key = (spark.sparkContext.applicationId, f"{sf_dir}#sessions")
    if key not in _tables:
        path = f"{shared_folder(spark)}/footlog-{key[0]}-{uuid.uuid4().hex[:8]}/sessions"
        write_session_days(session_days(event_table(spark, sf_dir)), path)
        _tables[key] = read_session_days(spark, path)
    return _tables[key]


def people_table(spark: SparkSession, sf_dir: str) -> Ledger:
    """The ledger of people of ``event_table``, written once per application in two appends, the second of them twice."""
    key = (spark.sparkContext.applicationId, f"{sf_dir}#people")
    if key not in _ledgers:
        path = f"{shared_folder(spark)}/footlog-{key[0]}-{uuid.uuid4().hex[:8]}/people"
        for part in (0, 1, 1):
            write_people_days(people_days(event_table(spark, sf_dir).where(F.col("ingest_seq") % 2 == part), f"part{part}"), path)
        _ledgers[key] = read_people_days(spark, path)
    return _ledgers[key]


def distinct_table(spark: SparkSession, sf_dir: str) -> DistinctDays:
    """The dictionary and day bitmaps of ``event_table``, written once per application in two appends, the second of them twice."""
    key = (spark.sparkContext.applicationId, f"{sf_dir}#distincts")
    if key not in _distincts:
        path = f"{shared_folder(spark)}/footlog-{key[0]}-{uuid.uuid4().hex[:8]}/distincts"
        distinct_days.create(spark, path)
        for part in (0, 1, 1):
            distinct_days.append_distinct_days(event_table(spark, sf_dir).where(F.col("ingest_seq") % 2 == part), path)
        _distincts[key] = distinct_days.read_distinct_days(spark, path)
    return _distincts[key]


def vital_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value counts of vitals of ``event_table``, written once per application in two appends, the second of them twice."""
    key = (spark.sparkContext.applicationId, f"{sf_dir}#vitals")
    if key not in _tables:
        path = f"{shared_folder(spark)}/footlog-{key[0]}-{uuid.uuid4().hex[:8]}/vitals"
        for part in (0, 1, 1):
            write_vital_days(vital_days(event_table(spark, sf_dir).where(F.col("ingest_seq") % 2 == part), f"part{part}"), path)
        _tables[key] = read_vital_days(spark, path)
    return _tables[key]


#: Visits that go on for up to three days: the same events under other session ids.
LONG_VISIT = "concat(case when identity <> '' then identity else visitor_id end, '-', cast(cast(floor(ts / 259200000) as bigint) as string))"


def long_visits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """An event table and its side table whose sessions last longer than a day, appended in two parts."""
    key = (spark.sparkContext.applicationId, f"{sf_dir}#long")
    folder = f"{shared_folder(spark)}/footlog-{key[0]}-{uuid.uuid4().hex[:8]}"
    if key not in _tables:
        renamed = event_table(spark, sf_dir).withColumn("session_id", F.expr(LONG_VISIT)).drop("day")
        write_events(renamed.limit(0), f"{folder}/long-events")
        for part in (0, 1):
            append_events(renamed.where(F.col("ingest_seq") % 2 == part), f"{folder}/long-events", f"{folder}/long-sessions")
        _tables[key] = read_events(spark, f"{folder}/long-events")
        _tables[key[0], f"{sf_dir}#long-sessions"] = read_session_days(spark, f"{folder}/long-sessions")
    return _tables[key], _tables[key[0], f"{sf_dir}#long-sessions"]
