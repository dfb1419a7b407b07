"""The stored event table (A1, A2, A6, A8): parquet partitioned by site and UTC day."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from footlog.functions.values import day_of, prop
from footlog.model import COLUMN_DEFAULTS, EVENT_SCHEMA

PARTITIONS = ["site_id", "day"]


def with_day(events: DataFrame) -> DataFrame:
    return events.withColumn("day", F.date_from_unix_date(day_of().cast("int")))


def with_defaults(events: DataFrame) -> DataFrame:
    """Columns an older file lacks, or holds as null, take their defaults."""
    have = set(events.columns)
    columns = []
    for field in EVENT_SCHEMA:
        value = F.col(field.name) if field.name in have else F.lit(None)
        value = value.cast(field.dataType)
        if field.name in COLUMN_DEFAULTS:
            value = F.coalesce(value, F.lit(COLUMN_DEFAULTS[field.name]).cast(field.dataType))
        columns.append(value.alias(field.name))
    extra = [c for c in events.columns if c not in EVENT_SCHEMA.fieldNames()]
    return events.select(*columns, *extra)


def write_events(events: DataFrame, path: str, mode: str = "append") -> None:
    """Write events in the table's layout.

    Rebalancing groups rows of one site and day into few files and splits a site and day that is too
    large for one task; rows are sorted so that row-group statistics prune on visitor and time.
    """
    placed = with_day(events).hint("rebalance", *PARTITIONS)
    placed.sortWithinPartitions(*PARTITIONS, "visitor_id", "ts").write.mode(mode).partitionBy(*PARTITIONS).parquet(path)


def read_events(spark: SparkSession, path: str, merge: bool = False) -> DataFrame:
    """A1: scan the table; ``merge`` reads files of mixed ages and fills columns they lack."""
    if merge:
        return with_defaults(spark.read.option("mergeSchema", "true").parquet(path))
    return spark.read.schema(read_events_schema()).parquet(path)


def read_events_schema() -> T.StructType:
    stored = [f for f in EVENT_SCHEMA if f.name != "site_id"]
    return T.StructType([*stored, T.StructField("site_id", T.StringType()), T.StructField("day", T.DateType())])


def read_near(spark: SparkSession, path: str, arriving: DataFrame, days_around: int = 0) -> DataFrame:
    """The stored events of the sites and days that arrive; only their folders are listed, whatever the table holds.

    What is collected are the sites and days of one batch. The folders are named as one pattern of sites and days.
    """
    keys = with_day(arriving).select(*PARTITIONS).distinct().collect()
    days = sorted({k["day"] + dt.timedelta(days=n) for k in keys for n in range(-days_around, days_around + 1)})
    schema = read_events_schema()
    if not keys:
        return spark.createDataFrame([], schema)
    folders = f"site_id={{{','.join(sorted({_folder_name(k['site_id']) for k in keys}))}}}/day={{{','.join(map(str, days))}}}"
    try:
        return spark.read.schema(schema).option("basePath", path).parquet(f"{path.rstrip('/')}/{folders}")
    except AnalysisException as none:  # nothing is stored for these sites and days yet
        if none.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _folder_name(value: str | None) -> str:
    """A partition value as the writer spells it in a folder's name, with the commas and braces of a pattern escaped."""
    return re.sub(r"[,}]", r"\\\g<0>", _spelt("", value)[1:])


def _spelt(column: str, value: str | None) -> str:
    """The name of a partition's folder as the writer spells it."""
    # The characters the writer escapes.
    escaped = "\"#%'*/:=?\\\x7f{[]^"
    return f"{column}=" + ("".join(f"%{ord(c):02X}" if ord(c) < 0x20 or c in escaped else c for c in value) if value else "__HIVE_DEFAULT_PARTITION__")


def earliest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of the rows that share the keys the one that arrived first; ties by time, then by content."""
    first = F.min_by(F.struct("*"), F.struct("ingest_seq", "ts", F.xxhash64("*")))
    return rows.groupBy(*keys).agg(first.alias("_first")).select("_first.*")


def new_events(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """A2: incoming events whose id is not stored yet, each id once (the earliest arrival)."""
    once = earliest(incoming, ["id"])
    return once.join(existing.select("id"), "id", "left_anti")


def append_events(
    incoming: DataFrame, path: str, sessions: str | None = None, batch: str | None = None, people: str | None = None,
    distincts: str | None = None, vitals: str | None = None,
) -> None:
    """A2: idempotent append. Stored ids are looked up only on the sites and days that arrive.

    With ``sessions``, the folder of the side table, or ``people``, that of the ledger, these are kept up too: first, under the
    append's name ``batch``, so that an append run again under that name after a failure counts once. So are the day bitmaps
    in the folder ``distincts`` and the value counts in ``vitals``.
    """
    spark = incoming.sparkSession
    fresh = new_events(incoming, read_near(spark, path, incoming))
    if sessions is not None:
        from footlog.sources.session_days import session_days, write_session_days

        write_session_days(session_days(fresh, batch), sessions)
    if people is not None:
        from footlog.sources.people_days import people_days, write_people_days

        write_people_days(people_days(fresh, batch), people)
    if distincts is not None:
        from footlog.sources.distinct_days import append_distinct_days

        append_distinct_days(fresh, distincts)
    if vitals is not None:
        from footlog.sources.vital_days import vital_days, write_vital_days

        write_vital_days(vital_days(fresh, batch), vitals)
    write_events(fresh, path)


def without_batch(events: DataFrame, site: str, batch: str) -> DataFrame:
    """The table without one imported batch of one site."""
    own = (F.col("site_id") == site) & F.coalesce(prop("_import") == batch, F.lit(False))
    return events.where(~own)


def count_batch(events: DataFrame, site: str, batch: str) -> DataFrame:
    """How many stored events one imported batch holds."""
    return events.where((F.col("site_id") == site) & (prop("_import") == batch)).agg(F.count(F.lit(1)).alias("removed"))


def remove_batch(
    spark: SparkSession, path: str, staging: str, site: str, batch: str, sessions: str | None = None, people: str | None = None,
    distincts: str | None = None, vitals: str | None = None,
) -> int:
    """Delete one batch by rewriting only the partitions that hold it; returns the rows removed.

    Kept rows go to ``staging`` (a shared folder) first, since a partition cannot be read while it is replaced. The side
    table in the folder ``sessions``, the ledger in ``people``, the bitmaps in ``distincts`` and the value counts in ``vitals``,
    if named, are rebuilt for the same days.
    """
    events = read_events(spark, path)
    removed = count_batch(events, site, batch).first()["removed"]
    if not removed:
        return 0
    mine = events.where((F.col("site_id") == site) & (prop("_import") == batch))
    days = [r["day"] for r in mine.select("day").distinct().collect()]  # bounded by the days of one import
    touched = events.where((F.col("site_id") == site) & F.col("day").isin(days))
    kept = without_batch(touched, site, batch)
    kept.write.mode("overwrite").partitionBy(*PARTITIONS).parquet(staging)
    schema = events.schema
    spark.read.schema(schema).parquet(staging).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy(*PARTITIONS).parquet(path)
    emptied = {d for d in days} - {r["day"] for r in spark.read.schema(schema).parquet(staging).select("day").distinct().collect()}
    drop_partitions(spark, path, {(site, day) for day in emptied})
    if sessions is not None:
        from footlog.sources.session_days import rebuild

        rebuild(read_events(spark, path), sessions, site, days)
    if people is not None:
        from footlog.sources import people_days

        people_days.rebuild(read_events(spark, path), people, site, days)
    if distincts is not None:
        from footlog.sources import distinct_days

        distinct_days.rebuild(read_events(spark, path), distincts, site, days)
    if vitals is not None:
        from footlog.sources import vital_days

        vital_days.rebuild(read_events(spark, path), vitals, site, days)
    return removed


def drop_partitions(spark: SparkSession, path: str, parts: set[tuple]) -> None:
    """Remove whole partitions, given as (site, day), with the JVM's file system; not to be had on Spark Connect."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for site, day in parts:
        folder = hadoop.Path(hadoop.Path(path), f"{_spelt('site_id', site)}/day={day}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
