"""Recordings (A9, A10): chunks of browser events as rows, and their retention."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footlog.model import DAY_MS
from footlog.sources.event_table import PARTITIONS, drop_partitions

# Event codes of the recorder's wire format and its limits.
SNAPSHOT, MUTATION, MOVE, CLICK, SCROLL, VIEWPORT, INPUT, NAVIGATION, ERROR, GAP = range(10)
MAX_BODY = 1_000_000
MAX_DECODED = 4_000_000
MAX_EVENTS = 20_000
RETENTION_DAYS = 30

# A chunk as it lands; ``gzip`` tells whether its body is compressed.
CHUNK_SCHEMA = (
    "site_id string, visitor_id string, page_load string, seq int, ts long, user_agent string, country string, "
    "gzip boolean, body binary"
)
CHUNK_KEYS = ["site_id", "visitor_id", "page_load", "seq"]
EVENT_ROWS = (
    "site_id string, visitor_id string, page_load string, seq int, ts long, user_agent string, country string, bytes long, "
    "pos int, t long, type int, args array<string>, refused string"
)


def _decoded(body: bytes, gzip: bool) -> str | None:
    """The chunk's text; nothing when it is unreadable or grows past the limit."""
    if not gzip:
        return body.decode("utf-8", "replace")
    unpacker = zlib.decompressobj(wbits=31)
    try:
        data = unpacker.decompress(body, MAX_DECODED + 1)
    except zlib.error:
        return None
    return data.decode("utf-8", "replace") if unpacker.eof and len(data) <= MAX_DECODED else None


def _whole(value: object) -> int | None:
    if isinstance(value, bool) or not isinstance(value, int | float) or value != value or abs(value) == float("inf"):
        return None
    return value if isinstance(value, int) else int((value + 0.5) // 1)


def _numbers(event: list, count: int) -> list[str]:
    return [str((_whole(event[2 + i]) if len(event) > 2 + i else None) or 0) for i in range(count)]


def _cleaned(event: object) -> tuple[int, int, list[str]] | None:
    """One recorded event as (time, code, arguments); unknown codes are dropped, typed values masked."""
    if not isinstance(event, list) or len(event) < 2:
        return None
    t, code = _whole(event[0]), event[1]
    if t is None or t < 0 or isinstance(code, bool) or code not in range(10):
        return None
    first = event[2] if len(event) > 2 else None
    text_limits = {NAVIGATION: 500, ERROR: 200, GAP: 60}
    if code in text_limits:
        return (t, code, [first[: text_limits[code]]]) if isinstance(first, str) else None
    if code == SNAPSHOT:
        if not isinstance(first, list | dict):
            return None
        path = event[5] if len(event) > 5 and isinstance(event[5], str) else ""
        return t, code, [json.dumps(first, separators=(",", ":")), *_numbers(event[1:], 2), path[:500]]
    if code == MUTATION:
        return (t, code, [json.dumps(first, separators=(",", ":"))]) if isinstance(first, list) and first else None
    if code == INPUT:
        field = _whole(first)
        value = event[3] if len(event) > 3 else None
        if not field:
            return None
        if isinstance(value, bool):
            return t, code, [str(field), str(value).lower()]
        return t, code, [str(field), re.sub(r"\S", "*", "" if value is None else str(value)[:10_000])]
    return t, code, _numbers(event, 2 if code in (MOVE, VIEWPORT) else 3)


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [part.split()[0] for part in EVENT_ROWS.split(", ")]
    held: list[tuple] = []
    for batch in batches:
        for chunk in batch.itertuples(index=False):
            body = b"" if chunk.body is None else bytes(chunk.body)
            events = _opened(chunk, body)
            address = (chunk.site_id, chunk.visitor_id, chunk.page_load, None if pd.isna(chunk.seq) else int(chunk.seq))
            head = (*address, chunk.ts, chunk.user_agent, chunk.country, len(body))
            if isinstance(events, str):
                held.append((*head, None, None, None, None, events))
            else:
                held += [(*head, pos, *row, None) for pos, event in enumerate(events) if (row := _cleaned(event)) is not None]
            # Rows leave in blocks; a block is at most one chunk larger than this.
            if len(held) >= MAX_EVENTS:
                yield _framed(held, names)
                held = []
    if held:
        yield _framed(held, names)


def _framed(held: list[tuple], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame(held, columns=names).astype({"seq": "Int64", "pos": "Int64", "t": "Int64", "type": "Int64"})


def _opened(chunk: object, body: bytes) -> list | str:
    """The chunk's events, or the reason it is refused for."""
    if not (chunk.site_id and chunk.visitor_id and chunk.page_load) or pd.isna(chunk.seq) or chunk.seq < 0:
        return "invalid_chunk_address"
    if len(body) > MAX_BODY:
        return "chunk_too_large"
    text = _decoded(body, bool(chunk.gzip))
    if text is None:
        return "chunk_undecodable_or_too_large"
    try:
        events = json.loads(text)
    except ValueError:
        return "invalid_chunk"
    return events if isinstance(events, list) and len(events) <= MAX_EVENTS else "invalid_chunk"


def open_chunks(chunks: DataFrame) -> DataFrame:
    """One row per recorded event, and one with the reason in ``refused`` per refused chunk.

    The only Python step: decompression and JSON arrays of mixed types. Store its result and read that (``store_chunks``).
    """
    return chunks.mapInPandas(_rows, EVENT_ROWS)


def accepted(opened: DataFrame) -> DataFrame:
    return opened.where("refused IS NULL").drop("refused")


def refusals(opened: DataFrame) -> DataFrame:
    """Refused chunks by reason: nothing is dropped without a trace."""
    return opened.where("refused IS NOT NULL").groupBy("site_id", "refused").agg(F.count(F.lit(1)).alias("chunks"))


def land_chunks(chunks: DataFrame) -> DataFrame:
    """The recorded events of all readable chunks."""
    return accepted(open_chunks(chunks))


def store_chunks(chunks: DataFrame, path: str) -> DataFrame:
    """Chunks opened once into a stored table, by site and UTC day of arrival; every report reads it instead of opening
    them again. Rows of one site and day lie in few files, those too many for one task in several: chunks are dealt out as they
    come, before they are opened into many rows each."""
    day = F.date_from_unix_date(F.floor(F.col("ts") / DAY_MS).cast("int"))
    dealt = chunks.withColumn("day", day).hint("rebalance", *PARTITIONS).drop("day")
    open_chunks(dealt).withColumn("day", day).write.mode("append").partitionBy(*PARTITIONS).parquet(path)
    return read_chunks(chunks.sparkSession, path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    columns = EVENT_ROWS.removeprefix("site_id string, ")
    return spark.read.schema(f"{columns}, site_id string, day date").parquet(path)


def purge_store(spark: SparkSession, path: str, staging: str, placed: DataFrame, settings: DataFrame, now_ms: int) -> dict[str, int]:
    """A10: remove expired recordings from the stored table; returns the days dropped and rewritten, and rows removed there.

    A chunk is never older than the start of its recording, so what arrived before a site's cutoff is expired: days wholly
    before it are dropped unread. Recordings begun before the cutoff may go on after it; only the days on which they do, and the
    day of the cutoff, are rewritten. ``placed`` tells each chunk's ``ts`` and its recording's ``started_at``. Kept rows go to
    ``staging``, a folder all executors share, since a partition cannot be read while it is replaced.
    """
    stored = read_chunks(spark, path)
    own = settings.select("site_id", "retention_days")
    limit = F.lit(now_ms) - F.coalesce("retention_days", F.lit(RETENTION_DAYS)).cast("long") * DAY_MS
    day_ms = F.unix_date("day").cast("long") * DAY_MS
    # One row per partition of the table.
    parts = stored.select(*PARTITIONS).distinct().join(own, "site_id", "left").withColumn("cutoff", limit)
    old = {(r["site_id"], r["day"]) for r in parts.where(day_ms + DAY_MS <= F.col("cutoff")).collect()}
    edge = {(r["site_id"], r["day"]) for r in parts.where((day_ms < F.col("cutoff")) & (day_ms + DAY_MS > F.col("cutoff"))).collect()}
    gone = placed.join(own, "site_id", "left").withColumn("cutoff", limit).where((F.col("started_at") < F.col("cutoff")) & (F.col("ts") >= F.col("cutoff")))
    arrived = F.date_from_unix_date(F.floor(F.col("ts") / DAY_MS).cast("int")).alias("day")
    edge |= {(r["site_id"], r["day"]) for r in gone.select("site_id", arrived).distinct().collect()}
    if not edge:
        drop_partitions(spark, path, old)
        return {"dropped": len(old), "rewritten": 0, "removed": 0}
    touched = stored.where(F.concat_ws("|", F.col("day").cast("string"), "site_id").isin([f"{d}|{s}" for s, d in edge]))
    before = touched.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    late = touched.join(own, "site_id", "left").where(F.col("ts") >= limit).drop("retention_days")
    late.join(gone.select(*CHUNK_KEYS).distinct(), CHUNK_KEYS, "left_anti").write.mode("overwrite").partitionBy(*PARTITIONS).parquet(staging)
    kept = spark.read.schema(stored.schema).parquet(staging)
    # Nothing is removed before all that is read of the table, by ``placed`` too, has been read.
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITIONS).parquet(path)
    left = {(r["site_id"], r["day"]): r["n"] for r in kept.groupBy(*PARTITIONS).agg(F.count(F.lit(1)).alias("n")).collect()}
    drop_partitions(spark, path, old | (edge - set(left)))
    return {"dropped": len(old), "rewritten": len(edge), "removed": before - sum(left.values())}


def expired(recordings: DataFrame, settings: DataFrame, now_ms: int) -> DataFrame:
    """Recordings older than their site's retention (30 days where nothing was set)."""
    days = F.coalesce("retention_days", F.lit(RETENTION_DAYS)).cast("long")
    joined = recordings.join(settings.select("site_id", "retention_days"), "site_id", "left")
    return joined.where(F.col("started_at") < F.lit(now_ms) - days * DAY_MS).drop("retention_days")


def purge(recordings: DataFrame, events: DataFrame, settings: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """A10: the recordings and recorded events to keep."""
    days = F.coalesce("retention_days", F.lit(RETENTION_DAYS)).cast("long")
    joined = recordings.join(settings.select("site_id", "retention_days"), "site_id", "left")
    kept = joined.where(F.col("started_at") >= F.lit(now_ms) - days * DAY_MS).drop("retention_days")
    return kept, events.join(kept.select("site_id", "replay_id"), ["site_id", "replay_id"], "left_semi")


def without_recordings(rows: DataFrame, site: str, replay_id: str | None = None) -> DataFrame:
    """A10: recordings or their events without one recording, or without all of a site."""
    gone = F.col("site_id") == site
    return rows.where(~(gone if replay_id is None else gone & (F.col("replay_id") == replay_id)))
