"""Request bodies as they land (A3, A4): files or a stream of JSON lines, single events or batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footlog.functions.stages import dropped, staged
from footlog.plans.enrich import RAW_SCHEMA

BATCH_MAX = 50


def _ordered(raw: DataFrame) -> DataFrame:
    """Requests without an arrival number get one that stays the same when the job is run again."""
    return raw.withColumn("ingest_seq", F.coalesce("ingest_seq", F.xxhash64("request_id")))


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """A3: landed requests; ``body`` may be JSON text or a JSON object."""
    return _ordered(spark.read.schema(RAW_SCHEMA).json(path))


def stream_requests(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """A3: the same as a stream over arriving files."""
    return _ordered(spark.readStream.schema(RAW_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(path))


def open_batches(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A4: bodies ``{"events": [...]}`` as one request per event, and refused batches with their reason.

    A batch holds 1 to 50 events of one site; each event is checked on its own later, and keeps its place
    in the batch as the last part of its request id.
    """
    read = staged(
        raw,
        {"_v": "try_parse_json(body)"},
        {
            "_root": "schema_of_variant(_v)",
            "_kind": "schema_of_variant(try_variant_get(_v, '$.events', 'variant'))",
            "_events": "try_variant_get(_v, '$.events', 'array<variant>')",
            "_texts": "from_json(get_json_object(body, '$.events'), 'array<string>')",
        },
        {
            "_sites": """transform(_events, e -> CASE WHEN schema_of_variant(try_variant_get(e, '$.site', 'variant')) = 'STRING'
              THEN try_variant_get(e, '$.site', 'string') END)"""
        },
        {
            "reject_reason": f"""CASE WHEN NOT coalesce(_root LIKE 'OBJECT%', false) THEN 'body_not_object'
              WHEN NOT coalesce(_kind LIKE 'ARRAY%', false) OR size(_events) = 0 THEN 'events_missing'
              WHEN size(_events) > {BATCH_MAX} THEN 'batch_too_large'
              WHEN coalesce(_sites[0], '') = '' THEN 'site_missing'
              WHEN exists(_sites, s -> NOT coalesce(s = _sites[0], false)) THEN 'batch_mixed_sites' END"""
        },
    )
    refused = read.where("reject_reason IS NOT NULL").select("request_id", "received_at", "reject_reason")
    each = read.where("reject_reason IS NULL").select("*", F.posexplode("_texts").alias("batch_index", "_body"))
    single = each.withColumns(
        {
            "request_id": F.concat_ws("#", "request_id", "batch_index"),
            "ingest_seq": F.col("ingest_seq") * BATCH_MAX + F.col("batch_index"),
            "body": F.col("_body"),
        }
    )
    return dropped(single).drop("reject_reason", "batch_index"), refused


def batch_answers(raw: DataFrame, refused: DataFrame) -> DataFrame:
    """A4: per batch how many events were accepted, from the opened batch and its refused events."""
    place = F.substring_index("request_id", "#", -1).cast("int")
    bad = refused.select("request_id", F.struct(place.alias("index"), F.col("reject_reason").alias("reason")).alias("bad"))
    joined = raw.select("request_id").join(bad, "request_id", "left")
    batch = F.expr("substring_index(request_id, '#', size(split(request_id, '#')) - 1)")
    # A batch holds at most 50 events, so the list of its refusals is short.
    return joined.groupBy(batch.alias("batch_id")).agg(
        F.sum(F.when(F.col("bad").isNull(), 1).otherwise(0)).cast("long").alias("accepted"),
        F.sort_array(F.collect_list("bad")).alias("rejected"),
    )
