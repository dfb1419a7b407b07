"""Session settings the operators are designed for."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# AQE re-plans partition counts, join strategies and skewed joins from measured sizes.
# Joins are broadcast only when Spark's own size check passes (autoBroadcastJoinThreshold).
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # Generated methods beyond this size are not compiled by the JVM; Spark then splits the stage instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # A repeated key in a request body keeps its last value, as JSON parsers do.
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the recommended runtime settings to an existing session."""
    for key, value in RECOMMENDED.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", app: str = "footlog", memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
    )
    for key, value in RECOMMENDED.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for a job's stored steps, in the folder the cluster names in spark.checkpoint.dir.

    Where that is unset only a local session gets a temporary folder; a cluster's executors would not see each other's.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="footlog-")
    return f"{named.rstrip('/')}/{name}-{uuid.uuid4().hex}"
