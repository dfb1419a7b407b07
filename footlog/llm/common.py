"""Small helpers the corpus operators share: staged tables, ASCII words, bounded memos, output batches."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The ASCII white space of all word rules here: U+0020 and U+0009 to U+000D, which is what bytes.split() splits on.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Texts longer than this many bytes are read in blocks, so that a word list stays small.
BLOCK = 1 << 22


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; where that is unset, a temporary one for a local session only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='footlog-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def staged(frame: DataFrame, name: str) -> DataFrame:
    """Write a frame once to the shared folder and read it back: its lineage is cut, lost executors cost nothing."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def most_frequent(counts: DataFrame, kind: str | None, most: int) -> DataFrame:
    """Of each kind the items with the highest counts n, at most ``most``: a histogram of the counts gives the cut."""
    step = F.floor(F.log2("n") * 8)  # some hundreds of steps at any size
    of = F.col(kind) if kind else F.lit("")
    steps = counts.groupBy(of.alias("__kind"), step.alias("__step")).agg(F.count(F.lit(1)).alias("items"))
    running = F.sum("items").over(Window.partitionBy("__kind").orderBy(F.desc("__step")))
    cut = steps.withColumn("running", running).where(F.col("running") <= most).groupBy("__kind").agg(F.min("__step").alias("__cut"))
    return counts.join(cut, of.eqNullSafe(F.col("__kind"))).where(step >= F.col("__cut")).drop("__kind", "__cut")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _UPPER.lower())


def in_fold(key: Column, remainder: int) -> Column:
    """True where crc32 of the key as text, modulo 5, is the remainder; false for a null key."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == remainder, F.lit(False))


def word_blocks(raw: bytes) -> Iterator[list[bytes]]:
    """The white-space separated words of UTF-8 bytes, a bounded list at a time; a word is never cut."""
    if len(raw) <= BLOCK:
        yield raw.split()
        return
    start = 0
    while start < len(raw):
        cut = re.compile(rb"[\x20\x09-\x0D]").search(raw, min(start + BLOCK, len(raw)))
        end = cut.start() if cut else len(raw)
        yield raw[start:end].split()
        start = end + 1


class Memo(dict):
    """A cache of a pure function in two generations: what is used again outlives a full one, so memory is bounded."""

    def __init__(self, function, most: int = 300_000, longest: int = 64):
        super().__init__()
        self.function, self.most, self.longest, self.old = function, most, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.function(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


def row_slices(batch: pa.RecordBatch, column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """A batch cut into slices of bounded text (bytes) or lists (items), so that what is made of them stays bounded too."""
    sizes, start, total = batch.column(column), 0, 0
    lengths = (pc.list_value_length if pa.types.is_nested(sizes.type) else pc.binary_length)(sizes).to_pylist()
    for i, size in enumerate(lengths):
        if total and total + (size or 0) > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size or 0
    if start < batch.num_rows:
        yield batch.slice(start)
