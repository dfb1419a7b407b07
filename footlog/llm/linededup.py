"""Line dedup by winnowing over line hashes, in DataFrame operations only.

A window is the shortest run of lines, from a given line on (forward) or up to it (backward), that holds at least ``words``
words. The line with the smallest hash in a window is the window's fingerprint (ties: the last such line), so every run of
lines with that many words holds a fingerprint in each of its copies. Fingerprints are joined by hash; where one occurs at
more than one position, the windows it stands for are compared as a whole, with the earliest window of equal content, in
order of (doc_id, text hash, line). Consecutive forward windows extend a match towards its start and backward windows
towards its end; their union is the whole repeated run. All lines of later runs are deleted; the earliest copy stays.

A copy that overlaps the earliest one in the same text loses only the lines beyond it. A line without words weighs nothing;
it goes when it lies inside a deleted run. Lines are compared exactly, by 64-bit hashes of lines and windows.

Nulls: a null text stays null and takes no part; a null id sorts first. Rows with the same id and the same text count as
one document and get the same text; rows with the same id and different texts are different documents. Other columns are
kept; ``n_chars`` of the result is whatever the caller derives from the new text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from footlog.llm.common import NOT_SPACE, staged

#: Words a repeated run of lines has at least.
WORDS = 50
_KEY = ["doc_id", "text_hash"]


def lines(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, line, hash, words, start, stop): the lines with words, and the words before and up to them."""
    text = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.posexplode(F.split(text_col, "\n")).alias("line", "value"))
    counted = text.select(*_KEY, "line", F.xxhash64("value").alias("hash"), F.regexp_count("value", F.lit(NOT_SPACE)).alias("words")).where("words > 0")
    once = counted.repartition(*_KEY).groupBy(*_KEY, "line").agg(F.min("hash").alias("hash"), F.min("words").alias("words"))
    so_far = F.sum(F.col("words").cast("long")).over(Window.partitionBy(*_KEY).orderBy("line"))
    return once.withColumn("stop", so_far).withColumn("start", F.col("stop") - F.col("words"))


def windows(found: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, text_hash, first, last, content, mark): the windows of at least so many words, each with its fingerprint's hash."""
    doc = Window.partitionBy(*_KEY)
    # A line belongs to the forward window of a line while fewer than ``words`` words lie before it in the window.
    forward = doc.orderBy("start").rangeBetween(Window.currentRow, words - 1)
    # Counted from the end of the text, the backward window is the same rule.
    backward = doc.orderBy(F.desc("stop")).rangeBetween(Window.currentRow, words - 1)

    def over(span, first: Column, last: Column) -> Column:
        return F.struct(
            first.over(span).alias("first"),
            last.over(span).alias("last"),
            F.sum("words").over(span).alias("held"),
            F.collect_list(F.struct("line", "hash")).over(span).alias("hashes"),
            F.min(F.struct("hash", (-F.col("line")).alias("at"))).over(span)["hash"].alias("mark"),
        )

    both = F.array(over(forward, F.min("line"), F.max("line")), over(backward, F.min("line"), F.max("line")))
    rows = found.withColumn("both", both).select(*_KEY, F.explode("both").alias("w")).where(F.col("w.held") >= words)
    content = F.xxhash64(F.transform(F.array_sort("w.hashes"), lambda x: x["hash"]))
    return rows.select(*_KEY, "w.first", "w.last", content.alias("content"), "w.mark").distinct()


def repeated(found: DataFrame) -> DataFrame:
    """(doc_id, text_hash, first, last, source): the windows with an earlier copy, cut to what lies beyond that copy."""
    found = staged(found, "line-windows")
    marks = found.groupBy("mark").agg(F.min(F.struct(*_KEY, "first")).alias("a"), F.max(F.struct(*_KEY, "first")).alias("z")).where("a <> z").select("mark")
    likely = found.join(marks, "mark", "left_semi")
    place = F.struct(*_KEY, "first", "last")
    earliest = likely.groupBy("mark", "content").agg(F.min(place).alias("earliest"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    later = likely.join(earliest, ["mark", "content"]).where(place > F.col("earliest"))
    inside = F.col("doc_id").eqNullSafe(F.col("earliest.doc_id")) & (F.col("text_hash") == F.col("earliest.text_hash"))
    first = F.when(inside, F.greatest("first", F.col("earliest.last") + 1)).otherwise(F.col("first"))
    return later.select(*_KEY, first.alias("first"), "last", F.col("earliest.doc_id").alias("source")).where("first <= last")


def runs(found: DataFrame) -> DataFrame:
    """(doc_id, text_hash, runs, sources): the deleted runs of each document as sorted (first, last), and where the copies stand."""
    order = Window.partitionBy(*_KEY).orderBy("first", "last")
    before = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = found.withColumn("opens", F.when(F.col("first") <= before + 1, 0).otherwise(1)).withColumn("run", F.sum("opens").over(order))
    joined = opened.groupBy(*_KEY, "run").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.collect_set("source").alias("sources"))
    sources = F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources"))))
    return joined.groupBy(*_KEY).agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("runs"), sources.alias("sources"))


def dedup(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """The documents with later repeated runs taken out of their text, and (lines_removed, copied_from) added."""
    gone = runs(repeated(windows(lines(documents, id_col, text_col), words)))
    gone = gone.select(F.col("doc_id").alias("__doc"), F.col("text_hash").alias("__hash"), F.col("runs").alias("__runs"), F.col("sources").alias("__sources"))
    same = F.col(id_col).cast("long").eqNullSafe(F.col("__doc")) & (F.xxhash64(text_col) == F.col("__hash"))
    joined = documents.join(gone, same, "left")
    parts, cuts = F.split(text_col, "\n"), F.col("__runs")
    # What is kept lies before the first run, between two runs and after the last.
    starts = F.concat(F.array(F.lit(0)), F.transform(cuts, lambda r: r["last"] + 1))
    ends = F.concat(F.transform(cuts, lambda r: r["first"]), F.array(F.size(parts)))
    kept = F.flatten(F.transform(F.arrays_zip(starts.alias("s"), ends.alias("e")), lambda x: F.slice(parts, x["s"] + 1, x["e"] - x["s"])))
    removed = F.aggregate(cuts, F.lit(0), lambda n, r: n + r["last"] - r["first"] + 1)
    clash = [c for c in ("lines_removed", "copied_from") if c in documents.columns]
    columns = [F.when(cuts.isNull(), F.col(c)).otherwise(F.array_join(kept, "\n")).alias(c) if c == text_col else F.col(f"`{c}`") for c in documents.columns if c not in clash]
    return joined.select(*columns, F.coalesce(removed, F.lit(0)).alias("lines_removed"), F.coalesce("__sources", F.array().cast("array<bigint>")).alias("copied_from"))
