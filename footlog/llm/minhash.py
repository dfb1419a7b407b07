"""One-permutation MinHash fingerprints, in DataFrame operations only.

Shingles of five words (all words, if fewer), as they are written, are hashed once. The high bits of a hash name one of ``BINS`` bins, each bin
keeps its smallest hash. An empty bin borrows from a non-empty one by optimal densification: bin i walks all bins in its own
pseudo-random order and takes the first non-empty one, so two texts borrow alike as often as they are alike. The
lowest eight bits of every bin's value are packed into the fingerprint, two hexadecimal digits a bin. Two unequal values
agree in them by chance with probability 1/256, which ``likeness`` takes out of the share of agreeing bins.

The densified walk needs no loop: in the order of bin i, bin e stands at place (inverse_i * (e - shift_i)) mod BINS, and the
non-empty bin with the smallest place is taken.

Nulls: a null text is empty. A text without words has a fingerprint of its own (all bins borrow nothing: "00..."), alike to
itself only. Equal texts have equal fingerprints. Repeated rows give repeated result rows. Other columns are not read.
"""

from __future__ import annotations

import math

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from footlog.llm.common import SPACE

BINS, BIN_BITS = 128, 7
SHINGLE = 5
VALUE_BITS = 63 - BIN_BITS
_NONE, _TOP = (1 << VALUE_BITS) - 1, (1 << 63) - 1
EMPTY = "00" * BINS
_BYTES = [f"{i:02x}" for i in range(256)]
#: Documents whose ids are next to each other and are compared in one group.
GROUP = 256
_WALKS = [xxhash.xxh64_intdigest(str(i), 5) for i in range(BINS)]
_INVERSES = [w % BINS | 1 for w in _WALKS]  # odd, so the walk meets every bin once
_SHIFTS = [w // BINS % BINS for w in _WALKS]


def with_fingerprint(frame: DataFrame, text_col: str = "text", out_col: str = "fingerprint", shingle: int = SHINGLE) -> DataFrame:
    """The frame with the packed fingerprint of a text column as hexadecimal digits, two for each bin.

    Each step is a column of its own that the next one names more than once, so Spark computes it once.
    """
    w, e, f, g = (F.col(f"__{out_col}_{x}") for x in "wefg")
    words = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), f"{SPACE}+"), lambda x: x != "")
    runs = F.when(F.size(w) >= shingle, F.size(w) - shingle).otherwise(0)
    shingles = F.transform(F.sequence(F.lit(0), runs), lambda i: F.xxhash64(F.slice(w, i + 1, shingle)).bitwiseAND((1 << 63) - 1))
    # A placeholder above all values stands in every bin, so each bin has a first entry after the sort.
    blanks = F.lit([i << VALUE_BITS | _NONE for i in range(BINS)])
    entries = F.sort_array(F.concat(F.when(F.size(w) > 0, shingles).otherwise(F.array().cast("array<bigint>")), blanks))
    firsts = F.filter(e, lambda x, i: F.coalesce(x.bitwiseXOR(F.get(e, i - 1)), F.lit(_TOP)) >= 1 << VALUE_BITS)
    steps = {
        f"__{out_col}_w": F.transform(words, lambda x: F.xxhash64(x)),
        f"__{out_col}_e": entries,
        f"__{out_col}_f": firsts,
        f"__{out_col}_g": F.filter(f, lambda x: x.bitwiseAND(_NONE) != _NONE),
        out_col: F.when(F.size(g) == 0, F.lit(EMPTY)).otherwise(F.array_join(F.transform(f, lambda x, i: _digits(x, i, g)), "")),
    }
    for name, step in steps.items():
        frame = frame.withColumn(name, step)
    return frame.drop(*[c for c in steps if c != out_col])


def _digits(x: Column, i: Column, filled: Column) -> Column:
    """The two digits of bin i, from its own first entry or the one it borrows."""

    def at(e: Column) -> Column:
        place = ((F.shiftright(e, VALUE_BITS).cast("int") - F.lit(_SHIFTS)[i] + BINS) * F.lit(_INVERSES)[i]).bitwiseAND(BINS - 1)
        return F.shiftleft(place.cast("long"), VALUE_BITS).bitwiseOR(e.bitwiseAND(_NONE))

    value = F.when(x.bitwiseAND(_NONE) != _NONE, x).otherwise(F.array_min(F.transform(filled, at)))
    return F.get(F.lit(_BYTES), value.bitwiseAND(255).cast("int"))


def likeness(a: Column, b: Column) -> Column:
    """The estimated share of common shingles, 0 to 1, of two fingerprints."""

    def different(i: Column) -> Column:
        """How many of four bins differ: the non-zero bytes of the exclusive or."""
        word = [F.conv(x.substr(i, F.lit(8)), 16, 10).cast("long") for x in (a, b)]
        low = word[0].bitwiseXOR(word[1]).bitwiseAND(0x7F7F7F7F) + 0x7F7F7F7F
        return F.bit_count(low.bitwiseOR(word[0].bitwiseXOR(word[1])).bitwiseAND(0x80808080))

    agree = BINS - F.aggregate(F.sequence(F.lit(1), F.lit(2 * BINS - 7), F.lit(8)), F.lit(0), lambda n, i: n + different(i))
    chance = 1 / 256
    corrected = F.greatest(F.lit(0.0), (agree / F.lit(float(BINS)) - chance) / (1 - chance))
    return F.when(a == b, 1.0).when((a == EMPTY) | (b == EMPTY), 0.0).otherwise(corrected)


def with_next(documents: DataFrame, group: int = GROUP) -> DataFrame:
    """Documents (doc_id, text; text not null) with their fingerprint, and text and fingerprint of the next by descending id.

    After the last comes the first. Ids are cut into ranges of about ``group`` documents; texts are dealt by range once, and
    only the last document of a range looks beyond it, over a table of the ranges. Ties of one id are ordered by text; null
    ids come last.
    """
    total, low, high = documents.agg(F.count(F.lit(1)), F.min("doc_id"), F.max("doc_id")).first()
    width = max(1, math.ceil(((high or 0) - (low or 0) + 1) / max(1, math.ceil(total / group))))
    span = F.coalesce(F.floor((F.col("doc_id").cast("double") - float(low or 0)) / width), F.lit(-1)).alias("span")
    dealt = documents.select("doc_id", "text", span).repartition("span")
    order = Window.partitionBy("span").orderBy(F.desc_nulls_last("doc_id"), "text")
    marked = with_fingerprint(dealt)
    for c in ("text", "fingerprint"):
        marked = marked.withColumn(f"next_{c}", F.lead(c).over(order))
    # The two ends of each range; their fingerprints are made only for them.
    last = with_fingerprint(dealt.withColumn("after", F.lead(F.lit(1)).over(order)).where("after is null").drop("after"))
    tops = with_fingerprint(dealt.withColumn("before", F.lag(F.lit(1)).over(order)).where("before is null"))
    tops = tops.select(F.col("span").alias("lower"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint"))
    # Every range's next lower range in use: inside blocks of ranges first, then over the blocks.
    used = documents.select(span).distinct().withColumn("block", F.floor(F.col("span") / 4096))
    inner = used.withColumn("lower", F.lead("span").over(Window.partitionBy("block").orderBy(F.desc("span"))))
    blocks = used.groupBy("block").agg(F.max("span").alias("first"))
    beyond = blocks.select("block", F.coalesce(F.lead("first").over(Window.orderBy(F.desc("block"))), F.max("first").over(Window.partitionBy(F.lit(1)))).alias("wrapped"))
    following = inner.join(beyond, "block").select(F.col("span").alias("of"), F.coalesce("lower", "wrapped").alias("lower"))
    reached = following.join(tops, "lower").drop("lower")
    ended = last.join(reached, F.col("span") == F.col("of")).drop("of", "span")
    return marked.where("next_text is not null").drop("span").unionByName(ended)


def compare_edits(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, whose second half is the beginning of the next document."""
    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    # A bare column where it is one already: renamed copies keep Spark from seeing that the dealt texts are the same.
    key = F.col(id_col) if (id_col, "bigint") in documents.dtypes and id_col == "doc_id" else F.col(id_col).cast("long").alias("doc_id")
    beside = with_next(documents.select(key, text))
    size = F.length("text").cast("long")
    half = F.floor(size / 2)
    edited = F.concat(F.substring("text", F.lit(1), (size - half).cast("int")), F.substring("next_text", F.lit(1), half.cast("int")))
    made = beside.select("doc_id", size.alias("n_chars"), edited.alias("edited"), "fingerprint", "next_fingerprint")
    both = with_fingerprint(made.withColumn("edited_sha256", F.sha2("edited", 256)), "edited", "edited_fingerprint")
    return both.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
