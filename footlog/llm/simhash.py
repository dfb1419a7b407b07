"""SimHash near-duplicates: 64-bit fingerprints, links by pivot distance tables, connected components.

A fingerprint bit is set when more than half of the shingle hashes (repeats counted) have it. Two fingerprints link when
they differ in at most ``radius`` bits.

Links are searched in buckets that agree on one of ``radius + 1`` blocks of bits (at least one block of a linked pair is
untouched). Inside a bucket the Hamming distances of every fingerprint to a table of reference fingerprints (pivots) are
precomputed; a pair whose distances to any pivot differ by more than the radius cannot link (triangle inequality) and is
discarded, survivors are verified. A bucket with more than ``most`` fingerprints is not searched as it stands: its open
bits are divided again in the same way, which loses no pair, until the bucket is small; after six divisions at most 12
bits are open, so this ends. Each bucket hands on a spanning forest of its links, never all pairs.

Nulls: a null text is empty; an empty text has fingerprint zero and links like any other. Rows with a null id take part and
belong to the component of their fingerprint, whose id is the smallest non-null one (null if there is none). Repeated rows
give repeated result rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footlog.llm.common import staged, word_blocks

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Fingerprints of a bucket that one task compares with each other.
MOST = 512
#: Divisions of the bits after which at most 12 of 64 are open (for a radius of 3), which is 4096 fingerprints.
DIVISIONS = 6
#: Reference fingerprints: the hashes of their numbers.
PIVOTS = np.array([xxhash.xxh64_intdigest(str(i), SEED) for i in range(16)], dtype=np.uint64)


def simhash(raw: bytes | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of a UTF-8 text, as an unsigned integer."""
    ones, total, tail = np.zeros(64, dtype=np.int64), 0, []
    for words in word_blocks((raw or b"").lower()):
        words = tail + words
        if len(words) >= shingle:
            total += _add(ones, [xxhash.xxh64_intdigest(b" ".join(s), SEED) for s in zip(*(words[i:] for i in range(shingle)), strict=False)])
        tail = words[1 - shingle :] if shingle > 1 else []
    if not total and tail:
        total += _add(ones, [xxhash.xxh64_intdigest(b" ".join(tail), SEED)])
    return int(np.packbits(ones * 2 > total, bitorder="little").view(np.uint64)[0]) if total else 0


def _add(ones: np.ndarray, hashes: list[int]) -> int:
    for start in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[start : start + (1 << 16)], dtype=np.uint64)
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return len(hashes)


def fingerprints(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_hash, fp): one row per document; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([simhash(x, shingle) for x in batch.column(2).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(made.view(np.int64))], names=["doc_id", "text_hash", "fp"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long")


def divided(masks: list[int], parts: int) -> list[int]:
    """For every mask of fixed bits, the masks that also fix one of ``parts`` blocks of the bits still open."""
    out = []
    for mask in masks:
        free = [b for b in range(64) if not mask >> b & 1]
        cuts = [round(i * len(free) / parts) for i in range(parts + 1)]
        out += [mask | sum(1 << b for b in free[cuts[i] : cuts[i + 1]]) for i in range(parts)]
    return out


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _keyed(rows: DataFrame, masks: list[int], parts: int) -> DataFrame:
    """Rows (fp, path) repeated for each division of their path, with the bits that must agree."""
    table = F.lit([_signed(m) for m in masks])
    path = F.explode(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.col("path") * parts + i))
    return rows.select("fp", path.alias("path")).select("fp", "path", F.col("fp").bitwiseAND(table[F.col("path")]).alias("key"))


def pivot_table(fp: np.ndarray) -> np.ndarray:
    """The Hamming distances of every fingerprint to the pivots."""
    return np.bitwise_count(fp[:, None] ^ PIVOTS[None, :]).astype(np.int8)


def linked(fp: np.ndarray, table: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Which pairs of places (a, b) link: the pivots' distances discard pairs, survivors are verified."""
    out = (np.abs(table[b] - table[a]) <= radius).all(axis=1)
    left = np.flatnonzero(out)
    out[left] = np.bitwise_count(fp[a[left]] ^ fp[b[left]]) <= radius
    return out


def links_in_buckets(fp: np.ndarray, bucket: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links inside each bucket: (fingerprint, representative) pairs."""
    table = pivot_table(fp)
    order = np.lexsort((table[:, 0], bucket))
    fp, bucket, table = fp[order], bucket[order], table[order]
    label, live, step = np.arange(len(fp)), np.arange(len(fp)), 0
    while True:
        step += 1
        live = live[live < len(fp) - step]
        # Sorted by the first pivot: once a distance exceeds the radius it does so for all later partners.
        live = live[(bucket[live] == bucket[live + step]) & (table[live + step, 0] - table[live, 0] <= radius)]
        if not len(live):
            break
        near = live[linked(fp, table, live, live + step, radius)]
        _join(label, near, near + step)
    found = np.flatnonzero(label != np.arange(len(fp)))
    return fp[found], fp[label[found]]


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the classes of the pairs; a label is the smallest member of its class."""
    while True:
        x, y = label[a], label[b]
        different = x != y
        if not different.any():
            return
        a, b, x, y = a[different], b[different], x[different], y[different]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label[:] = label[label]


def _search(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(fp, path, key):
            if len(fp) > 1:
                change = np.r_[True, (path[1:] != path[:-1]) | (key[1:] != key[:-1])]
                a, b = links_in_buckets(fp.view(np.uint64), np.cumsum(change), radius)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        kept = [np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int64)]
        for batch in batches:  # sorted by bucket: the last bucket of a batch may go on in the next
            kept = [np.concatenate([k, batch.column(i).to_numpy(zero_copy_only=False)]) for i, k in enumerate(kept)]
            fp, path, key = kept
            last = int(np.argmax((path == path[-1]) & (key == key[-1]))) if len(fp) else 0
            yield from found(fp[:last], path[:last], key[:last])
            kept = [k[last:] for k in kept]
        yield from found(*kept)

    return run


def links(distinct: DataFrame, radius: int = RADIUS, most: int = MOST) -> DataFrame:
    """(a, b) of distinct fingerprints (column fp): pairs within the radius that connect all linked fingerprints."""
    parts, masks = radius + 1, [0]
    open_rows, found = distinct.select("fp", F.lit(0).alias("path")), None
    while True:
        masks = divided(masks, parts)
        keyed = staged(_keyed(open_rows, masks, parts), "simhash-keys")
        sizes = keyed.groupBy("path", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        sized = staged(keyed.join(sizes, ["path", "key"]), "simhash-buckets")
        last = len(masks) >= parts**DIVISIONS  # so few bits are open now that any bucket is small enough
        small = (sized if last else sized.where(F.col("n") <= most)).select("fp", "path", "key")
        made = small.repartition("path", "key").sortWithinPartitions("path", "key").mapInArrow(_search(radius), "a long, b long")
        found = made if found is None else found.unionByName(made)
        open_rows = sized.where(F.col("n") > most).select("fp", "path")
        if last or open_rows.isEmpty():
            return found


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of (a, b) edges; the label is the smallest node of its component.

    Alternates the two star steps: neighbours above a node move to its smallest neighbour, then neighbours below it do.
    Every step is a grouped minimum and a join, so a node with very many edges is pre-aggregated and split.
    """
    edges = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "components")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        moved = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        edges = staged(moved.where("u <> v").distinct(), "components")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))


def near_duplicates(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, most: int = MOST
) -> DataFrame:
    """(doc_id, text_hash, fp, label, component_id) for every document.

    component_id is the smallest id it reaches over links, label the smallest fingerprint (the same for a whole component).
    """
    marked = staged(fingerprints(documents, id_col, text_col, shingle), "simhash")
    nodes = staged(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    found = components(links(nodes, radius, most))
    labelled = nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    roots = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    classes = labelled.join(roots, "label").select(F.col("fp").alias("of"), "label", "component_id")
    return marked.join(classes, F.col("fp") == F.col("of")).drop("of")


def hex_of(fp):
    """A signed long as 16 lowercase hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
