"""Best-fit packing of token sequences: best-two-fit over counts of lengths.

A document is its token ids followed by one end id. Documents longer than the capacity are cut into pieces of the capacity
(the last may be shorter); nothing else is cut. Pieces are dealt by hash to groups of bounded size and every group is
packed on its own: a bin is filled greedily with the longest piece that fits, then the smallest piece in the bin is
replaced by two unpacked pieces while that leaves a smaller gap. Bins with the same lengths are made together as long as
the counts of those lengths last. A group leaves at most a few bins part-filled, out of many thousands.

Nulls: a null text is empty and packs as the end id alone; a null id is kept. Repeated rows are packed once per row. Other
columns are not read.
"""

from __future__ import annotations

import math
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footlog.llm.common import Memo, staged, word_blocks

CAPACITY = 4096
END_ID = 1
#: Pieces that one task packs together.
GROUP = 1 << 16
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Words one worker remembers, in each of two generations.
REMEMBERED = 150_000
#: Punctuation that a letter before it never joins, and that no special token ends with.
_AFTER = b".,!?;:#$%&*()-_=+~@^/\\\"]}"
#: The characters that stand for bytes in a byte-level vocabulary: printable Latin-1 ones for themselves, the others from U+0100 on.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_SHOWN = {b: 0x100 + i for i, b in enumerate(x for x in range(0x100) if x not in set(_PRINTED))}
_encoders: dict[str, Memo] = {}


def word_encoder(path: str) -> Memo:
    """Ids of a white-space separated word as little-endian 32-bit bytes.

    The vocabulary's normaliser and pre-tokenizer drop white space and never join across it, so a text's ids are those of
    its words, one after another. Likewise punctuation after a letter is split off and case is folded, so a word with them
    is looked up by its parts. One memo lives as long as its Python worker.
    """
    if path not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)

        model, special = tokenizer.model, {t.content for t in tokenizer.get_added_tokens_decoder().values()}

        def ids(word: bytes) -> bytes:
            stem = word.rstrip(_AFTER)
            if len(stem) < len(word) and stem and (end := stem.decode()[-1]).isalpha() and end < "\u0130":
                return memo[stem] + memo[word[len(stem) :]]
            text = word.decode()
            if text.isalpha() and max(text) < "\u0130" and text not in special:
                # One run of Latin letters: normalising only folds its case and splitting leaves it whole.
                if (low := text.lower()) != text:
                    return memo[low.encode()]
                return array("I", [t.id for t in model.tokenize(word.decode("latin-1").translate(_SHOWN))]).tobytes()
            return array("I", tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

        memo = _encoders[path] = Memo(ids, REMEMBERED)
    return _encoders[path]


def pieces(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID
) -> DataFrame:
    """One row per piece: where it starts in its document, its length and the checksum of its ids."""
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, end, step = word_encoder(path).__getitem__, np.array([end_id], "<u4").tobytes(), 4 * capacity
        for batch in batches:
            rows = []
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = b"".join([b"".join(map(word, words)) for words in word_blocks(raw.as_py() or b"")]) + end
                rows += [(doc, i, i * capacity, min(step, len(ids) - i * step) // 4, zlib.crc32(ids[i * step : (i + 1) * step])) for i in range(-(-len(ids) // step))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    def nonempty(batches):
        return run(b for b in batches if b.num_rows)

    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(nonempty, PIECES)


def best_two_fit(counts: np.ndarray, capacity: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """Bins for counts[length] pieces of each length: (number of equal bins, [(length, pieces of it in a bin)])."""
    left, sizes = counts.astype(np.int64).copy(), np.arange(capacity + 1)

    def floors(have: np.ndarray) -> np.ndarray:
        """For every x the largest length up to x that is still to be had, or 0."""
        return np.maximum.accumulate(np.where(have > 0, sizes, 0))

    lower = floors(left)
    while lower[capacity]:
        gap, limit, inside = capacity, capacity, {}
        while limit and (size := int(lower[min(gap, limit)])):
            inside[size] = min(gap // size, int(left[size]))
            gap, limit = gap - inside[size] * size, size - 1
        while gap and sum(inside.values()) > 1:
            small = min(inside)
            rest = left.copy()
            for size, k in inside.items():
                rest[size] -= k
            fits = floors(rest)
            first = np.flatnonzero(rest[: gap + small] > 0)  # one of the two; the other is the largest that fits beside it
            second = fits[gap + small - first]
            alone = (second == first) & (rest[first] < 2)
            second = np.where(alone, fits[np.maximum(first - 1, 0)], second)
            total = np.where(second > 0, first + second, 0)
            if not len(total) or total.max() <= small:
                break
            pick = int(total.argmax())
            inside[small] -= 1
            if not inside[small]:
                del inside[small]
            for size in (int(first[pick]), int(second[pick])):
                inside[size] = inside.get(size, 0) + 1
            gap -= int(total[pick]) - small
        times = min(int(left[size]) // k for size, k in inside.items())
        yield times, sorted(inside.items(), reverse=True)
        for size, k in inside.items():
            left[size] -= times * k
        if any(not left[size] for size in inside):
            lower = floors(left)


def pack(found: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Pieces (from ``pieces``) with sequence_id and offset."""
    found = staged(found, "packing-pieces")
    groups = max(1, math.ceil(found.count() / group))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "ids_crc32"], kind="stable", na_position="first").reset_index(drop=True)
        length = rows["length"].to_numpy()
        counts = np.bincount(length, minlength=capacity + 1)
        taken = np.r_[0, np.cumsum(counts)[:-1]]  # the next piece of each length, in sorted order
        sequence, offset = np.empty(len(rows), np.int64), np.empty(len(rows), np.int64)
        bins = 0
        for times, inside in best_two_fit(counts, capacity):
            at = 0
            for size, k in inside:
                place = np.arange(times * k)
                here = slice(taken[size], taken[size] + times * k)
                sequence[here], offset[here] = bins + place // k, at + place % k * size
                taken[size] += times * k
                at += k * size
            bins += times
        return rows.assign(sequence_id=sequence * groups + int(key[0]), offset=offset).drop(columns="slot")

    slot = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.lit("packing")), F.lit(groups)).alias("slot")
    return found.select("*", slot).groupBy("slot").applyInPandas(run, f"{PIECES}, sequence_id long, offset long")
