"""Fill-in-middle: texts reordered as prefix, suffix, middle, with cuts found by a Fenwick tree over text blocks.

A text is a run of units: white space with the word after it, and white space at the end as a unit of its own. Its UTF-8
bytes lie in fixed blocks; a Fenwick tree holds every block's unit ends and code points. A cut after u units descends the
tree by binary lifting to the block that holds the u-th unit end, taking along the code points before it, and finds the
boundary inside that block only. Whether and where a text is cut follows from a hash of its id, so any run repeats it.

Nulls: a null text is empty and stays plain; a null id hashes as an empty one. Texts that hold a marker stay plain, since
they could not be restored. Repeated rows give repeated result rows, equal ids cut alike by their own numbers of units.
Very long texts are one row of a batch by themselves and take a few bytes of memory per byte. An empty table gives an empty
result with the same columns. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footlog.llm.common import row_slices

#: Markers before prefix, suffix and middle.
MARKERS = ("<P>", "<S>", "<M>")
#: Bytes of text in a block.
BLOCK = 4096
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


class UnitTree:
    """Unit ends and code points of a text's blocks, as sums of a Fenwick tree."""

    def __init__(self, raw: bytes, block: int = BLOCK) -> None:
        self.raw, self.block = np.frombuffer(raw, np.uint8), block
        space = (self.raw == 0x20) | ((self.raw >= 0x09) & (self.raw <= 0x0D))
        self.ends = ~space
        self.ends[:-1] &= space[1:]
        self.ends[-1:] = True  # the last unit ends with the text, be it a word or white space
        self.first = (self.raw & 0xC0) != 0x80  # the first bytes of code points
        starts = np.arange(0, len(raw), block)
        sums = [np.r_[0, np.cumsum(np.add.reduceat(x, starts, dtype=np.int64))] if len(raw) else np.zeros(1, np.int64) for x in (self.ends, self.first)]
        self.n, places = int(sums[0][-1]), np.arange(len(starts) + 1)
        below = places - (places & -places)
        self.units, self.chars = ((x - x[below]).tolist() for x in sums)

    def cut(self, units: int) -> tuple[int, int]:
        """Bytes and code points before the end of so many units."""
        if not units:
            return 0, 0
        at, chars, last = 0, 0, len(self.units) - 1
        step = 1 << last.bit_length() >> 1
        while step:
            if at + step <= last and self.units[at + step] < units:
                at += step
                units -= self.units[at]
                chars += self.chars[at]
            step >>= 1
        start = at * self.block
        end = start + int(np.flatnonzero(self.ends[start : start + self.block])[units - 1]) + 1
        return end, chars + int(np.count_nonzero(self.first[start:end]))


def rearranged(key: str, raw: bytes, rate: int, suffix_first: int, markers: tuple[str, str, str] = MARKERS) -> tuple:
    """(n, form, code points of prefix and middle, output) of one text."""
    tree, marks = UnitTree(raw), [m.encode() for m in markers]
    h1, h2, h3, h4 = np.frombuffer(hashlib.sha256(key.encode()).digest()[:16], ">u4").tolist()
    if not raw or h3 % 100 >= rate or any(m in raw for m in marks):
        return tree.n, "plain", None, None, raw
    low, high = sorted((h1 % (tree.n + 1), h2 % (tree.n + 1)))
    (a, before), (b, until) = tree.cut(low), tree.cut(high)
    parts = [(marks[0], raw[:a]), (marks[1], raw[b:])]
    form = "spm" if h4 % 100 < suffix_first else "psm"
    ordered = [*(reversed(parts) if form == "spm" else parts), (marks[2], raw[a:b])]
    return tree.n, form, before, until - before, b"".join(x for pair in ordered for x in pair)


def fill_in_middle(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = 42,
    rate: int = 50,
    suffix_first: int = 80,
    markers: tuple[str, str, str] = MARKERS,
) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): ``rate`` per cent of the texts are rearranged, of those
    ``suffix_first`` per cent with the suffix in front."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, "text"):
                ids = part.column(0).to_pylist()
                made = [rearranged(f"{seed}:{'' if i is None else i}", x.as_py() or b"", rate, suffix_first, markers) for i, x in zip(ids, part.column(1), strict=True)]
                n, form, before, middle, output = zip(*made, strict=True)
                columns = [part.column(0), pa.array(n, pa.int64()), pa.array(form), pa.array(before, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, SCHEMA)


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The exact text, from its rearranged output and form; no text in those forms holds a marker of its own."""
    part = F.split(output, "|".join(rf"\Q{m}\E" for m in markers), -1)
    first, second, middle = (F.get(part, F.lit(i)) for i in (1, 2, 3))
    return F.when(form == "plain", output).when(form == "psm", F.concat(first, middle, second)).otherwise(F.concat(second, middle, first))
