"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A text is split by the vocabulary's pattern; each match is merged on its own, always the pair of lowest rank, leftmost
first. Pending pairs lie in one bucket per rank, as positions of a linked list of symbols. A bitmap of two levels marks
the ranks whose buckets hold something: find-first-set at each level gives the lowest. A pair is queued only once it comes
before both of its neighbours, for until then one of them is merged first, which changes it. Entries whose pair has changed
since are stale and skipped. An n-byte match takes O(n log n) whatever its length; short matches are remembered.

Nulls: a null text is empty and has no ids; null ids decode to empty bytes. Repeated rows give repeated result rows. Other
columns are not read.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from footlog.llm.common import BLOCK, Memo, row_slices

#: Matches one worker remembers, in each of two generations.
REMEMBERED = 350_000
#: Ranks a block of the bitmap covers.
_WIDTH = 240  # whole digits of Python integers
#: Ids decoded at once.
_DECODED = 1 << 17
_loaded: dict[str, Coder] = {}
_tables: dict[str, pa.Array] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class Coder:
    """The ranks of one vocabulary and what is remembered of it; one per Python worker."""

    def __init__(self, path: str, pattern: str) -> None:
        self.ranks = read_ranks(path)
        self.pieces = {b: a for a, b in self.ranks.items()}
        self.none = max(self.pieces) + 1  # stands for a pair without a rank, after all others
        self.blocks = [r // _WIDTH for r in range(max(self.pieces) + 1)]
        self.bits = [1 << r % _WIDTH for r in range(max(self.pieces) + 1)]
        self.tops = [1 << b for b in range(max(self.pieces) // _WIDTH + 1)]
        self.pattern = regex.compile(pattern)
        self.memo = Memo(lambda match: array("i", self.merge(match.encode())).tobytes(), REMEMBERED)

    def merge(self, raw: bytes) -> list[int]:
        """The ids of one match of the pattern."""
        ranks, n = self.ranks, len(raw)
        if raw in ranks:
            return [ranks[raw]]
        find, none, blocks, bits_of, tops, push, pop = ranks.get, self.none, self.blocks, self.bits, self.tops, heapq.heappush, heapq.heappop
        # Symbol i is raw[i:end[i]]; its right neighbour starts at end[i]. Symbol n stands behind the last and, as -1, before the first.
        end, before = [*range(1, n + 1), 0], [*range(-1, n)]
        pair = [find(raw[i : i + 2], none) for i in range(n - 1)] + [none, none]  # the rank of symbol i with its right neighbour
        # The queue: a bucket of positions per rank, a bitmap of the ranks in use per block, a bitmap of the blocks in use.
        buckets: dict[int, list[int]] = {}
        low: dict[int, int] = {}
        top, look, last = 0, [], none
        for i in range(n - 1):
            if last > (rank := pair[i]) <= pair[i + 1]:
                look.append(i)
            last = rank
        while True:
            for i in look:
                rank = pair[i]
                if rank in buckets:
                    push(buckets[rank], i)
                else:
                    buckets[rank] = [i]
                    block = blocks[rank]
                    if block in low:
                        low[block] |= bits_of[rank]
                    else:
                        low[block] = bits_of[rank]
                        top |= tops[block]
            while top:  # find-first-set in both levels; entries whose pair has changed are skipped
                block = (top & -top).bit_length() - 1
                bits = low[block]
                rank = block * _WIDTH + (bits & -bits).bit_length() - 1
                bucket = buckets[rank]
                i = pop(bucket)
                if not bucket:
                    del buckets[rank]
                    if bits := bits & (bits - 1):
                        low[block] = bits
                    else:
                        del low[block]
                        top &= top - 1
                if pair[i] == rank:
                    break
            else:
                break
            gone, left = end[i], before[i]
            end[i] = right = end[gone]
            before[right] = i
            was_new, pair[gone] = pair[gone], none
            new = pair[i] = find(raw[i : end[right]], none)
            far = pair[right]
            # What the merge has brought before both of its neighbours: a changed pair, or the next on either side of these.
            look, near = [], none
            if left >= 0:
                was_near = pair[left]
                near = pair[left] = find(raw[left:right], none)
                beyond = before[left]
                other = pair[beyond]
                if other > near:
                    if near <= new:
                        look.append(left)
                elif was_near < other < pair[before[beyond]]:
                    look.append(beyond)
            if near > new <= far:
                look.append(i)
            if new > far >= was_new and far <= pair[end[right]]:
                look.append(right)
        out, i = [], 0
        while i < n:
            out.append(ranks[raw[i : end[i]]])
            i = end[i]
        return out

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian 32-bit integers."""
        if len(text) <= BLOCK:
            return b"".join(map(self.memo.__getitem__, self.pattern.findall(text)))
        return b"".join(self.memo[m.group()] for m in self.pattern.finditer(text))


def coder(path: str, pattern: str) -> Coder:
    key = f"{path}\n{pattern}"
    if key not in _loaded:
        _loaded[key] = Coder(path, pattern)
    return _loaded[key]


def pieces_by_rank(path: str) -> pa.Array:
    """The bytes of every rank, null where there is none; all that a worker that decodes keeps."""
    if path not in _tables:
        pieces = {b: a for a, b in read_ranks(path).items()}
        _tables[path] = pa.array([pieces.get(r) for r in range(max(pieces) + 1)], pa.binary())
    return _tables[path]


def encode(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(doc_id, ids): the token ids of every whole text."""
    path = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with_ranks = coder(path, pattern)
        for batch in batches:
            for part in row_slices(batch, "text"):
                made = [with_ranks.encode(x or "") for x in part.column(1).to_pylist()]
                ends = np.cumsum([0] + [len(m) // 4 for m in made]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(made), "<i4")))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["doc_id", "ids"])

    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, ids_col: str = "ids", out_col: str = "decoded", ranks: str | None = None) -> DataFrame:
    """The frame with the bytes its ids stand for."""
    path = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces_by_rank(path)
        for batch in batches:
            for part in row_slices(batch, ids_col, _DECODED):
                ids = part.column(ids_col)
                found = table.take(ids.flatten())
                if found.null_count:
                    raise KeyError("ids without a piece")
                ends = np.cumsum([0, *pc.fill_null(pc.list_value_length(ids), 0).to_pylist()]).astype(np.int32)
                made = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), found), b"")
                kept = [(n, part.column(n)) for n in part.schema.names if n != out_col]
                yield pa.RecordBatch.from_arrays([*(c for _, c in kept), made], names=[*(n for n, _ in kept), out_col])

    kept = [f for f in tokens.schema.fields if f.name != out_col]
    return tokens.mapInArrow(run, StructType([*kept, StructField(out_col, BinaryType())]))
