"""Language-model scoring with a log-frequency Bloom filter of quantised n-gram counts.

Unigrams and bigrams of all training texts are counted by 64-bit hash, pairs met once among them. A count c is stored as
its level 1 + floor(log(c) / log(BASE)): the filter receives the n-gram together with every number from 1 to its level.
Reading asks for level 1, 2, ... until the first miss, so a false hit can only raise a level, and seldom by more than one.
Level 1, which tells what was met from what was not, has more bits and probes than the others.
A level stands for the mean of the counts that have it. The probability of a word after another mixes the share of the pair
in the count of the first word, with a weight that rises with that count up to WEIGHT, and the word's own probability. All
words' probabilities sum to one or less, but for quantising and false hits (of a pair not met, below one in a thousand).

Texts are read once. A task numbers the words of a bounded portion of texts and writes the portion down: its distinct words
and a number for each token. All later steps read portions. The filter consists of blocks, one for about PER_BLOCK counted
n-grams, sized by what they hold. Every portion sends its distinct n-grams with their training counts to their blocks, each
once; a block's task adds up the counts, fills the block and answers with the levels it reads from it, one byte for each n-gram
sent. So what is dealt grows with the texts, whatever the size of the filter, and no task holds more of it than a block. The
exact unigram counts of the base score are broadcast for the HEAD most frequent words; all other words of a portion meet their
counts in a join.

Nulls: a null text is empty and has the end as its only token. A document with a null id is neither held out nor learned
from. Repeated rows are learned from and scored as often as they stand. Other columns are not read.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import count, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footlog.llm.common import in_fold, most_frequent, staged, word_blocks

BASE, WEIGHT, PRIOR = 1.5, 0.6, 20.0
BITS, PROBES = 10, 5
#: Bits and probes of level 1: a pair never met passes for one met once about twice in ten thousand cases.
FIRST_BITS, FIRST_PROBES = 18, 12
#: Pairs of words count from this number of meetings on.
PAIRS = 1
#: A block of the filter is made and read by one task; SEGMENT bounds its bytes where that is less.
PER_BLOCK, SEGMENT, HEAD = 200_000, 72 << 20, 150_000
#: Tokens of the texts that are numbered together; a longer text is a portion of its own.
PORTION = 1 << 20
#: The end of a text is the empty word; it also stands before the first word.
END = b""
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of x."""
    x = x + _MIX[0]
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(42)), np.uint64, len(words))


def level_of(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / math.log(BASE) + 1e-9).astype(np.int64)


def spread(hashes: np.ndarray, level: int) -> np.ndarray:
    """One hash for each n-gram at a level."""
    return mix(hashes ^ np.uint64(level * int(_MIX[1]) & (1 << 64) - 1))


def bit_at(mixed: np.ndarray, probe: int, size: np.ndarray | np.uint64) -> np.ndarray:
    """The bit of a probe inside blocks of ``size`` bits (below 2 ** 32)."""
    drawn = (mixed + np.uint64(probe) * ((mixed >> np.uint64(32)) | np.uint64(1))) & np.uint64(0xFFFFFFFF)
    return (drawn * size >> np.uint64(32)).view(np.int64)


def probes_of(level: int) -> int:
    return FIRST_PROBES if level == 1 else PROBES


def _portions(most: int):
    """Texts as portions: a row for each with its documents, its distinct words (the end first) and a number for each token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, docs, tokens, size = _numbers(), [], [], 0

        def out():
            ids, held, learned = zip(*docs, strict=True)
            words = b" ".join(number)
            row = ([ids], [held], [learned], [list(map(len, tokens))], [len(words)], [packed(words)], [packed(np.concatenate(tokens))])
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, _PORTION_TYPES, strict=True)], names=_PORTION)

        for batch in batches:
            for doc, held, learned, raw in zip(*batch.columns, strict=True):
                words = _words(raw)
                docs.append((doc.as_py(), held.as_py(), learned.as_py()))
                tokens.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
                size += len(words)
                if size >= most:
                    yield out()
                    number, docs, tokens, size = _numbers(), [], [], 0
        if docs:
            yield out()

    return run


def _numbers() -> defaultdict:
    """Word -> number, in the order in which words are met; the end is 0."""
    number: defaultdict = defaultdict(count().__next__)
    number[END]
    return number


_PORTION = ["ids", "held", "learned", "lengths", "size", "words", "places"]
_PORTION_TYPES = [pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.int64(), pa.binary(), pa.binary()]
_PORTIONS = "ids array<long>, held array<boolean>, learned array<boolean>, lengths array<int>, size long, words binary, places binary"


def packed(values: np.ndarray | bytes) -> bytes:
    return pa.compress(values if isinstance(values, bytes) else values.tobytes(), "zstd", asbytes=True)


def unpacked(raw: bytes, size: int, kind: str) -> np.ndarray:
    """``size`` values of a type that were packed."""
    return np.frombuffer(pa.decompress(raw, size * np.dtype(kind).itemsize, "zstd"), kind)


def steps(grams: np.ndarray) -> bytes:
    """Ascending hashes as steps from one to the next, all first bytes together, and so on: the highest bytes take no room."""
    return packed(np.diff(grams, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes())


def unstepped(raw: bytes, size: int) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(unpacked(raw, 8 * size, "u1").reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def words_in(row: dict) -> list[bytes]:
    """The distinct words of a row of portions."""
    return unpacked(row["words"], row["size"], "u1").tobytes().split(b" ")


class Portion:
    """A row of portions, unpacked."""

    def __init__(self, row: dict) -> None:
        self.words = words_in(row)
        self.lengths = np.array(row["lengths"], np.int64)
        self.places = unpacked(row["places"], int(self.lengths.sum()), "<i4")

    def learned(self, of: list[bool]) -> np.ndarray:
        """Which tokens stand in training texts."""
        return np.repeat(np.array(of, bool), self.lengths)

    def grams(self) -> Iterator[tuple[bool, np.ndarray, np.ndarray]]:
        """(alone, distinct hashes, the place of every token's among them) of words, then of pairs. Every text ends with the
        end, which so stands before the next one's first word too."""
        hashes = word_hashes(self.words)
        words, back = np.unique(hashes, return_inverse=True)
        yield True, words, back[self.places]
        before = np.r_[np.int32(0), self.places[:-1]]
        yield False, *np.unique(mix(mix(hashes)[before] ^ hashes[self.places]), return_inverse=True)


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield {name: column[i].as_py() for name, column in zip(batch.schema.names, batch.columns, strict=True)}


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n): the words of every portion's training texts."""
    for batch in batches:
        for row in _rows(batch):
            portion = Portion(row)
            n = np.bincount(portion.places[portion.learned(row["learned"])], minlength=len(portion.words))
            met = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([portion.words[i] for i in met], pa.binary()).cast(pa.string()), pa.array(n[met], pa.int64())], names=["word", "n"])


def _blobs(grams: np.ndarray, counts: np.ndarray, blocks: int, alone: bool) -> Iterator[pa.RecordBatch]:
    """Counted n-grams, ascending, dealt by block: a row per block with all its hashes and counts, which shuffle far smaller than rows."""
    block = block_of(grams, blocks)
    order = np.argsort(block, kind="stable")
    grams, counts, block = grams[order], counts[order].astype("<i8"), block[order]
    starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(block) else np.empty(0, int)
    ends = np.r_[starts[1:], len(block)]
    columns = [
        pa.array(block[starts].astype(np.int32)),
        pa.array(ends - starts, pa.int64()),
        pa.array([steps(grams[a:z]) for a, z in zip(starts, ends, strict=True)], pa.binary()),
        pa.array([packed(counts[a:z]) for a, z in zip(starts, ends, strict=True)], pa.binary()),
        pa.array([alone] * len(starts), pa.bool_()),
    ]
    yield pa.RecordBatch.from_arrays(columns, names=["block", "size", "grams", "counts", "alone"])


_BLOBS = "block int, size long, grams binary, counts binary, alone boolean, portion long"


def _sent(blocks: int):
    """The distinct n-grams of every portion with their training counts (0: met in held-out texts only), dealt by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                portion = Portion(row)
                learned = portion.learned(row["learned"])
                for alone, grams, back in portion.grams():
                    counts = np.bincount(back[learned], minlength=len(grams))
                    for made in _blobs(grams, counts, blocks, alone):
                        yield pa.RecordBatch.from_arrays([*made.columns, pa.array([row["portion"]] * made.num_rows, pa.int64())], names=[*made.schema.names, "portion"])

    return run


def _grams_of(table: pa.Table) -> np.ndarray:
    return np.concatenate([unstepped(x, n) for x, n in zip(table["grams"].to_pylist(), table["size"].to_pylist(), strict=True)])


def _filled(table: pa.Table) -> pa.Table:
    """The Bloom filter block of a block's n-gram counts, and what its levels stand for."""
    sizes = table["size"].to_pylist()
    grams = _grams_of(table)
    counts = np.concatenate([unpacked(x, n, "<i8") for x, n in zip(table["counts"].to_pylist(), sizes, strict=True)])
    alone = np.repeat(table["alone"].to_numpy(), sizes)
    order = np.argsort(grams, kind="stable")
    grams, counts, alone = grams[order], counts[order], alone[order]
    first = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]])
    grams, counts, alone = grams[first], np.add.reduceat(counts, first), alone[first]
    kept = counts >= np.where(alone, 1, PAIRS)
    grams, counts = grams[kept], counts[kept]
    levels = level_of(counts)
    size = max(1, -(-(int(levels.sum()) * BITS + len(levels) * (FIRST_BITS - BITS)) // 64)) * 64
    bits = np.zeros(size, bool)
    for level in range(1, int(levels.max(initial=0)) + 1):
        mixed = spread(grams[levels >= level], level)
        for i in range(probes_of(level)):
            bits[bit_at(mixed, i, np.uint64(size))] = True
    held = np.bincount(levels)
    sums = np.bincount(levels, weights=counts)
    row = {"block": table["block"][:1], "bits": [np.packbits(bits, bitorder="little").tobytes()], "held": [held.tolist()], "sums": [sums.tolist()]}
    return pa.table({k: v if k == "block" else pa.array(v, t) for (k, v), t in zip(row.items(), (None, pa.binary(), pa.list_(pa.int64()), pa.list_(pa.float64())), strict=True)})


class Segment:
    """Some blocks of the filter: all bits in one array, with each block's place and size."""

    def __init__(self, rows: Iterable, blocks: int, total: int | None = None) -> None:
        """With ``total`` bytes given, rows may come one at a time; each goes straight into the one array."""
        if total is None:
            rows = list(rows)
            total = sum(len(r["bits"]) for r in rows)
        self.blocks, self.start, self.size = blocks, np.full(blocks, -1, np.int64), np.ones(blocks, np.uint64)
        self.bits = np.empty(total, np.uint8)
        at = 0
        for r in rows:
            size = len(r["bits"])
            self.bits[at : at + size] = np.frombuffer(r["bits"], np.uint8)
            self.start[r["block"]], self.size[r["block"]] = 8 * at, 8 * size
            at += size

    def levels(self, hashes: np.ndarray) -> np.ndarray:
        """The level of every n-gram; 0 if it is in none of these blocks. Equal ones are probed once."""
        hashes, back = np.unique(hashes, return_inverse=True)
        block = block_of(hashes, self.blocks)
        found, live = np.zeros(len(hashes), np.uint8), np.flatnonzero(self.start[block] >= 0)
        level = 0
        while len(live) and level < 255:
            level += 1
            mixed, start, size = spread(hashes[live], level), self.start[block[live]], self.size[block[live]]
            for i in range(probes_of(level)):
                place = start + bit_at(mixed, i, size)
                hit = np.flatnonzero(self.bits[place >> 3] >> (place & 7).astype(np.uint8) & 1)
                if len(hit) < len(live):
                    live, mixed, start, size = live[hit], mixed[hit], start[hit], size[hit]
            found[live] = level
        return found[back]


def block_of(hashes: np.ndarray, blocks: int) -> np.ndarray:
    return ((hashes >> np.uint64(16)) % np.uint64(blocks)).astype(np.int64)


def _answered(blocks: int):
    """What a block's filter knows of the n-grams sent to it, a row for each portion's, and a row of what its levels stand for."""

    def run(table: pa.Table) -> pa.Table:
        row = _filled(table).to_pylist()[0]
        sent = table["size"].to_pylist()
        levels = Segment([row], blocks).levels(_grams_of(table))
        made = {
            "portion": [*table["portion"].to_pylist(), None],
            "block": [row["block"]] * (len(sent) + 1),
            "size": [*sent, None],
            "alone": [*table["alone"].to_pylist(), None],
            "levels": [*map(packed, np.split(levels, np.cumsum(sent)[:-1])), None],
            "held": [None] * len(sent) + [row["held"]],
            "sums": [None] * len(sent) + [row["sums"]],
        }
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(made.items(), (pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.float64())), strict=True)})

    return run


class Trained:
    """What scoring needs: exact totals, the exact counts (a table, its head collected), the filter's answers to every portion."""

    def __init__(self, portions: DataFrame, per_block: int, segment: int, head: int) -> None:
        counted = portions.mapInArrow(_word_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
        self.words = staged(counted, "ngrams-words")
        total = self.words.agg(F.count(F.lit(1)).alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
        self.tokens, self.vocabulary = total["n"], total["v"]
        self.head = {r["word"].encode(): r["n"] for r in most_frequent(self.words, None, head).collect()}
        self.blocks = max(1, math.ceil(self.tokens / max(1, min(per_block, 8 * segment // FIRST_BITS))))
        answered = portions.mapInArrow(_sent(self.blocks), _BLOBS).groupBy("block").applyInArrow(
            _answered(self.blocks), "portion long, block int, size long, alone boolean, levels binary, held array<long>, sums array<double>"
        )
        made = staged(answered, "ngrams-levels")
        self.levels = made.where(F.col("portion").isNotNull()).select("portion", "block", "size", "alone", "levels")
        stats = made.where(F.col("portion").isNull())
        means = stats.select(F.posexplode(F.arrays_zip("held", "sums")).alias("level", "x")).groupBy("level").agg(F.sum("x.held").alias("n"), F.sum("x.sums").alias("s")).collect()
        self.means = np.zeros(256)  # a false hit beyond the highest level counts as that level
        for r in sorted(means, key=lambda r: r["level"]):
            if r["n"]:
                self.means[r["level"] :] = r["s"] / r["n"]
        self.means[0] = 0


def _words(raw: pa.Scalar) -> list[bytes]:
    """All tokens of a text, its end last."""
    words = [w for part in word_blocks((raw.as_py() or b"").lower()) for w in part]
    words.append(END)
    return words


def probabilities(words: np.ndarray, before: np.ndarray, pairs: np.ndarray, tokens: int, vocabulary: int) -> np.ndarray:
    """log10 probability of each token by the counts that its level, the level of the word before and that of both stand for."""
    alone = np.minimum((words + 0.5) / (tokens + 0.5 * (vocabulary + 1)), 1)
    weight = WEIGHT * before / (before + PRIOR)
    share = np.where(pairs >= PAIRS, np.minimum(pairs, before), 0) / np.maximum(before, 1)
    return np.log10(weight * share + (1 - weight) * alone)


def _outside(shared: Broadcast):
    """(word, portion, at): the words of every portion whose counts are not broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = shared.value[0]
        for batch in batches:
            for row in _rows(batch):
                words = words_in(row)
                at = [i for i, w in enumerate(words) if w not in head]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([words[i] for i in at], pa.binary()).cast(pa.string()), pa.array([row["portion"]] * len(at), pa.int64()), pa.array(at, pa.int32())], names=["word", "portion", "at"]
                )

    return run


def _scorer(shared: Broadcast):
    """The scores of a portion's documents, by the exact counts of its words and the levels of its n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, means, tokens, vocabulary, blocks = shared.value
        below = math.log10(tokens + 0.5 * (vocabulary + 1))
        for batch in batches:
            for row in _rows(batch):
                portion = Portion(row)
                counts = np.fromiter((head.get(w, 0) for w in portion.words), np.float64, len(portion.words))
                for x in row["rest"] or ():
                    counts[x["at"]] = x["n"]
                found = []
                for alone, grams, back in portion.grams():
                    answers = sorted((x["block"], x["size"], x["levels"]) for x in row["answers"] if x["alone"] == alone)
                    levels = np.empty(len(grams), np.uint8)
                    levels[np.argsort(block_of(grams, blocks), kind="stable")] = np.concatenate([unpacked(x, n, "u1") for _, n, x in answers])
                    found.append(means[levels][back])
                words, pairs = found
                starts = np.cumsum(portion.lengths) - portion.lengths
                before = np.r_[words[portion.lengths[0] - 1], words[:-1]]  # the end stands before the first word
                base = np.add.reduceat(np.log10(counts + 0.5)[portion.places], starts) - portion.lengths * below
                known = np.add.reduceat((counts > 0).astype(np.int64)[portion.places], starts)
                score = np.add.reduceat(probabilities(words, before, pairs, tokens, vocabulary), starts)
                made = [pa.array(row["ids"], pa.int64()), pa.array(row["held"], pa.bool_()), *map(pa.array, (portion.lengths, known, base, score))]
                yield pa.RecordBatch.from_arrays(made, names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


def score(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    fold: int = 1,
    per_block: int = PER_BLOCK,
    segment: int = SEGMENT,
    head: int = HEAD,
    portion: int = PORTION,
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), learned outside the fold."""
    held = in_fold(F.col(id_col), fold)
    rows = documents.select(
        F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), (F.col(id_col).isNotNull() & ~held).alias("learned"), F.col(text_col).cast("binary").alias("text")
    )
    portions = staged(rows.mapInArrow(_portions(portion), _PORTIONS).select(F.monotonically_increasing_id().alias("portion"), "*"), "ngrams-portions")
    model = Trained(portions, per_block, segment, head)
    shared = documents.sparkSession.sparkContext.broadcast((model.head, model.means, model.tokens, model.vocabulary, model.blocks))
    answers = model.levels.groupBy("portion").agg(F.collect_list(F.struct("block", "size", "alone", "levels")).alias("answers"))
    made = portions.drop("learned").join(answers, "portion")
    if len(model.head) < model.vocabulary:
        outside = portions.select("portion", "size", "words").mapInArrow(_outside(shared), "word string, portion long, at int").join(model.words, "word")
        made = made.join(outside.groupBy("portion").agg(F.collect_list(F.struct("at", "n")).alias("rest")), "portion", "left")
    else:
        made = made.withColumn("rest", F.lit(None).cast("array<struct<at int, n long>>"))
    scored = made.mapInArrow(_scorer(shared), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
