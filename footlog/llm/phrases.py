"""Phrase collocation mining: n-gram counts by HAT-tries in the tasks, merged runs, exact scores on Spark.

Counting takes one pass per level: words, pairs, and windows of three and more words. In a pass every task keeps a trie per
language: the root leads from a word's id to a hash container of the words after it, and a container that grows too large
bursts into containers by its second word. A trie beyond its budget spills whole subtrees, largest first, as sorted runs of
(phrase, count); Spark deals the runs by phrase and merges the counts. A phrase cannot be frequent unless its parts are, so
later passes skip windows over parts that a Bloom filter of the frequent ones rules out. The filter has a fixed size; its
false positives only cost time, as every count is exact and compared with the threshold after merging.

Scores, the dropping of phrases inside longer ones and the ranking are joins and groupings of the frequent phrases. What a
join looks up is a phrase's part; parts are salted, since one word may start or end a great share of all phrases.

Nulls: a null text is empty, a null language ``und``; ids are not read. Repeated rows count each time. Ties in rank go by
phrase, so results repeat. Very long texts are read in portions that carry the last words over, and a word is never cut.
An empty table, or one without a frequent phrase, gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from footlog.llm.common import row_slices, staged

#: Bytes between which words of a phrase never stand; they end a piece. Words are separated by space and tab.
_PIECE_END = b".,;:!?\n\x0b\x0c\r"
_PLAIN = bytes.maketrans(_PIECE_END + b"\t", b"\n" * len(_PIECE_END) + b" ")
_GAP = re.compile(rb"[\x20\x09.,;:!?\x0A-\x0D]")
#: Bits of the filter of frequent parts, as a power of two; 8 MB at any size of the input.
FILTER_BITS = 26
#: Bits of a word's id within a task; three ids make the key of a container.
_ID = 21
#: Bytes of text that a task looks at together.
PORTION = 2 << 20
#: Words and their bytes, and windows, that a task's trie holds before it spills.
MOST_WORDS, MOST_BYTES, MOST_WINDOWS = 1 << 19, 64 << 20, 1_000_000
#: Windows in one container before it bursts.
BURST = 4096
#: Copies of each part that joins look up, so that a frequent part is met in many tasks.
SALTS = 16
#: Runs are dealt by first word to so many places; a word that makes up more than one in COMMON of all words has COMMON_PARTS.
PLACES, COMMON, COMMON_PARTS = 1 << 20, 1000, 64
RUN = "lang string, phrase string, n long"


def _word_hash(lang: bytes, word: bytes) -> int:
    return xxhash.xxh64_intdigest(lang + b"\t" + word)


def _pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    mixed = first * np.uint64(0x9E3779B97F4A7C15) + ((second << np.uint64(31)) | (second >> np.uint64(33)))
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return mixed ^ (mixed >> np.uint64(32))


def _probes(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Three places in the filter for each hash."""
    mask = np.uint64((1 << bits) - 1)
    return np.stack([(hashes >> np.uint64(shift)) & mask for shift in (0, 19, 38)])


def _in_filter(held: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    places = _probes(hashes, int(held.size * 64).bit_length() - 1)
    return ((held[places >> np.uint64(6)] >> (places & np.uint64(63))) & np.uint64(1)).all(axis=0)


def part_filter(frequent: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """The Bloom filter of the frequent words or pairs (lang, phrase): 2 ** bits bits, as 64-bit words."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << (bits - 6), np.uint64)
        for batch in batches:
            rows = zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist(), strict=True)
            hashes = [[_word_hash(a.encode(), w) for w in b.encode().split(b" ")] for a, b in rows]
            if hashes:
                parts = np.array(hashes, np.uint64).T
                at = _probes(parts[0] if len(parts) == 1 else _pair_hash(*parts), bits).ravel()
                np.bitwise_or.at(held, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))
        used = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(held[used].view(np.int64))], names=["place", "held"])

    words = frequent.mapInArrow(places, "place int, held long").groupBy("place").agg(F.bit_or("held").alias("held")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[words.column("place").to_numpy()] = words.column("held").to_numpy().view(np.uint64)
    return out


class Trie:
    """Windows of a language's words with their counts; ``rest`` packs the ids after the first, zero for no word."""

    def __init__(self) -> None:
        self.ids: dict[bytes, int] = {b"": 0}  # zero for a word that no frequent phrase holds
        self.words, self.hashes, self.bytes, self.size = [b""], array("Q", [0]), 0, 0  # hashes only where links are looked up
        self.root: dict[int, dict] = {}  # first id: container, or after a burst {second id: container}
        self.burst: set[int] = set()

    def add(self, first: np.ndarray, rest: np.ndarray) -> None:
        if not len(first):
            return
        order = np.lexsort((rest, first))
        first, rest = first[order], rest[order]
        starts = np.flatnonzero(np.r_[True, (first[1:] != first[:-1]) | (rest[1:] != rest[:-1])])
        times = np.diff(np.r_[starts, len(first)]).tolist()
        root, burst, second = self.root, self.burst, 2 * _ID
        for one, more, n in zip(first[starts].tolist(), rest[starts].tolist(), times, strict=True):
            held = root.get(one)
            if held is None:
                held = root[one] = {}
            if one in burst:
                held = held.setdefault(more >> second, {})
            before = held.get(more)
            if before is None:
                held[more] = n
                self.size += 1
                if len(held) > BURST and one not in burst:
                    root[one] = split = {}
                    for key, value in held.items():
                        split.setdefault(key >> second, {})[key] = value
                    burst.add(one)
            else:
                held[more] = before + n

    def subtree(self, one: int) -> dict[int, int]:
        held = self.root.pop(one)
        if one in self.burst:
            self.burst.discard(one)
            held = {key: n for part in held.values() for key, n in part.items()}
        self.size -= len(held)
        return held

    def spill(self, lang: str, low: int, high: int, down_to: int = 0) -> Iterator[pa.RecordBatch]:
        """Whole subtrees, the largest first, as sorted runs of phrases of ``low`` to ``high`` words."""
        sizes = {one: sum(map(len, held.values())) if one in self.burst else len(held) for one, held in self.root.items()}
        words = pa.array(self.words, pa.binary())
        by_bytes = pc.sort_indices(words)
        rank = np.empty(len(words), np.int64)  # runs are sorted by their words' bytes; the empty word stays first
        rank[by_bytes.to_numpy()] = np.arange(len(words))
        ranked, waiting, held = words.take(by_bytes), [], 0
        for one in sorted(sizes, key=sizes.__getitem__, reverse=True):
            if self.size <= down_to:
                break
            waiting.append((one, self.subtree(one)))
            held += len(waiting[-1][1])
            if held >= 100_000:
                yield from self._runs(waiting, rank, ranked, lang, low, high)
                waiting, held = [], 0
        if waiting:
            yield from self._runs(waiting, rank, ranked, lang, low, high)

    def _runs(self, parts: list[tuple[int, dict]], rank: np.ndarray, ranked: pa.Array, lang: str, low: int, high: int) -> Iterator[pa.RecordBatch]:
        first = rank[np.repeat([one for one, _ in parts], [len(held) for _, held in parts])]
        keys = np.concatenate([np.fromiter(held.keys(), np.int64, len(held)) for _, held in parts])
        n = np.concatenate([np.fromiter(held.values(), np.int64, len(held)) for _, held in parts])
        mask = (1 << _ID) - 1
        ids = [first, *(rank[keys >> _ID * (2 - i) & mask] for i in range(high - 1))]
        order = np.lexsort(ids[::-1])
        ids, n = [x[order] for x in ids], n[order]
        for size in range(low, high + 1):
            here = np.flatnonzero(ids[size - 1])
            if not len(here):
                continue
            mine = [x[here] for x in ids[:size]]
            new = np.zeros(len(here), bool)
            new[0] = True
            for x in mine:
                new[1:] |= x[1:] != x[:-1]
            starts = np.flatnonzero(new)
            sums = np.add.reduceat(n[here], starts)
            columns = [ranked.take(pa.array(x[starts])) for x in mine]
            for at in range(0, len(starts), 50_000):
                piece = [c.slice(at, 50_000) for c in columns]
                phrase = pc.binary_join_element_wise(*piece, b" ") if size > 1 else piece[0]
                yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(phrase)), phrase.cast(pa.string()), pa.array(sums[at : at + 50_000])], names=["lang", "phrase", "n"])


def _portions(texts: list[bytes]) -> Iterator[tuple[bytes, bool]]:
    """Whole texts joined by line breaks, or portions of one that is too long, and whether its words go on after them."""
    short = [t for t in texts if len(t) <= PORTION]
    if short:
        yield b"\n".join(short), False
    for text in texts:
        start = 0
        while len(text) > PORTION and start < len(text):
            cut = _GAP.search(text, min(start + PORTION, len(text)))
            end = cut.end() if cut else len(text)
            yield text[start:end], end < len(text)
            start = end


def _words(portion: bytes) -> tuple[pa.DictionaryArray, np.ndarray, int]:
    """The words of a portion, their places in its stream of words and piece ends, and the length of that stream."""
    raw = np.frombuffer(portion.lower().translate(_PLAIN), np.uint8)
    ending, inside = raw == 0x0A, np.zeros(len(raw) + 2, bool)
    inside[1:-1] = (raw != 0x20) & ~ending
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, stops = edges[::2], edges[1::2]
    offsets = np.r_[0, np.cumsum(stops - starts)].astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside[1:-1]])])
    ended = np.searchsorted(np.flatnonzero(ending), np.r_[starts, len(raw)])  # piece ends before each word, and before the end
    new_piece = np.diff(ended, prepend=0) > 0  # before each word, and after the last
    places = np.arange(len(starts) + 1) + np.cumsum(new_piece)
    return words.dictionary_encode(), places[:-1], int(places[-1])


def counted(texts: DataFrame, low: int, high: int, parts=None, links: bool = False) -> DataFrame:
    """Sorted runs (lang, phrase, n) with the counts of all phrases of ``low`` to ``high`` words, for ``merged``; with low = 1
    also each language's number of words, as phrase ''. ``parts`` is a broadcast filter of frequent words, or with ``links``
    of frequent pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries: dict[str, Trie] = {}
        totals: dict[str, int] = {}

        def known(trie: Trie, lang: bytes, distinct: list[bytes]) -> np.ndarray:
            new = [w for w in distinct if w not in trie.ids]
            hashes = [_word_hash(lang, w) for w in new] if parts else [0] * len(new)
            kept = _in_filter(parts.value, np.array(hashes, np.uint64)).tolist() if parts and not links else [True] * len(new)
            for word, value, keep in zip(new, hashes, kept, strict=True):
                trie.bytes += len(word)
                trie.ids[word] = len(trie.words) if keep else 0
                if keep:
                    trie.words.append(word)
                    if links:
                        trie.hashes.append(value)
            return np.fromiter(map(trie.ids.__getitem__, distinct), np.int64, len(distinct))

        def take(trie: Trie, stream: np.ndarray, until: int) -> None:
            """Count the windows that start before ``until`` in a stream of ids."""
            padded = np.r_[stream, np.zeros(high, np.int64)]
            follows = padded[1:] > 0  # whether the word at a place may be followed by the next one
            if links:
                hashes = np.array(trie.hashes)[padded]
                follows &= _in_filter(parts.value, _pair_hash(hashes[:-1], hashes[1:]))
            going = good = padded[:until] > 0
            rest = np.zeros(until, np.int64)
            for i in range(1, high):
                going = going & follows[i - 1 : i - 1 + until]
                rest |= np.where(going, padded[i : i + until] << _ID * (3 - i), 0)
                good = going if i < low else good
            trie.add(padded[:until][good], rest[good])

        for batch in batches:
            for part in row_slices(batch, "text", PORTION):
                langs = part.column("lang")
                for lang in pc.unique(langs).to_pylist():
                    texts = [t.as_py() for t in part.column("text").filter(pc.equal(langs, lang))]
                    carried = np.zeros(0, np.int64)
                    for portion, more in _portions(texts):
                        trie = tries.setdefault(lang, Trie())
                        coded, places, length = _words(portion)
                        totals[lang] = totals.get(lang, 0) + len(coded)
                        stream = np.zeros(length, np.int64)
                        stream[places] = known(trie, lang.encode(), coded.dictionary.to_pylist())[coded.indices.to_numpy()]
                        stream = np.r_[carried, stream]
                        until = max(0, len(stream) - high + 1) if more else len(stream)
                        take(trie, stream, until)
                        carried = stream[until:]
                        if sum(len(t.ids) for t in tries.values()) > MOST_WORDS or sum(t.bytes for t in tries.values()) > MOST_BYTES:
                            left = [trie.words[i] for i in carried.tolist()]
                            for name, each in tries.items():
                                yield from each.spill(name, low, high)
                            tries = {lang: Trie()}
                            carried = known(tries[lang], lang.encode(), left)
                        elif sum(t.size for t in tries.values()) > MOST_WINDOWS:
                            for name, each in tries.items():
                                yield from each.spill(name, low, high, each.size // 4)
        for lang, trie in tries.items():
            yield from trie.spill(lang, low, high)
        if low == 1 and totals:
            names = list(totals)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.repeat("", len(names)), pa.array([totals[x] for x in names])], names=["lang", "phrase", "n"])

    return texts.mapInArrow(run, RUN)


def merged(runs: DataFrame, common: list[str] | None = None) -> DataFrame:
    """Each phrase's count over all runs. Runs are dealt as they come: the tries have added up what a task could, and a second
    table of the same phrases would stand in the executor beside them. With ``common`` words given they are dealt by their first
    word, so that neighbours in a sorted run travel together and shrink; phrases that start with a common word are dealt further."""
    if common is None:
        return runs.repartition("lang", "phrase").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    first = F.substring_index("phrase", " ", 1)
    part = F.when(first.isin(common), F.pmod(F.xxhash64("phrase"), F.lit(COMMON_PARTS))).otherwise(0)
    dealt = runs.withColumn("place", F.pmod(F.xxhash64("lang", first, part), F.lit(PLACES)).cast("int"))
    return dealt.repartition("place").groupBy("place", "lang", "phrase").agg(F.sum("n").alias("n")).drop("place")


def common_words(words: DataFrame) -> list[str]:
    """The words that make up more than one in COMMON of all words of all languages: fewer than COMMON."""
    total = words.where("phrase = ''").agg(F.sum("n")).first()[0] or 0
    return [r["phrase"] for r in words.where("phrase <> ''").groupBy("phrase").agg(F.sum("n").alias("n")).where(F.col("n") > total // COMMON).collect()]


def frequent_phrases(documents: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 30, longest: int = 4) -> DataFrame:
    """(lang, phrase, words, n): every phrase of 1 to ``longest`` (2 to 4) words with at least ``least`` occurrences, and
    each language's number of words as the phrase of 0 words."""
    spark = documents.sparkSession
    texts = documents.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")
    )
    words = staged(merged(counted(texts, 1, 1)).where((F.col("n") >= least) | (F.col("phrase") == "")), "phrase-words")
    found = [words.withColumn("words", F.when(F.col("phrase") == "", 0).otherwise(1))]
    parts, common = words.where("phrase <> ''"), common_words(words)
    for low, high in [(2, 2), (3, longest)][: longest - 1]:
        held = spark.sparkContext.broadcast(part_filter(parts))
        parts = staged(merged(counted(texts, low, high, held, links=low > 2), common).where(F.col("n") >= least), f"phrase-{low}")
        held.destroy()
        found.append(parts.withColumn("words", F.size(F.split("phrase", " "))))
    together = found[0]
    for more in found[1:]:
        together = together.union(more)
    return together.select("lang", "phrase", F.col("words").cast("int").alias("words"), "n")


def _looked_up(wanted: DataFrame, found: DataFrame, key: str, out: str) -> DataFrame:
    """``wanted`` with the count of the phrase in its column ``key``; the found phrases are repeated once per salt. Spark sizes
    them as if they were not repeated, and stored phrases by their compressed files, so the join is never left to that size."""
    parts = found.where("words > 0").select(F.col("lang"), F.col("phrase").alias(key), F.col("n").alias(out), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    dealt = wanted.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int"))
    return dealt.join(parts.hint("merge"), ["lang", key, "salt"]).drop("salt")


def _joined(words: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def collocations(found: DataFrame, share: int = 80) -> DataFrame:
    """Scored candidates (lang, phrase, a, l, r, score) from ``frequent_phrases``: each at its lowest-scoring cut,
    without those of whose occurrences ``share`` per cent or more may lie inside one longer candidate."""
    candidates = found.where("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"), F.split("phrase", " ").alias("list"))
    cuts = candidates.select("lang", "phrase", "a", "words", "list", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", _joined(F.col("list"), F.lit(1), F.col("k")).alias("left"), _joined(F.col("list"), F.col("k") + 1, F.col("words") - F.col("k")).alias("right")
    )
    sums = _looked_up(_looked_up(cuts, found, "left", "l"), found, "right", "r")
    wide = "decimal(38,0)"
    score = F.expr(f"cast((cast(2000000 as {wide}) * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0))) as long)")
    best = sums.select("lang", "phrase", F.struct(score.alias("score"), "k", "a", "l", "r").alias("cut")).groupBy("lang", "phrase").agg(F.min("cut").alias("cut"))
    inner = candidates.where("words > 2").select("lang", F.col("a").alias("outer"), "words", "list", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"))
    inner = inner.select("lang", "outer", "list", "size", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("start"))
    around = inner.groupBy("lang", _joined(F.col("list"), F.col("start"), F.col("size")).alias("phrase")).agg(F.max("outer").alias("outer"))
    held = F.expr("cast(outer as decimal(19,0)) * 100 >= cast(cut.a as decimal(19,0))") if share == 1 else F.expr(f"cast(outer as decimal(19,0)) * 100 >= cast(cut.a as decimal(19,0)) * {share}")
    kept = best.join(around.hint("merge"), ["lang", "phrase"], "left").where(F.col("outer").isNull() | ~held)
    return kept.select("lang", "phrase", *[F.col(f"cut.{c}").alias(c) for c in "alr"], "cut.score")


def top_phrases(documents: DataFrame, text_col: str = "text", lang_col: str = "lang", most: int = 2000, least: int = 30, longest: int = 4, share: int = 80) -> DataFrame:
    """Each language's first ``most`` collocations: lang, rank, phrase, a, l, r, n, score."""
    found = frequent_phrases(documents, text_col, lang_col, least, longest)
    scored = collocations(found, share)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))  # each part of a language is cut to its first rows before they meet
    first = scored.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)))
    ranked = first.where(F.col("rank") <= most).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    totals = found.where("words = 0").select("lang", "n")
    return ranked.where(F.col("rank") <= most).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
