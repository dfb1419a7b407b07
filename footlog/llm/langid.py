"""Language ID by word-first backoff.

Training counts every word of every labelled training text, per language. A word the model knows scores its smoothed log
frequency in each language. A word it does not know backs off to its character n-grams (with marked word ends): the longest
length for which any n-gram is known scores the mean of their log frequencies, then the next shorter, down to single
characters; a word without any known character says nothing. A run of more than ``WORD_CHARS`` letters (scripts without
spaces) is no word of the model: it is judged by its n-grams in pieces of that many characters, each with a vote of its own,
and every n-gram of the run belongs to one piece. A text's score per language is the sum over its words, and the
language with the highest sum wins (ties: the smaller name); its score is the posterior under equal priors.

Counts cover all training texts, and every label is learned. What is broadcast is, per language, the ``words`` most frequent
words and the ``grams`` most frequent n-grams of each length, cut at a count so that ties stay or go together. An item holds
only the languages that kept it, with what they add to the language's log frequency of an item it did not keep; so the model
grows with the kept rows, not with items times languages.

Nulls: a null text, or one without a letter, is `und` with score 0, as is every text if nothing could be learned. Null
labels and null ids take no part in learning; a document with a null id is not held out. Repeated rows count as often as
they stand. Other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footlog.llm.common import BLOCK, Memo, in_fold, most_frequent, row_slices, staged

WORDS, GRAMS, LONGEST = 20_000, 5_000, 4
#: Longer runs of letters are judged by their n-grams, a piece of this length at a time.
WORD_CHARS = 64
_LETTERS = re.compile(r"[^\W\d_]+")
_FLUSH = 200_000
#: Characters of long runs a task holds before it passes its counts on.
_LONG = 8 << 20
#: Cells (words times languages) of the table of words a scorer remembers.
_CELLS = 1 << 23


def words_of(text: str) -> Iterator[list[str]]:
    """Lower-cased runs of letters, a bounded list at a time."""
    start = 0
    while start < len(text):
        end = start + BLOCK
        while end < len(text) and text[end].isalpha():
            end += 1
        yield _LETTERS.findall(text[start:end].lower())
        start = end


def pieces_of(word: str) -> range:
    """Where the pieces of a word start; it has one, unless it is a long run."""
    return range(0, max(1, len(word)), WORD_CHARS)


def grams_of(word: str, n: int, start: int = 0) -> list[str]:
    """The n-grams of a word with marked ends (if n > 1) that start in its piece at ``start``."""
    end = start + WORD_CHARS
    if n == 1:
        return list(word[start:end])
    whole = end >= len(word) or end + n - 2 > len(word)
    piece = (word[start - 1] if start else " ") + (word[start:] + " " if whole else word[start : end + n - 2])
    return [piece[i : i + n] for i in range(len(piece) - n + 1)]


def _counted(frame: DataFrame, expand, names: tuple[str, str, str]) -> DataFrame:
    """Sums of what ``expand`` adds as (kind, item, count), pre-added in every task in bounded portions.

    ``expand`` yields after each portion: the characters of the long runs it added.
    """
    schema = f"{names[0]} string, {names[1]} string, {names[2]} long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held = Counter(), 0

        def out():
            keys = list(total)
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys]), pa.array(list(total.values()))], names=list(names))

        for batch in batches:
            for part in row_slices(batch, "item"):
                for kind, item, count in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    for size in expand(total, kind, item, count):
                        held += size
                        if len(total) > _FLUSH or held > _LONG:
                            yield out()
                            total.clear()
                            held = 0
        if total:
            yield out()

    return frame.mapInArrow(run, schema).groupBy(*names[:2]).agg(F.sum(names[2]).alias(names[2]))


def _add_words(total: Counter, lang: str, text: str, _: int) -> Iterator[int]:
    for words in words_of(text):
        long = 0
        for word, n in Counter(words).items():
            total[lang, word] += n
            if len(word) > WORD_CHARS:
                long += len(word)
        yield long


def _add_grams(longest: int):
    def add(total: Counter, lang: str, word: str, count: int) -> Iterator[int]:
        for start in pieces_of(word):
            for n in range(1, longest + 1):
                for gram in grams_of(word, n, start):
                    total[f"{n}{lang}", gram] += count
            yield 0

    return add


class Model:
    """Log frequencies of words and n-grams in each language; built from bounded rows."""

    def __init__(self, langs: list[str], totals: dict[str, dict[str, int]], rows: dict[str, list[tuple[str, str, int]]]) -> None:
        """totals and rows by level: "" for words, "1" to "4" for n-grams; rows are (lang, item, count)."""
        self.langs, self.logs, self.levels = langs, {}, sorted((x for x in rows if x), reverse=True)
        self.least: dict[str, list[float]] = {}
        at = {lang: i for i, lang in enumerate(langs)}
        for level, items in rows.items():
            below = np.array([totals[level].get(lang, 0) for lang in langs], dtype=float) + 0.5 * (len({item for _, item, _ in items}) + 1)
            self.least[level] = np.log(0.5 / below).tolist()
            logs: dict[str, list] = {}
            for lang, item, n in items:  # language number, what it adds, next language number, ...
                logs.setdefault(item, []).extend((at[lang], math.log(2 * n + 1)))
            self.logs[level] = {item: tuple(x) for item, x in logs.items()}

    def word(self, word: str) -> list[float] | None:
        """The word's log frequency in each language, or the mean of its longest known n-grams'; of a long run the sum over its pieces."""
        if len(word) > WORD_CHARS:
            votes = np.zeros(len(self.langs)), False
            for start in pieces_of(word):
                found = self._backed_off(word, start)
                if found is not None:
                    votes = votes[0] + found, True
            return votes[0].tolist() if votes[1] else None
        found = self.logs[""].get(word)
        return self._mean("", [found]) if found is not None else self._backed_off(word, 0)

    def _mean(self, level: str, known: list[tuple]) -> list[float]:
        """The mean log frequency of known items in each language."""
        out, share = self.least[level][:], 1 / len(known)
        for item in known:
            for i in range(0, len(item), 2):
                out[item[i]] += item[i + 1] * share
        return out

    def _backed_off(self, word: str, start: int) -> list[float] | None:
        for level in self.levels:
            find = self.logs[level].get
            known = [g for x in grams_of(word, int(level), start) if (g := find(x)) is not None]
            if known:
                return self._mean(level, known)
        return None

    def scorer(self):
        """text -> (language, score); remembers the words it has met in a growing, bounded table."""
        width = max(1, len(self.langs))
        most = max(1, min(300_000, _CELLS // width))
        portion = min(1 << 16, most)
        table, size = np.zeros((min(1 << 12, most), width), np.float32), 0

        def place(word: str) -> int:
            nonlocal table, size
            if size == len(table):
                table = np.concatenate([table, np.zeros_like(table)])
            found = self.word(word)
            table[size] = 0 if found is None else found
            size += 1
            return size - 1

        memo = Memo(place, most=1 << 30)

        def score(text: str | None) -> tuple[str, float]:
            nonlocal size
            total, any_word = np.zeros(len(self.langs)), False
            for words in words_of(text or ""):
                any_word = any_word or any(c.isalpha() for w in words for c in w)
                if max(map(len, words), default=0) > WORD_CHARS:  # long runs are not remembered, nor rounded
                    for found in (self.word(w) for w in words if len(w) > WORD_CHARS):
                        total += 0 if found is None else np.array(found)
                    words = [w for w in words if len(w) <= WORD_CHARS]
                for start in range(0, len(words), portion):
                    if size > most:
                        memo.clear()
                        size = 0
                    places = list(map(memo.__getitem__, words[start : start + portion]))
                    total += table[places].sum(axis=0, dtype=np.float64)
            if not any_word or not self.langs:
                return "und", 0.0
            best = int(total.argmax())
            return self.langs[best], float(1 / np.exp(total - total[best]).sum())

        return score


def train(documents: DataFrame, text_col: str = "text", lang_col: str = "lang", words: int = WORDS, grams: int = GRAMS, longest: int = LONGEST) -> Model:
    """A model of all rows with a non-null label."""
    rows = documents.select(F.col(lang_col).alias("kind"), F.col(text_col).alias("item"), F.lit(1).alias("n")).dropna()
    counted = staged(_counted(rows, _add_words, ("lang", "word", "n")), "langid-words")
    of_words = F.length("word") <= WORD_CHARS
    learned = counted.groupBy("lang").agg(F.coalesce(F.sum(F.when(of_words, F.col("n"))), F.lit(0)).alias("words")).collect()
    langs = sorted(r["lang"] for r in learned)
    items = counted.select(F.col("lang").alias("kind"), F.col("word").alias("item"), "n")
    gram_counts = staged(_counted(items, _add_grams(longest), ("level", "gram", "n")), "langid-grams")
    gram_totals = gram_counts.groupBy("level").agg(F.sum("n").alias("n")).collect()
    totals = {"": {r["lang"]: r["words"] for r in learned}} | {str(n): {} for n in range(1, longest + 1)}
    found: dict[str, list] = {level: [] for level in totals}
    for r in gram_totals:
        totals[r["level"][0]][r["level"][1:]] = r["n"]
    for r in most_frequent(counted.where(of_words), "lang", words).collect():
        found[""].append((r["lang"], r["word"], r["n"]))
    for r in most_frequent(gram_counts, "level", grams).collect():
        found[r["level"][0]].append((r["level"][1:], r["gram"], r["n"]))
    return Model(langs, totals, {level: sorted(x) for level, x in found.items()})


def predict(documents: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The frame with lang_pred and score."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        score = shared.value.scorer()
        for part in texts:
            yield pd.DataFrame([score(x) for x in part], columns=["lang_pred", "score"])

    scored = F.pandas_udf(run, "lang_pred string, score double")
    return documents.withColumn("__langid", scored(F.col(text_col))).select("*", "__langid.lang_pred", "__langid.score").drop("__langid")


def identify(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fold: int = 0) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document, learned from those outside the fold."""
    learned = documents.where(F.col(id_col).isNotNull() & ~in_fold(F.col(id_col), fold))
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), in_fold(F.col(id_col), fold).alias("held_out"), F.col(text_col).alias("text"))
    return predict(rows, train(learned, text_col, lang_col)).drop("text")
