"""Small corpora with the hard cases, and brute-force versions of what the operators compute."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EN = "the and of to in is was for that with his they this have from one had word but not".split()
FR = "le la les des et est dans pour que qui sur pas une avec ce il sont nous vous mais".split()


def prose(seed: int, words: int, pool: list[str] = EN, line: int = 12) -> str:
    rng = random.Random(seed)
    made = [rng.choice(pool) + rng.choice(["", "", "ing", "er", "tion"]) + str(rng.randrange(40)) * rng.randrange(2) for _ in range(words)]
    return "\n".join(" ".join(made[i : i + line]) for i in range(0, words, line))


def rows() -> list[tuple]:
    """Texts of every awkward kind; two rows repeat another one whole, two have no id."""
    base = [prose(i, 40 + 13 * i, FR if i % 3 == 0 else EN) for i in range(24)]
    texts: list[str | None] = [*base, base[3], base[3] + " more", base[5].replace("the", "thee", 1)]
    texts += ["", None, " \n\t ", "one", "two words", "1234 5678 !!", "İ漢字🙂 ① x\u001cy", "a" * 3000, prose(99, 6000)]
    shared = prose(500, 60)
    texts += [base[7] + "\n" + shared, base[8] + "\n\n" + shared + "\n" + base[9], "same line again\n" * 80]
    out = [(i * 7, t, ["en", "fr", "en"][i % 3] if i % 11 else None, "s0", len(t) if t is not None else None) for i, t in enumerate(texts)]
    return [*out, out[2], out[27], (None, base[4], "en", None, None), (None, "", None, None, 0)]


def frame(spark: SparkSession, data: list[tuple] | None = None) -> DataFrame:
    return spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(3)


def clashing(documents: DataFrame) -> DataFrame:
    """The same table with extra columns named like results."""
    names = ("fingerprint", "component_id", "ids", "row", "score", "lang_pred", "shard", "n_tokens", "lines_removed", "label", "n", "word", "line", "key", "piece")
    for name in names:
        documents = documents.selectExpr("*", f"'x' as {name}")
    return documents


def plain(documents: DataFrame) -> list[tuple]:
    return [tuple(r) for r in documents.collect()]
