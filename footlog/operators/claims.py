"""Claim check (E80): every number in a sentence must have been measured, over whole tables of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footlog.functions.stages import staged
from footlog.functions.values import round_to

# Wording that turns a coincidence into a cause, and where it counts.
CAUSAL = [
    "caused", "causes", "caused by", "led to", "resulted in", "broke", "due to", "because of", "thanks to",
    "responsible for",
]
CONTEXT = ["commit", "deploy", "theme", "release", "version", "rollout"]
# What carries digits without claiming anything: citations, dates, times, paths.
NOT_CLAIMS = [
    r"(?i)\[(?:e\d+(?:\s*,\s*e\d+)*)\]",
    r"\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2})?)?",
    r"\b\d{1,2}:\d{2}\b",
    r"""(?:https?://)?/[^\s"'<>,;]*""",
]
# What a number looks like, and where a sentence ends.
NUMBER = r"(?<![\p{L}\d_-])[+-]?\d[\d.,]*"
SENTENCE_END = r"\n+|(?<=[.!?…])\s+"


def sentences(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row per sentence, numbered in order."""
    split = texts.select(*keys, F.posexplode(F.split(text, SENTENCE_END)).alias("sentence_no", "sentence"))
    trimmed = split.withColumn("sentence", F.regexp_replace("sentence", r"^\s+|\s+$", ""))
    return trimmed.where(F.col("sentence") != "")


def numbers_in(rows: DataFrame) -> DataFrame:
    """Add ``numbers``: per number its text and the values it may stand for.

    ``1.234`` is a fraction to some readers and a thousand to others, so both readings count.
    """
    cleaned = F.col("sentence")
    for pattern in NOT_CLAIMS:
        cleaned = F.regexp_replace(cleaned, pattern, " ")
    found = F.regexp_extract_all(cleaned, F.lit(NUMBER), F.lit(0))
    return staged(
        rows.withColumn("_found", F.transform(found, lambda t: F.regexp_replace(t, r"[.,]+$", ""))),
        {
            "_parts": """transform(filter(_found, t -> t NOT IN ('', '+', '-')), t -> named_struct(
              'raw', t, 'sign', CASE WHEN startswith(t, '-') THEN -1D ELSE 1D END, 'body', regexp_replace(t, '^[+-]', '')))"""
        },
        {
            "_read": r"""transform(_parts, p -> named_struct('raw', p.raw, 'sign', p.sign,
              'grouped', try_cast(regexp_replace(p.body, '[.,]', '') as double),
              'decimal', try_cast(CASE
                WHEN contains(p.body, '.') AND contains(p.body, ',') THEN
                  CASE WHEN p.body rlike r',[^.]*$' THEN regexp_replace(replace(p.body, '.', ''), ',', '.') ELSE replace(p.body, ',', '') END
                ELSE replace(p.body, ',', '.') END as double),
              'both', contains(p.body, '.') AND contains(p.body, ','),
              'one', contains(p.body, '.') OR contains(p.body, ','),
              'after', length(substring_index(replace(p.body, ',', '.'), '.', -1))))"""
        },
        {
            "numbers": """filter(transform(_read, r -> named_struct('raw', r.raw, 'values', array_compact(array(
              r.sign * r.decimal, CASE WHEN r.one AND NOT r.both AND r.after = 3 THEN r.sign * r.grouped END)))), n -> size(n.values) > 0)"""
        },
    ).drop("_found", "_parts", "_read")


def allowed_numbers(measured: DataFrame, keys: list[str]) -> DataFrame:
    """The measured values as prose may show them: absolute, and rounded to 0, 1 or 2 places."""
    value = F.col("value").cast("double")
    shapes = [v for base in (value, F.abs(value)) for v in (base, *[round_to(base, d) for d in (0, 1, 2)])]
    return measured.where(F.col("value").isNotNull()).select(*keys, F.explode(F.array(*shapes)).alias("value")).distinct()


def causal_in(sentence: Column) -> Column:
    low = F.lower(sentence)

    def any_of(words: list[str]) -> Column:
        found = F.lit(False)
        for word in words:
            found = found | low.contains(word)
        return found

    return any_of(CONTEXT) & any_of(CAUSAL)


def check_claims(
    texts: DataFrame,
    measured: DataFrame,
    keys: list[str],
    bundle_keys: list[str],
    strict_causality: bool = True,
    staging: str | None = None,
) -> DataFrame:
    """Every sentence with ``dropped``, the unsupported ``numbers`` and whether it claims a cause.

    ``measured`` holds (bundle_keys, value); 0 and 100 are always allowed. Equal candidate values of a bundle are
    looked up once: texts repeat the same few numbers, and the hottest number must not become one task. Sentences are
    read three times; with ``staging``, a folder all executors share, they are split and parsed once and written there.
    """
    rows = numbers_in(sentences(texts, keys))
    if staging is not None:
        rows.write.mode("overwrite").parquet(staging)
        rows = texts.sparkSession.read.schema(rows.schema).parquet(staging)
    claims = rows.select(*keys, "sentence_no", F.explode("numbers").alias("n"))
    each = claims.select(*keys, "sentence_no", F.col("n.raw").alias("raw"), F.explode("n.values").alias("value"))
    asked = each.select(*bundle_keys, "value").distinct()
    free = F.col("value").isin(0.0, 100.0)
    refused = asked.where(~free).join(allowed_numbers(measured, bundle_keys), [*bundle_keys, "value"], "left_anti")
    told = each.join(refused.withColumn("_bad", F.lit(True)), [*bundle_keys, "value"], "left")
    # A number is unsupported when none of its readings was measured.
    judged = told.groupBy(*keys, "sentence_no", "raw").agg(F.min(F.coalesce("_bad", F.lit(False))).alias("bad"))
    bad = judged.where("bad").groupBy(*keys, "sentence_no").agg(F.array_join(F.sort_array(F.collect_set("raw")), ", ").alias("numbers"))
    out = rows.drop("numbers").join(bad, [*keys, "sentence_no"], "left")
    causal = causal_in(F.col("sentence"))
    dropped = F.col("numbers").isNotNull() | (causal & F.lit(strict_causality))
    return out.select(
        *keys, "sentence_no", "sentence", dropped.alias("dropped"), F.coalesce("numbers", F.lit("")).alias("numbers"), causal.alias("causal")
    )
