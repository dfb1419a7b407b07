"""The registered queries of the corpus operators: each runs one operator over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footlog.llm import bpe, infill, langid, linededup, mainhtml, minhash, ngrams, packing, phrases, sharding, simhash, tokencount, topk


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(_documents(spark, sf_dir))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.decode(bpe.encode(_documents(spark, sf_dir)))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.compare_edits(_documents(spark, sf_dir))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup(_documents(spark, sf_dir)).select(
        "doc_id",
        F.size(F.split("text", "\n")).alias("lines_left"),
        "lines_removed",
        F.size("copied_from").alias("sources"),
        F.get("copied_from", F.lit(0)).alias("first_source"),
        F.sha2("text", 256).alias("text_sha256"),
    )


def op5_threshold_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op6_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.score(_documents(spark, sf_dir))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _documents(spark, sf_dir).select("doc_id")
    return sharding.assign(keys, "doc_id").select("doc_id", sharding.slot_of(F.col("doc_id")).alias("slot"), "shard")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_documents(spark, sf_dir))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = simhash.near_duplicates(_documents(spark, sf_dir))
    return classes.select("doc_id", simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def op10_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(_documents(spark, sf_dir)))


def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = mainhtml.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.top_phrases(_documents(spark, sf_dir))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.fill_in_middle(_documents(spark, sf_dir))
    restored = infill.restored(F.col("output"), F.col("form"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256")
    )


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_byte_bpe": op2_byte_bpe,
        "op3_minhash": op3_minhash,
        "op4_line_dedup": op4_line_dedup,
        "op5_threshold_top_k": op5_threshold_top_k,
        "op6_bloom_lm": op6_bloom_lm,
        "op7_sharding": op7_sharding,
        "op8_language_id": op8_language_id,
        "op9_simhash_near_dedup": op9_simhash_near_dedup,
        "op10_best_two_fit": op10_best_two_fit,
        "op11_main_text": op11_main_text,
        "op12_collocations": op12_collocations,
        "op13_fill_in_middle": op13_fill_in_middle,
    }
