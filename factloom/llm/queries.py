"""The queries of the training-data operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from factloom.llm import pii, quality
from factloom.llm.lines import dedup_lines
from factloom.llm.media import media_columns
from factloom.llm.minhash import near_duplicates
from factloom.llm.mixing import copies
from factloom.llm.oracles import ORACLES
from factloom.llm.packing import pack
from factloom.llm.substrings import cut_repeats
from factloom.llm.tokens import read_ids, write_ids
from factloom.llm.urls import filter_urls
from factloom.operators.staging import Staging

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(_read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), "kept")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.pseudonymise(_read(spark, sf_dir, "documents"), key="demonstration key")
    return found.select(F.col("id").alias("doc_id"), "text", "n_values", "kinds")


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cut_repeats(_read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(_read(spark, sf_dir, "pages"), _read(spark, sf_dir, "labels")).drop("poor_bound")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_read(spark, sf_dir, "documents"), TOKENIZER)


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(_read(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality.fit(docs, _read(spark, sf_dir, "labels"))
    return quality.judge(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "text", "n_lines", "n_removed")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = copies(_read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


def op10_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, st = _read(spark, sf_dir, "documents"), Staging(spark, "tokens")
    folder = st.folder("ids")
    return read_ids(docs, folder, write_ids(docs, folder, TOKENIZER, 2, st))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return ORACLES
