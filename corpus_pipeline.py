"""A training corpus in five stages, each written as Parquet and read again as the next one's documents.

quality rules -> line dedup -> near-duplicate documents -> mixing sources -> best-fit packing
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from factloom.llm import quality
from factloom.llm.lines import dedup_lines
from factloom.llm.minhash import near_duplicates
from factloom.llm.mixing import WORD, mix
from factloom.llm.packing import pack
from factloom.operators.staging import Staging

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and every learned rule. Null, empty and short texts go; rows that repeat an id, or
    have none, are judged each by its text; without labels the base rule alone decides."""
    rules = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.accepted(docs, rules)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One occurrence of each group of like lines; documents left without a word go. Rows that repeat an id lose only what
    stands elsewhere too; rows without id stay whole. ``n_chars``, where there is one, follows the text."""
    cut = dedup_lines(docs, counts=False).where(F.col("text").rlike(WORD))
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns) if "n_chars" in docs.columns else cut


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, all rows of its id; a document without id stays."""
    found = near_duplicates(docs.select("doc_id", "text")).where("kept").select(F.col("id").alias("kept_id")).distinct()
    names = docs.columns
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])
    kept = inner.join(found, F.col(f"c{names.index('doc_id')}").eqNullSafe(F.col("kept_id")), "left_semi")
    return kept.toDF(*names)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; a null source is a source of its own."""
    return mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences; copies of a document are packed each for itself."""
    return pack(docs, TOKENIZER)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("mix sources", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can express neither the learned rules nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, st = spark.read.parquet(f"{sf_dir}/documents.parquet"), Staging(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = st.write(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
