"""From raw documents to packed sequences in five stages.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
one's docs.  All but the last return the columns of ``documents``.

Nulls, empty texts, repeated rows and an empty table are treated as the five
operators' docstrings say: documents without text fail the quality rules; of
repeated rows the near-duplicate stage keeps one; an empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from affinis.llm import boosted_quality, decontaminate, line_rules, simhash, vector_pack
from affinis.llm.common import crc_of_id, read_table, unused, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without the boilerplate lines of their host."""
    return line_rules.clean(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more.  The trees are grown on this stage's own
    documents and their labels, the held-out third left aside."""
    scored = boosted_quality.score_documents(
        docs, read_table(spark, sf_dir, "labels"), crc_of_id(F.col("doc_id")) % 3 != 1)
    # equal ids may hold different texts: all rows of an id go by its best score
    k, = unused(docs, "_k")
    good = scored.groupBy("doc_id").agg(F.max("score").alias("s")).where("s >= 0.5").select(F.col("doc_id").alias(k))
    return docs.join(good, F.col("doc_id").cast("long").eqNullSafe(F.col(k)), "left_semi")


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: its smallest doc_id (one
    text of it and one row, should the id repeat or be null)."""
    k, t, n = unused(docs, "_k", "_t", "_n")
    found = written(simhash.near_components(docs), "near-components")
    stays = (found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
             .groupBy("root", F.col("component_id").alias(k)).agg(F.min("text_hash").alias(t)))
    text_hash = F.xxhash64(F.col("text").cast("string"))
    kept = docs.join(stays, F.col("doc_id").cast("long").eqNullSafe(F.col(k)) & (text_hash == F.col(t)), "left_semi")
    one = Window.partitionBy("doc_id", text_hash).orderBy("source", "lang", "n_chars")  # repeated rows
    return kept.withColumn(n, F.row_number().over(one)).where(F.col(n) == 1).select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no more of the benchmark than the rule allows."""
    return decontaminate.remove_documents(docs, read_table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents, each placed in a sequence."""
    return vector_pack.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), "word", end_id=1)


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("simhash_dedup", simhash_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Trees, XXH64 and a tokenizer are beyond SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
