"""The queries of the training-data operators: each applies its operator to a
whole table and derives the digest columns of its result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from affinis.llm import (
    bitpack,
    bottomk,
    boosted_quality,
    chat_format,
    decontaminate,
    hard_negatives,
    license_scan,
    line_rules,
    nnpu_toxicity,
    shard_lpt,
    simhash,
    spelling,
    vector_pack,
)
from affinis.llm.common import crc_of_id, read_table


def _scores(scored: DataFrame, held_out: Column) -> DataFrame:
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _spans(mask: str) -> Column:
    return F.array_join(F.transform(mask, lambda s: F.concat_ws(":", s["start"], s["length"])), ",")


def op1_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = chat_format.pairs_from_turns(read_table(spark, sf_dir, "conversations"))
    out = chat_format.format_preferences(pairs)
    return out.withColumns({c: _spans(c) for c in ("chosen_mask", "rejected_mask")})


def op2_lpt_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_lpt.shard_documents(read_table(spark, sf_dir, "documents"), shards=8)


def op3_license_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digest(license_scan.scan_licenses(read_table(spark, sf_dir, "documents")))


def op4_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept_back = crc_of_id(F.col("doc_id")) % 3 == 1
    scored = boosted_quality.score_documents(
        read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), ~kept_back)
    return _scores(scored, kept_back)


def op5_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.judge(read_table(spark, sf_dir, "documents")).select(
        F.col("k").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "n_removed_words")


def op6_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_components(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op7_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitpack.packed_ids(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                              "byte", end_id=2)


def op8_nnpu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept_back = crc_of_id(F.col("doc_id")) % 5 == 0
    scored = nnpu_toxicity.score_documents(
        read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), ~kept_back)
    return _scores(scored, kept_back)


def op9_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_pack.pack_documents(read_table(spark, sf_dir, "documents"),
                                      public_tokenizers.path("word_bpe_49k.json"), "word", end_id=1)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(read_table(spark, sf_dir, "documents").select("doc_id", "text"),
                               read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op11_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_spellings(read_table(spark, sf_dir, "documents"))


def op12_bottomk_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bottomk.near_sets(read_table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine_hard_negatives(vectors.withColumn("label", moved))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_preference_format, op2_lpt_shards, op3_license_notices, op4_quality_trees, op5_line_rules,
        op6_simhash_components, op7_packed_ids, op8_nnpu_toxicity, op9_vector_packing, op10_decontaminate,
        op11_spelling_groups, op12_bottomk_components, op13_hard_negatives, pipeline)}
