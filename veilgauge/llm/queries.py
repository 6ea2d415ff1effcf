"""The registered queries of this subpackage and, where SQL can say the same, their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgauge.llm import (
    chat, decontaminate, filter_audit, knn, line_dedup, minhash_dedup, mixing, prefix_trie, quality, quality_rules, sharding, substring_dedup, toxicity,
)
from veilgauge.llm.common import parquet


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.resample(parquet(spark, sf_dir, "documents"), parquet(spark, sf_dir, "labels"))
    return found.select("doc_id", "log_ratio", "noisy", "kept")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(parquet(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op3_top_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.top_scores(parquet(spark, sf_dir, "embeddings")).select("query_id", "rank", "vec_id", "score")


ODD_TEXT = r"\### Assistant: </turn> ok"


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parquet(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.createDataFrame([(-7, 0, "user", ODD_TEXT), (-7, 1, "assistant", ODD_TEXT)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_conversations(rows.unionByName(odd)))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.score(parquet(spark, sf_dir, "documents"), parquet(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash_dedup.near_duplicates(parquet(spark, sf_dir, "documents"), k=4, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = parquet(spark, sf_dir, "documents")
    kept = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(parquet(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.assign_shards(parquet(spark, sf_dir, "documents"), shards=16)
    return found.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contained_items(parquet(spark, sf_dir, "documents"), parquet(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_item", "n_shared")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(parquet(spark, sf_dir, "documents"), parquet(spark, sf_dir, "labels"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.turn_lists(parquet(spark, sf_dir, "conversations"))
    return prefix_trie.nodes(prefix_trie.build(prefix_trie.with_shared_heads(turns))).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.verdicts(parquet(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_quality, op2_substring_dedup, op3_top_scores, op4_chat_format, op5_toxicity,
        op6_minhash_dedup, op7_line_dedup, op8_mix_sources, op9_shard, op10_decontaminate, op11_filter_audit,
        op12_prefix_trie, op13_quality_rules,
    )}
