"""Registered queries of the corpus operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglens.llm import (attention_lm, bitmask_langid, cap_join, chunk_bpe, dart_minhash, fertility, host_rank, pair_bitmaps,
                         pii_bootstrap, preference, prefix_trie, site_quality, tier_packing)
from loglens.llm.common import table


def op1_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    judged = site_quality.judge(docs, table(spark, sf_dir, "labels"), keep=["doc_id"])
    return judged.select("row.doc_id", "host", "path", "p_quality", "p_toxic", "p_site", "posterior", "kept")


def op2_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_bootstrap.digest(pii_bootstrap.find(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"]))


def op3_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return preference.format_pairs(preference.neighbours(turns))


def op4_cap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cap_join.near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def op5_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = fertility.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), keep=["doc_id"])
    return judged.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept", *fertility.MEASURES)


def op6_chunk_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return chunk_bpe.encode(docs, keep=["doc_id"], finish=chunk_bpe.FinishDigest).select(
        "row.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op7_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = dart_minhash.near_groups(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return groups.select("row.doc_id", F.col("component").alias("group_id"), "n_copies", "kept")


def op8_host_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = host_rank.judge(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op9_bitmask_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = bitmask_langid.held_out(F.col("doc_id"))
    filters = bitmask_langid.learn(docs.where(F.col("doc_id").isNotNull() & ~held_out).select("text", "lang"))
    marked = docs.select("doc_id", held_out.alias("held_out"), "text")
    return bitmask_langid.predict(marked, filters, keep=["doc_id", "held_out"]).select("row.*", "lang_pred", "score")


def op10_tier_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tier_packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = attention_lm.held_out(F.col("doc_id"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", out.alias("held_out"))
    scored = attention_lm.score(docs, F.col("doc_id").isNotNull() & ~F.col("held_out"), keep=["doc_id", "held_out"])
    return scored.select(F.col("row.doc_id").cast("bigint").alias("doc_id"), "row.held_out", "n_tokens", "n_known", "train_tokens",
                         "base_score", "score")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


def op13_pair_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = pair_bitmaps.align(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return aligned.select(F.col("row.doc_id").cast("bigint").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best",
                          "count_sum", "groups_sha256")


QUERIES = {
    "op1_site_quality": op1_site_quality,
    "op2_pii_bootstrap": op2_pii_bootstrap,
    "op3_preference": op3_preference,
    "op4_cap_join": op4_cap_join,
    "op5_fertility": op5_fertility,
    "op6_chunk_bpe": op6_chunk_bpe,
    "op7_dart_minhash": op7_dart_minhash,
    "op8_host_rank": op8_host_rank,
    "op9_bitmask_langid": op9_bitmask_langid,
    "op10_tier_packing": op10_tier_packing,
    "op11_attention_lm": op11_attention_lm,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_pair_bitmaps": op13_pair_bitmaps,
}

ORACLE = {
    "op3_preference": preference.oracle(),
    "op12_prefix_trie": prefix_trie.oracle(),
}
