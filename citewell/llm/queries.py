"""The registered queries of the operators in this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, chat, decontamination, hmm_lm, ngram_join, packing, secret_ledger, substring_dedup, suffix_automaton, tile_dedup, tokens, toxicity, turn_repair, turn_trie


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(spark, _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, _read(spark, sf_dir, "documents"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_components(spark, _read(spark, sf_dir, "documents"))


def op4_adaptive_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(spark, _read(spark, sf_dir, "embeddings"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(spark, _read(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_ledger.digest(secret_ledger.scan(spark, _read(spark, sf_dir, "documents")))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digest(decontamination.contamination(spark, _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest(chat.format_chats(spark, chat.with_probe(spark, _read(spark, sf_dir, "conversations"))))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.remove_repeats(spark, _read(spark, sf_dir, "documents")))


def reference_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suffix automata of op9's method on a reference of a stated size: the benchmark's texts."""
    docs, benchmark = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")
    return substring_dedup.digest(suffix_automaton.remove_reference_spans(spark, docs, benchmark, size=suffix_automaton.SPAN))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_lm.score(spark, _read(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.digest(*turn_repair.repair(spark, turn_repair.damaged(_read(spark, sf_dir, "conversations"))))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_trie.prefix_trie(spark, _read(spark, sf_dir, "conversations"))


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tile_dedup.near_vectors(spark, _read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_packing": op2_packing,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_adaptive_ann": op4_adaptive_ann,
    "op5_token_counts": op5_token_counts,
    "op6_secret_scan": op6_secret_scan,
    "op7_decontamination": op7_decontamination,
    "op8_chat_format": op8_chat_format,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_embedding_dedup": op13_embedding_dedup,
    "reference_spans": reference_spans,
}

SQL: dict[str, str] = {
    "op3_ngram_jaccard": ngram_join.SQL,
    "op6_secret_scan": secret_ledger.SQL,
    "op7_decontamination": decontamination.SQL,
    "op8_chat_format": chat.SQL,
    "op9_substring_dedup": substring_dedup.SQL,
    "op11_conversation_repair": turn_repair.SQL,
    "op12_conversation_trie": turn_trie.SQL,
    "op13_embedding_dedup": tile_dedup.SQL,
    "reference_spans": suffix_automaton.SQL,
}
