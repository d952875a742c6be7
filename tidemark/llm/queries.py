"""One query for each operator of the subpackage, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import chat_format, decontaminate, html_text, language, near_dedup, packing, periodic_runs, quality, source_mix, suffix_dedup, suffix_tree_lm, topk_search, vector_codes
from tidemark.llm.tables import read


def op1_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_html_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(read(spark, sf_dir, "pages"))


def op3_suffix_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.find_with_passages(read(spark, sf_dir, "documents"))


def op4_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree_lm.score_documents(read(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"))


def op6_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.find(read(spark, sf_dir, "documents"))


def op7_bm25_block_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.search_documents(read(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_documents(read(spark, sf_dir, "documents"))


def op9_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op10_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_chats(read(spark, sf_dir, "conversations"))


def op11_hamerly_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.encode_vectors(read(spark, sf_dir, "embeddings"))


def op12_weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.plan_mix(read(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_digests(read(spark, sf_dir, "documents"))


_ALL = (
    op1_quality_crf,
    op2_html_line_blocks,
    op3_suffix_buckets,
    op4_suffix_tree_scores,
    op5_best_fit_packing,
    op6_lsh_forest,
    op7_bm25_block_max,
    op8_language_id,
    op9_benchmark_leaks,
    op10_chat_snapshots,
    op11_hamerly_codes,
    op12_weighted_mix,
    op13_periodic_runs,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

#: DuckDB SQL for the same rows, where SQL can express them.
SQL: dict[str, str] = {
    "op7_bm25_block_max": topk_search.SQL,
    "op10_chat_snapshots": chat_format.SQL,
    "op11_hamerly_codes": vector_codes.SQL,
    "op12_weighted_mix": source_mix.SQL,
}
