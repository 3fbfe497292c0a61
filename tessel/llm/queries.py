"""The queries of this subpackage: each operator over its whole table, with the columns of its contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .benchmark_overlap import benchmark_overlap
from .exact_dedup import exact_dedup
from .html_text import html_text
from .importance import importance_sample
from .interpolated_lm import interpolated_scores
from .near_dedup import near_dedup
from .pii import personal_data
from .token_counts import token_counts
from .token_file import token_files
from .trie_pieces import piece_ids


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(spark, _read(spark, sf_dir, "documents"), "word_bpe_49k.json", end_id=2)


def op2_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_sample(spark, _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(spark, _read(spark, sf_dir, "documents"), k=4, share=80)


def op4_interpolated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolated_scores(spark, _read(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark, _read(spark, sf_dir, "documents"))


def op6_trie_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_ids(spark, _read(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = benchmark_overlap(spark, _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(spark, _read(spark, sf_dir, "documents")).drop("found")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark, _read(spark, sf_dir, "documents"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text(spark, _read(spark, sf_dir, "pages"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_token_files, op2_importance, op3_near_dedup, op4_interpolated_lm, op5_exact_dedup, op6_trie_pieces, op7_decontaminate, op8_personal_data, op9_token_counts, op10_html_text)}
