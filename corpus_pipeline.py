"""A corpus pipeline of five stages over the operators of tessel.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs. All but the last return the columns of docs, and rows are
kept or left out whole: rejected documents, all but one of equal texts, all but one of each
group of near copies, and documents that hold a benchmark passage go; the rest is encoded.

A decision is about a row, not about an id: where ids repeat or are null, a stage that compares
rows numbers them first, in the order of the ids.

Nulls: the quality stage rejects null and empty texts, as it never draws them; to later stages a null
text is an empty one (one of several stays, and is encoded as no pieces). A null id is below every
other id. Of rows that are equal in id and text one stays. Columns of any other name are
carried along. An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm.benchmark_overlap import without_overlap
from tessel.llm.common import Scratch
from tessel.llm.exact_dedup import exact_dedup
from tessel.llm.importance import importance_sample
from tessel.llm.near_dedup import near_dedup
from tessel.llm.trie_pieces import encode_pieces


def _kept(spark: SparkSession, docs: DataFrame, decide: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Rows of docs that decide(docs, id column) has kept: it returns doc_id and kept."""
    n = docs.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("doc_id").alias("ids")).first()
    rows, key = docs, "doc_id"
    if n["rows"] != n["ids"]:
        key = "row_number"
        while key in (c.lower() for c in docs.columns):
            key += "_"
        ordered = docs.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id")
        rows = Scratch(spark, "rows").table("numbered", ordered.withColumn(key, F.monotonically_increasing_id()))
    kept = decide(rows, key).where("kept").select(F.col("doc_id").alias("kept_"))
    return rows.join(kept, rows[key] == kept["kept_"], "left_semi").select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return importance_sample(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), rows=True)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _kept(spark, docs, lambda rows, key: exact_dedup(spark, rows, key))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _kept(spark, docs, lambda rows, key: near_dedup(spark, rows, key, k=5, share=80))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_overlap(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_pieces(docs)


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("decontaminate", decontaminate), ("encode", encode)]

#: The first stage is a fitted model, which SQL cannot express; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = scratch.table(name, stage(spark, docs, sf_dir))
        if i:
            scratch.drop(STAGES[i - 1][0])
    return docs
