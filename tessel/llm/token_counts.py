"""Token counts: an exact histogram of encoded lengths whose suffix sums answer every context limit.

Each document's number of ids is all that is kept of it; documents are summed by length before
the shuffle. Suffix sums over the histogram (one row for each length that occurs) give, for a limit
L, the documents with at least L ids and the ids left when every text is cut at L:
sum(min(length, L)) = ids of shorter texts + L * documents of length >= L. They are taken in two
steps, within blocks of 1,024 lengths and over the blocks, so no task holds more than a block.

Nulls: a null text is empty and has length 0. Repeated rows count as often. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, slices, tokenizer_path

STEP = 1024


@lru_cache(maxsize=2)
def encoder(name: str):
    """A function from texts to lists of ids, for a .tiktoken or a tokenizers .json file."""
    path = tokenizer_path(name)
    if path.endswith(".tiktoken"):
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [own.encode_ordinary(t or "") for t in texts]
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    return lambda texts: [e.ids for e in whole.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]


def _count(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(name)
        for batch in slices(batches, "text", 1 << 20):
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([len(x) for x in encode(batch.column("text").to_pylist())], pa.int64())], names=["doc_id", "n_tokens"])

    return run


def token_lengths(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and n_tokens of each row."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_count(tokenizer), "doc_id bigint, n_tokens bigint")


def length_histogram(lengths: DataFrame, column: str = "n_tokens") -> DataFrame:
    """See suffix_sums."""
    return suffix_sums(lengths.groupBy(F.col(column).alias("n_tokens")).agg(F.count("*").alias("n_docs")))


def suffix_sums(counted: DataFrame) -> DataFrame:
    """From n_tokens and n_docs, for each length that occurs: n_docs, docs_at_least, docs_at_most, tokens_at_most (ids of texts no longer) and truncated_tokens (ids left when all are cut there)."""
    hist = counted.select("n_tokens", "n_docs").withColumn("tokens", F.col("n_tokens") * F.col("n_docs")).withColumn("block", F.floor(F.col("n_tokens") / STEP))
    blocks = hist.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    after = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()  # a row for each block of lengths
    tails = blocks.select("block", F.sum("d").over(whole).alias("all_docs"), F.sum("t").over(whole).alias("all_tokens"), F.coalesce(F.sum("d").over(after), F.lit(0)).alias("docs_after"), F.coalesce(F.sum("t").over(after), F.lit(0)).alias("tokens_after"))
    suffix = Window.partitionBy("block").orderBy(F.col("n_tokens").desc())
    rows = hist.join(tails, "block")
    least, longer = F.sum("n_docs").over(suffix) + F.col("docs_after"), F.sum("tokens").over(suffix) + F.col("tokens_after")
    rows = rows.select("n_tokens", "n_docs", "tokens", least.alias("docs_at_least"), longer.alias("tokens_at_least"), "all_docs", "all_tokens")
    shorter = F.col("all_tokens") - F.col("tokens_at_least")
    return rows.select(
        "n_tokens", "n_docs", "docs_at_least", (F.col("all_docs") - F.col("docs_at_least") + F.col("n_docs")).alias("docs_at_most"), (shorter + F.col("tokens")).alias("tokens_at_most"), (shorter + F.col("n_tokens") * F.col("docs_at_least")).alias("truncated_tokens")
    )


def truncated_total(histogram: DataFrame, limit: int) -> Column:
    """An aggregate over a histogram: ids left when every text is cut at the limit, whether that length occurs or not."""
    return F.sum(F.least("n_tokens", F.lit(limit)) * F.col("n_docs"))


def quantile(histogram: DataFrame, share: float) -> DataFrame:
    """The smallest length that at least this share of the documents do not exceed, as one row n_tokens."""
    n = F.col("docs_at_most") + F.col("docs_at_least") - F.col("n_docs")
    return histogram.where(F.col("docs_at_most") >= F.lit(share) * n).agg(F.min("n_tokens").alias("n_tokens"))


def token_counts(spark: SparkSession, docs: DataFrame, tokenizer: str = "byte_bpe_50k.tiktoken", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The length histogram of a table's texts with its suffix sums."""
    lengths = token_lengths(docs, tokenizer, id_col, text_col)
    # written once, as the suffix sums read it three times and encoding is dear
    return suffix_sums(Scratch(spark, "counts").table("histogram", lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))))
