"""What the operators of this subpackage share: tables in the shared folder and Arrow text batches."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and every executor reach: spark.checkpoint.dir.

    Only a local master may go without the setting (tests); elsewhere a machine-local
    folder would lose rows, so its absence is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.conf.set("spark.checkpoint.dir", found := tempfile.mkdtemp(prefix="tessel-"))
    return found


@contextmanager
def dropped_shuffles(spark: SparkSession):
    """Shuffle files of what is written inside go as soon as it is written."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


class Scratch:
    """Intermediate tables of one operator call, each written once and read again.

    A written table cuts the lineage, survives lost executors (Spark's committer) and
    is small beside the input. `drop` removes the ones that no later step reads; those
    that the returned DataFrame still reads stay in the shared folder until `close`.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.made = spark, f"{shared_dir(spark)}/tessel-{name}-{uuid.uuid4().hex}", []

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, name: str, df: DataFrame) -> DataFrame:
        with dropped_shuffles(self.spark):
            df.write.parquet(self.path(name))
        self.made.append(name)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def close(self) -> None:
        """Removes all tables of the call; nothing may read them any more."""
        self.drop("")

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            at = jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offsets of its rows; null has no bytes."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    n, width = len(col), np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = col.buffers()
    offs = np.frombuffer(offsets, width)[col.offset : col.offset + n + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, offs - offs[0]


def runs(offs: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes (or one row, if that alone has more)."""
    at, n = 0, len(offs) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
        yield at, min(to, n)
        at = to


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most so many bytes of text (or one row)."""
    for batch in batches:
        _, offs = utf8(batch.column(column))
        for a, b in runs(offs, most):
            yield batch.slice(a, b - a)


class WordIds:
    """Ids of words as a vocabulary's own encoder gives them, which sees each distinct word once while the table holds it.

    The table is emptied at `most` words, so a worker's memory stays bounded.
    """

    def __init__(self, encode_words: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int = 600_000):
        self.encode_words, self.most = encode_words, most
        self._clear()

    def _clear(self) -> None:
        self.words = pa.array([], pa.string())
        self.begin, self.count, self.flat, self.used = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32), np.zeros(1 << 14, np.int32), 0

    def _learn(self, fresh: pa.Array) -> None:
        flat, count = self.encode_words(fresh.to_pylist())
        n, m = len(self.words), len(self.words) + len(fresh)
        if m > len(self.begin):
            self.begin, self.count = (np.concatenate([x, np.zeros(max(m, len(x)), x.dtype)]) for x in (self.begin, self.count))
        if self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(flat), len(self.flat)), np.int32)])
        self.flat[self.used : self.used + len(flat)] = flat
        self.count[n:m], self.begin[n:m] = count, self.used + np.cumsum(count) - count
        self.used += len(flat)
        self.words = pa.concat_arrays([self.words, fresh])

    def of(self, words: pa.Array, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of rows of words, and the number of each row's ids; offs: where each row's words begin (one more than rows)."""
        if not len(words):
            return np.zeros(0, np.int32), np.zeros(len(offs) - 1, np.int64)
        coded = words.dictionary_encode()
        own = coded.dictionary.cast(pa.string())
        if len(self.words) + len(own) > self.most:
            self._clear()
        slot = pc.index_in(own, value_set=self.words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(slot < 0)
        if len(new):
            slot[new] = len(self.words) + np.arange(len(new))
            self._learn(own.take(pa.array(new)))
        slot = slot[coded.indices.to_numpy(zero_copy_only=False)]
        count = self.count[slot].astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(count)])
        return self.flat[np.repeat(self.begin[slot] - ends[:-1], count) + np.arange(ends[-1])], np.diff(ends[offs])


def input_bytes(docs: DataFrame) -> int:
    """What the optimizer takes a plan's size to be: of tables that are read, the bytes of their files; 0 if it is not known."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 56 else 0


def tasks_for(spark: SparkSession, docs: DataFrame, each: int, most: int = 1 << 17) -> int:
    """Tasks of about `each` bytes of files, and not fewer than the shuffle partitions."""
    return max(partitions(spark), min(most, -(-input_bytes(docs) // each)))


def binary(chunks: list[bytes]) -> pa.Array:
    return pa.array(chunks, pa.binary())


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and the length of each row."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values, kind))


def tokenizer_path(name: str) -> str:
    """A vocabulary file: a path as it stands, or the name of one of the installed public files."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)
