"""Exact deduplication by Grace hashing: recursive partitioning to spill files until a table of complete contents fits.

1. Each input task keeps an open-addressing table of the whole texts it has met, at
   most `block_bytes` of them, and writes one row for each distinct text of a block with the
   ids of its copies. A text that fills a third of the table leaves a task once a block.
2. Those rows are dealt by digest. A task that gets more than `memory_bytes` parts them into
   spill files by bits of the digest, again and again, until a part fits; a part whose
   rows all share a digest is read as a stream, since it holds copies of one text.
   The table compares complete contents; equal digests alone join nothing.
   A digest of more than `hot_blocks` rows is reduced in two steps: its rows are first dealt to
   `SALTS` tasks, and one row of each group found there meets those of the other tasks.
3. Each block's row takes its group's result by the row's own number, so the copies of
   one text are spread over as many keys as there were blocks.

Nulls: a null text counts as empty; a null id is a row like any other, and below every
other id. Rows with the same id and text are copies of each other. An empty table gives
no rows; other columns are not read, so their names don't matter.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, slices

BLOCKS = "uid string, sha string, text string, ids array<bigint>"
GROUPS = "uid string, keep_id bigint, group_size bigint, text_sha256 string, rep string"
MEMORY_BYTES = 48 << 20
HOT_BLOCKS, SALTS = 10_000, 256


class ContentTable:
    """Open addressing with linear probing; a slot's fingerprint is checked first, then the complete content."""

    def __init__(self, slots: int = 1024):
        self.slots: list[int] = [-1] * slots
        self.prints: list[int] = []
        self.contents: list[bytes] = []
        self.bytes = 0

    def find(self, fingerprint: int, content: bytes) -> tuple[int, bool]:
        """The content's number in the table, and whether it is new."""
        mask = len(self.slots) - 1
        at = fingerprint & mask
        while (entry := self.slots[at]) >= 0:
            if self.prints[entry] == fingerprint and self.contents[entry] == content:
                return entry, False
            at = (at + 1) & mask
        self.slots[at] = entry = len(self.contents)
        self.prints.append(fingerprint)
        self.contents.append(content)
        self.bytes += len(content) + 200
        if 3 * len(self.contents) > 2 * len(self.slots):
            self._grow()
        return entry, True

    def _grow(self) -> None:
        self.slots = [-1] * (2 * len(self.slots))
        mask = len(self.slots) - 1
        for entry, fingerprint in enumerate(self.prints):
            at = fingerprint & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = entry


def _blocks(block_bytes: int, normalize):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        def new():
            return ContentTable(), [], []

        def out(table, shas, ids):
            base = uuid.uuid4().hex
            for a in range(0, len(shas), 256):
                part = slice(a, a + 256)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f"{base}{a + i}" for i in range(len(shas[part]))]), pa.array(shas[part]), pa.array(table.contents[part], pa.binary()).cast(pa.string()), pa.array(ids[part], pa.list_(pa.int64()))],
                    names=["uid", "sha", "text", "ids"],
                )

        table, shas, ids = new()
        held = 0
        for batch in slices(batches, "text"):
            for text, doc in zip(batch.column("text").to_pylist(), batch.column("id").to_pylist(), strict=True):
                content = (text if normalize is None else normalize(text or "")) if text else ""
                content = content.encode()
                digest = hashlib.sha256(content)
                entry, fresh = table.find(int.from_bytes(digest.digest()[:8], "little"), content)
                if fresh:
                    shas.append(digest.hexdigest())
                    ids.append([])
                ids[entry].append(doc)
                held += 1
                if table.bytes >= block_bytes or held >= 200_000:
                    yield from out(table, shas, ids)
                    table, shas, ids = new()
                    held = 0
        yield from out(table, shas, ids)

    return run


def _larger(a, b):
    return b if a is None else a if b is None else max(a, b)


class _Part:
    """Rows (uid, sha, largest id, copies, content) in memory up to a bound, then in a spill file."""

    def __init__(self, folder: str, bound: int):
        self.folder, self.bound, self.rows, self.bytes, self.file, self.shas = folder, bound, [], 0, None, set()

    def add(self, row: tuple) -> None:
        self.rows.append(row)
        self.bytes += len(row[4]) + 300
        if len(self.shas) < 2:
            self.shas.add(row[1])
        if self.bytes > self.bound:
            self.spill()

    def spill(self) -> None:
        import pickle

        if self.file is None:
            self.file = tempfile.TemporaryFile(dir=self.folder)
        for row in self.rows:
            pickle.dump(row, self.file, protocol=5)
        self.rows, self.bytes = [], 0

    def read(self) -> Iterator[tuple]:
        import pickle

        if self.file is not None:
            self.file.seek(0)
            while True:
                try:
                    yield pickle.load(self.file)
                except EOFError:
                    break
            self.file.close()
        yield from self.rows
        self.rows = []


def grace(rows: Iterator[tuple], memory_bytes: int, fan_out: int = 8, level: int = 0, folder: str | None = None) -> Iterator[list[tuple]]:
    """Groups of equal content: lists of (uid, sha, largest id, copies)."""
    with tempfile.TemporaryDirectory(dir=folder) as at:
        whole = _Part(at, memory_bytes)
        for row in rows:
            whole.add(row)
        if whole.file is None or len(whole.shas) == 1 or level >= 8:
            table, groups = ContentTable(), []
            for uid, sha, largest, copies, content in whole.read():
                entry, fresh = table.find(int(sha[48:], 16), content)
                if fresh:
                    groups.append([])
                groups[entry].append((uid, sha, largest, copies))
            yield from groups
            return
        parts = [_Part(at, max(1 << 20, memory_bytes // (2 * fan_out))) for _ in range(fan_out)]
        for row in whole.read():
            parts[int(row[1][level * 4 : level * 4 + 4], 16) % fan_out].add(row)
        for part in parts:
            yield from grace(part.read(), memory_bytes, fan_out, level + 1, at)


def _groups(memory_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                cols = [batch.column(c) for c in ("uid", "sha", "largest", "copies", "text")]
                for i in range(batch.num_rows):
                    yield (*(c[i].as_py() for c in cols[:4]), cols[4][i].as_buffer().to_pybytes())

        out: list[tuple] = []

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["uid", "keep_id", "group_size", "text_sha256", "rep"])

        os.makedirs(tempfile.gettempdir(), exist_ok=True)
        for members in grace(rows(), memory_bytes):
            keep, size = None, 0
            for _, _, largest, copies in members:
                keep, size = _larger(keep, largest), size + copies
            out += [(uid, keep, size, sha, members[0][0]) for uid, sha, _, _ in members]
            if len(out) >= 4096:
                yield flush()
                out = []
        if out:
            yield flush()

    return run


def exact_dedup(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, normalize=None, memory_bytes: int = MEMORY_BYTES, hot_blocks: int = HOT_BLOCKS) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal (optionally normalised) texts the row with the largest id stays; of rows that
    repeat both id and text, all have kept true, as they are the same document.
    """
    scratch = Scratch(spark, "exact")
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    blocks = scratch.table("blocks", source.mapInArrow(_blocks(memory_bytes, normalize), BLOCKS))
    rows = blocks.select("uid", "sha", F.array_max("ids").alias("largest"), F.size("ids").cast("long").alias("copies"), "text")
    hot = scratch.table("hot", blocks.groupBy("sha").agg(F.count("*").alias("n")).where(F.col("n") > hot_blocks).select("sha"))
    if hot.head(1):
        own = rows.join(hot, "sha", "left_semi").select(*rows.columns).repartition("sha", F.pmod(F.xxhash64("uid"), F.lit(SALTS)))
        parts = scratch.table("parts", own.mapInArrow(_groups(memory_bytes), GROUPS))
        one = parts.where("uid = rep").select("uid", F.col("text_sha256").alias("sha"), F.col("keep_id").alias("largest"), F.col("group_size").alias("copies")).join(blocks.select("uid", "text"), "uid")
        whole = one.select(*rows.columns).repartition("sha").mapInArrow(_groups(memory_bytes), GROUPS).select(F.col("uid").alias("rep"), "keep_id", "group_size", "text_sha256")
        wide = parts.select("uid", "rep").join(whole, "rep").select("uid", "keep_id", "group_size", "text_sha256")
        rest = rows.join(hot, "sha", "left_anti").select(*rows.columns)
        groups = rest.repartition("sha").mapInArrow(_groups(memory_bytes), GROUPS).drop("rep").unionByName(wide)
    else:
        groups = rows.repartition("sha").mapInArrow(_groups(memory_bytes), GROUPS).drop("rep")
    return (
        blocks.select("uid", "ids")
        .join(groups, "uid")
        .select(F.explode("ids").alias("doc_id"), "keep_id", "group_size", "text_sha256")
        .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    )
