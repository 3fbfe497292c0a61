"""Token-ID files: concatenated ids with Elias-Fano encoded document boundaries.

A file holds consecutive documents in ascending id order (nulls first), little-endian:

    magic "TSLEF1\\0\\0" | n_docs u64 | n_ids u64 | id_bytes u64 | n_null u64 | first_doc i64
    boundaries: Elias-Fano of n_docs end positions | documents: Elias-Fano of their ids less first_doc
    ids: n_ids integers of id_bytes bytes

An Elias-Fano sequence of n values up to u keeps floor(log2(u / n)) low bits of each value
packed, and the high parts in unary in a bit vector of at most 3n bits, with the position of
every 256th one beside it. select reads one sample, counts bits from there and adds the low
bits, for one place or a range of them, so offsets come out in about 2 + log2(u / n) bits a
document and no table of 64-bit offsets of a file is made: files are read in blocks of documents.

Files are written by the tasks that hold the documents, each under a temporary name that
is then moved, so a task that runs again replaces what it wrote before. Each file is closed at
`file_ids` ids. Folders on other stores are reached through Arrow's file systems.

Nulls: a null text is empty and has only the end id; documents with a null id come first.
Rows that repeat an id follow each other in no fixed order, and may lie in several tasks. An empty table gives no file
and no rows. Other columns are not read.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, WordIds, slices, tasks_for, tokenizer_path, utf8

MAGIC = b"TSLEF1\0\0"
HEADER = struct.Struct("<8sQQQQq")
SAMPLE = 256
FILE_IDS = 4 << 20
BLOCK_DOCS = 4096
TASK_BYTES = 64 << 20


class EliasFano:
    """A non-decreasing sequence of integers from 0."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        bits = ((values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8) if low_bits else np.zeros(0, np.uint8)
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        return cls(n, low_bits, np.packbits(bits.reshape(-1), bitorder="little"), np.packbits(high, bitorder="little"), ones[::SAMPLE].astype(np.uint32))

    def select(self, i: int) -> int:
        """The value at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        return int(self.between(i, i + 1)[0])

    def between(self, a: int, b: int) -> np.ndarray:
        """The values at places a to b: reads the bits from the sample before a to the one after b, and no others."""
        if not 0 <= a < b <= self.n:
            return np.zeros(0, np.int64)
        first, after = a // SAMPLE, (b - 1) // SAMPLE + 1
        begin = int(self.samples[first])
        byte, stop = begin // 8, int(self.samples[after]) // 8 + 1 if after < len(self.samples) else len(self.high)
        window = np.unpackbits(self.high[byte:stop], bitorder="little")
        window[: begin - 8 * byte] = 0
        skip = a - first * SAMPLE
        ones = np.flatnonzero(window)[skip : skip + b - a] + 8 * byte
        out = (ones - np.arange(a, b)).astype(np.int64) << self.low_bits
        if self.low_bits:
            lo, hi = a * self.low_bits, b * self.low_bits
            bits = np.unpackbits(self.low[lo >> 3 : (hi + 7) >> 3], bitorder="little")[lo & 7 :][: hi - lo].reshape(b - a, self.low_bits)
            out |= (bits.astype(np.int64) << np.arange(self.low_bits)).sum(axis=1)
        return out

    def all(self) -> np.ndarray:
        """All values in order."""
        return self.between(0, self.n)

    def dump(self) -> bytes:
        parts = (self.low.tobytes(), self.high.tobytes(), self.samples.astype("<u4").tobytes())
        return struct.pack("<QQQQQ", self.n, self.low_bits, *map(len, parts)) + b"".join(parts)

    @classmethod
    def load(cls, raw: memoryview, at: int) -> tuple[EliasFano, int]:
        n, low_bits, *sizes = struct.unpack_from("<QQQQQ", raw, at)
        at += 40
        parts = []
        for size, kind in zip(sizes, (np.uint8, np.uint8, np.dtype("<u4")), strict=True):
            parts.append(np.frombuffer(raw[at : at + size], kind))
            at += size
        return cls(n, low_bits, *parts), at


class TokenFile:
    """A file's content: the ids, and which of them are each document's."""

    def __init__(self, raw: bytes):
        view = memoryview(raw)
        magic, self.n_docs, self.n_ids, width, self.n_null, self.first_doc = HEADER.unpack_from(view, 0)
        if magic != MAGIC:
            raise ValueError("not a token-id file")
        self.ends, at = EliasFano.load(view, HEADER.size)
        self.docs, at = EliasFano.load(view, at)
        self.ids = np.frombuffer(view[at : at + width * self.n_ids], f"<u{width}")

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]

    def rows(self, a: int, b: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Document ids, starts and ends of documents a to b, by select on the two sequences."""
        ends = self.ends.between(a, b)
        starts = np.concatenate([[self.ends.select(a - 1) if a else 0], ends[:-1]])
        known = self.docs.between(max(a, self.n_null) - self.n_null, b - self.n_null) + self.first_doc if b > self.n_null else np.zeros(0, np.int64)
        return pa.concat_arrays([pa.nulls(b - a - len(known), pa.int64()), pa.array(known, pa.int64())]), starts, ends

    @staticmethod
    def dump(docs: pa.ChunkedArray, counts: np.ndarray, ids: np.ndarray, width: int) -> bytes:
        known = docs.drop_null().to_numpy()
        first = int(known[0]) if len(known) else 0
        head = HEADER.pack(MAGIC, len(docs), len(ids), width, docs.null_count, first)
        body = (EliasFano.of(np.cumsum(counts)).dump(), EliasFano.of((known - first).astype(np.uint64)).dump())
        return head + b"".join(body) + ids.astype(f"<u{width}").tobytes()


class Encoder:
    """Ids of whole texts by the tokenizers library, which sees each distinct word once.

    Where a vocabulary turns white space into spaces and drops it, its normaliser and splitter
    never look across white space, so a text's ids are its words' ids in order. Every word goes
    to the whole library as it stands. Many go in one call where the number of the splitter's
    parts is plain (letters are one part, signs after them another): no word has fewer, so if the
    parts found are as many as all words need, each has just its own, and part ends cut the ids.
    Other words are calls of their own. Any other vocabulary encodes whole texts.
    """

    #: White space of Unicode; the splitters of Python and Arrow also take U+001C to U+001F.
    WORD = re.compile("[^\\t\\n\\v\\f\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
    #: ASCII signs without the apostrophe, which can open a part of letters.
    SIGNS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")

    def __init__(self, path: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        kinds = json.dumps([parts.get(k) for k in ("normalizer", "pre_tokenizer")])
        suffix = parts["model"].get("end_of_word_suffix")
        self.by_word = '"Replace"' in kinds and "\\\\s+" in kinds and '"Lowercase"' in kinds and '"invert": true' in kinds and bool(suffix)
        size = self.tokenizer.get_vocab_size()
        self.width = 2 if size <= 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        self.ends = np.array([bool(suffix) and (self.tokenizer.id_to_token(i) or "").endswith(suffix) for i in range(size)])
        self.table = WordIds(self._words)

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(found), np.int32), np.fromiter(map(len, found), np.int64, len(found))

    def _joined(self, words: list[str], parts: int) -> tuple[np.ndarray, np.ndarray]:
        """Words that have so many parts at least, in one call."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.int32)
        at = np.flatnonzero(self.ends[ids])
        if len(at) != parts * len(words) or not len(at) or at[-1] != len(ids) - 1:
            return self._each(words)
        return ids, np.diff(at[parts - 1 :: parts], prepend=-1)

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        kinds: tuple[list[int], ...] = ([], [], [])
        for i, w in enumerate(words):
            if w.isalpha():
                kinds[1].append(i)
            else:
                kinds[2 if w.rstrip(self.SIGNS).isalpha() else 0].append(i)
        order, flats, counts = [], [], []
        for parts, own in enumerate(kinds):
            for a in range(0, len(own), 1024):
                some = own[a : a + 1024]
                ids, n = self._joined([words[i] for i in some], parts) if parts else self._each([words[i] for i in some])
                order += some
                flats.append(ids)
                counts.append(n)
        flat, count = np.concatenate(flats), np.concatenate(counts)
        begin, back = np.cumsum(count) - count, np.argsort(np.array(order))
        count = count[back]
        ends = np.cumsum(count)
        return flat[np.repeat(begin[back] - (ends - count), count) + np.arange(len(flat))], count

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids of each text."""
        ids, count = self.flat(pa.array(texts, pa.string()))
        packed, ends = ids.astype(self.kind).tobytes(), np.cumsum(count) * self.width
        return [packed[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False)]

    def flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts, and the number of each one's."""
        texts = texts.fill_null("")
        if not self.by_word:
            return self._each(texts.to_pylist())
        flat, _ = utf8(texts)
        if ((flat >= 0x1C) & (flat <= 0x1F)).any():
            split = pa.array([self.WORD.findall(t) for t in texts.to_pylist()], pa.list_(texts.type))
        else:
            split = pc.utf8_split_whitespace(texts)
        words = split.flatten()
        return self.table.of(words, np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))]))


@lru_cache(maxsize=2)
def encoder_of(path: str) -> Encoder:
    """An encoder with what it has learned; kept by a worker process from task to task."""
    return Encoder(path)


def _write(path: str, folder: str, end_id: int, file_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem
        from pyspark import TaskContext

        context = TaskContext.get()
        part = context.partitionId()
        store, root = FileSystem.from_uri(folder) if ":" in folder else FileSystem.from_uri(f"file://{folder}")
        encoder = encoder_of(path)
        docs, counts, parts, made, held = [], [], [], [], 0

        def close():
            nonlocal docs, counts, parts, held
            name = f"{root}/{part:08d}-{len(made):08d}.tok"
            with store.open_output_stream(f"{name}.{context.taskAttemptId()}") as out:
                out.write(TokenFile.dump(pa.chunked_array(docs), np.concatenate(counts), np.concatenate(parts), encoder.width))
            store.move(f"{name}.{context.taskAttemptId()}", name)
            made.append((part, len(made), sum(map(len, docs)), held))
            docs, counts, parts, held = [], [], [], 0

        for batch in slices(batches, "text", 4 << 20):
            ids, count = encoder.flat(batch.column("text"))
            count = count + 1
            ends = np.cumsum(count)
            every = np.full(int(ends[-1]), end_id, encoder.kind)
            text = np.ones(len(every), bool)
            text[ends - 1] = False
            every[text] = ids
            a, n = 0, len(count)
            while a < n:  # as many documents as the file has room for, one at least if it is empty
                begin = ends[a] - count[a]
                b = int(np.searchsorted(ends, begin + file_ids - held, "right"))
                b = max(b, a + (not held))
                if b > a:
                    docs.append(batch.column("id").slice(a, b - a))
                    counts.append(count[a:b])
                    parts.append(every[begin : ends[b - 1]])
                    held += int(ends[b - 1] - begin)
                if b < n:
                    close()
                a = b
        if docs:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], pa.int64()) for i in range(4)], names=["part", "file", "n_docs", "n_ids"])

    return run


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            file = TokenFile(content.as_buffer())
            part, number = (int(x) for x in path.rsplit("/", 1)[1].removesuffix(".tok").split("-"))
            for a in range(0, file.n_docs, BLOCK_DOCS):
                docs, starts, ends = file.rows(a, b := min(a + BLOCK_DOCS, file.n_docs))
                ids = file.ids[starts[0] : ends[-1]].astype("<u4").tobytes()
                at = [0, *(4 * (ends - starts[0])).tolist()]
                sums = [zlib.crc32(memoryview(ids)[x:y]) for x, y in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(b - a, part)), pa.array(np.full(b - a, number)), docs, pa.array(starts), pa.array(ends - starts), pa.array(sums, pa.int64())],
                    names=["part", "file", "doc_id", "inside", "n_tokens", "ids_crc32"],
                )


def write_token_files(spark: SparkSession, docs: DataFrame, folder: str, tokenizer: str, *, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", file_ids: int = FILE_IDS) -> DataFrame:
    """Writes the files into a folder that all executors share; returns part, file, n_docs and n_ids of each."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    tied = source.withColumn("tie", F.monotonically_increasing_id())  # rows that share an id, or have none, are no single range
    ordered = tied.repartitionByRange(tasks_for(spark, docs, TASK_BYTES), "id", "tie").sortWithinPartitions("id").select("id", "text")
    scratch = Scratch(spark, "tokens")
    return scratch.table("files", ordered.mapInArrow(_write(tokenizer_path(tokenizer), folder, end_id, file_ids), "part bigint, file bigint, n_docs bigint, n_ids bigint"))


def read_token_files(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """One row for each document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.tok").load(folder).select("path", "content")
    rows = found.mapInArrow(_read, "part bigint, file bigint, doc_id bigint, inside bigint, n_tokens bigint, ids_crc32 bigint")
    # one number for each task that wrote files goes to the driver, not one for each file or document
    totals = sorted((r["part"], r["n"]) for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    ahead, before = [], 0
    for part, n in totals:
        ahead.append((part, before))
        before += n
    base = spark.createDataFrame(ahead, "part bigint, base bigint")
    from pyspark.sql import Window

    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("file")) - F.col("n_ids")
    starts = files.select("part", "file", inside.alias("ahead")).join(base, "part").select("part", "file", (F.col("ahead") + F.col("base")).alias("base"))
    return rows.join(starts, ["part", "file"]).select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def token_files(spark: SparkSession, docs: DataFrame, tokenizer: str, *, end_id: int = 2, folder: str | None = None, file_ids: int = FILE_IDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the token-id files of docs and reads them back."""
    if folder is None:
        folder = Scratch(spark, "token-files").root
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    files = write_token_files(spark, docs, folder, tokenizer, end_id=end_id, id_col=id_col, text_col=text_col, file_ids=file_ids)
    if not files.head(1):
        return spark.createDataFrame([], "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    return read_token_files(spark, folder, files)
